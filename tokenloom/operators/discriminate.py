"""Feature discrimination: which features separate tags (A14, A7+W6, P18, S11, T1, T5, T9).

All categories and all features are analysed in ONE aggregation: tag columns
are unpivoted, every track keeps its single top label per category, the
feature array is exploded after the join, and one-way ANOVA is computed in
closed form from per-(category, feature, label) counts, means and variances.
Only the p-value (F distribution tail) runs in Python, over one row per
feature.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.tags import split_tags
from ..functions.vectors import as_doubles, nan_to_zero
from ..session import cut_lineage


# ---- P18 ---------------------------------------------------------------------------

def fill_missing(df: DataFrame, col: str = "features") -> tuple[DataFrame, DataFrame]:
    """null/NaN feature values -> 0; also returns the count of filled values."""
    arr = as_doubles(col)
    n_missing = F.aggregate(arr, F.lit(0), lambda acc, v: acc + F.when(v.isNull() | F.isnan(v), 1).otherwise(0))
    counted = df.agg(F.sum(n_missing).cast("long").alias("n_filled"))
    return df.withColumn(col, nan_to_zero(arr)), counted


# ---- A14 ---------------------------------------------------------------------------

def _betacf(a, b, x, iters=300):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < tiny, tiny, d)
    d = 1.0 / d
    h = d.copy()
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        delta = d * c
        h *= delta
        if np.all(np.abs(delta - 1.0) < 1e-15):
            break
    return h


def betainc_reg(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularized incomplete beta I_x(a, b), vectorized."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(b) & np.isfinite(x) & (a > 0) & (b > 0)
    out[ok & (x <= 0)] = 0.0
    out[ok & (x >= 1)] = 1.0
    mid = ok & (x > 0) & (x < 1)
    if mid.any():
        am, bm, xm = a[mid], b[mid], x[mid]
        lg = np.vectorize(math.lgamma)
        front = np.exp(lg(am + bm) - lg(am) - lg(bm) + am * np.log(xm) + bm * np.log1p(-xm))
        direct = xm < (am + 1.0) / (am + bm + 2.0)
        res = np.empty_like(xm)
        res[direct] = front[direct] * _betacf(am[direct], bm[direct], xm[direct]) / am[direct]
        flip = ~direct
        res[flip] = 1.0 - front[flip] * _betacf(bm[flip], am[flip], 1.0 - xm[flip]) / bm[flip]
        out[mid] = res
    return out


def f_sf(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """Upper tail P(F > f) of the F(d1, d2) distribution."""
    f = np.asarray(f, dtype=float)
    x = d2 / (d2 + d1 * f)
    p = betainc_reg(d2 / 2.0, d1 / 2.0, x)
    return np.where(np.isnan(f), np.nan, p)


@F.pandas_udf(T.DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_sf(f.to_numpy(dtype=float, na_value=np.nan),
                          d1.to_numpy(dtype=float), d2.to_numpy(dtype=float)))


def anova(long: DataFrame, group_cols: list[str], label_col: str = "label",
          value_col: str = "value") -> DataFrame:
    """A14 (F and eta squared): one-way ANOVA of ``value`` by ``label`` within each group.

    Output ``*group_cols, n, n_groups, df_between, df_within, ss_between,
    ss_within, f_statistic, eta_squared``.  Groups with fewer than two
    non-empty labels are skipped (W9); F is null when SSW is 0.
    """
    per = long.groupBy(*group_cols, label_col).agg(
        F.count(value_col).alias("ng"), F.avg(value_col).alias("mg"), F.var_pop(value_col).alias("vg"))
    per = per.filter(F.col("ng") > 0)  # a label without any value is no group
    # totals by a window over the aggregated rows (<= labels rows per group), so the
    # heavy per-label aggregation is planned once instead of feeding a self-join
    w = Window.partitionBy(*group_cols)
    j = (per.withColumn("n", F.sum("ng").over(w)).withColumn("n_groups", F.count("*").over(w))
         .withColumn("gm", F.sum(F.col("ng") * F.col("mg")).over(w) / F.col("n"))
         .filter(F.col("n_groups") >= 2))
    ss = j.groupBy(*group_cols).agg(
        F.first("n").alias("n"), F.first("n_groups").alias("n_groups"),
        F.sum(F.col("ng") * (F.col("mg") - F.col("gm")) ** 2).alias("ss_between"),
        F.sum(F.col("ng") * F.col("vg")).alias("ss_within"))
    dfb = (F.col("n_groups") - 1).cast("bigint")
    dfw = (F.col("n") - F.col("n_groups")).cast("bigint")
    fstat = F.try_divide(F.col("ss_between") / dfb, F.try_divide(F.col("ss_within"), dfw))
    total = F.col("ss_between") + F.col("ss_within")
    return ss.select(*group_cols, F.col("n").cast("long").alias("n"), F.col("n_groups").cast("int").alias("n_groups"),
                     dfb.alias("df_between"), dfw.alias("df_within"), "ss_between", "ss_within",
                     F.when(F.col("ss_within") > 0, fstat).alias("f_statistic"),
                     F.when(total > 0, F.col("ss_between") / total).otherwise(F.lit(0.0)).alias("eta_squared"))


def with_pvalues(res: DataFrame, rank_within: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """A14 (p) + T1 + D10: p-value, significance, and rank by F descending."""
    p = f_pvalue(F.col("f_statistic"), F.col("df_between").cast("double"), F.col("df_within").cast("double"))
    out = res.withColumn("p_value", p).withColumn("significant", F.col("p_value") < alpha)
    ties = [c for c in res.columns if c in ("feature", "idx")]
    order = [F.desc_nulls_last("f_statistic"), *ties]
    # one row per feature: the window is features-sized
    w = Window.partitionBy(*rank_within).orderBy(*order) if rank_within else Window.orderBy(*order)
    return out.withColumn("rank", F.row_number().over(w))


# ---- per-category labels (A7 + W6 over every tag column at once) ---------------------

def single_top_labels(tags: DataFrame, tag_cols: list[str], key: str = "track_id", top_n: int = 10,
                      always_include: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns ``(labels, top)``: each track's single top label per category, and the top lists.

    ``top`` has at most ``top_n + 1`` rows per category, so it is broadcast.
    """
    stack = ", ".join(f"'{c}', `{c}`" for c in tag_cols)
    long = tags.selectExpr(key, f"stack({len(tag_cols)}, {stack}) as (category, tags)")
    exploded = long.select(key, "category", F.explode(split_tags("tags")).alias("tag"))
    counts = exploded.groupBy("category", "tag").agg(F.count("*").alias("n"))
    w = Window.partitionBy("category").orderBy(F.desc("n"), F.asc("tag"))
    # the limit goes below the shuffle: a task ranks the first of each partition, not all tags of a category
    first = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)
    top = first
    for cat, tag in (always_include or {}).items():
        forced = counts.filter((F.col("category") == cat) & (F.col("tag") == tag)).join(
            F.broadcast(first.select("category", "tag")), ["category", "tag"], "left_anti")
        top = top.unionByName(forced.withColumn("rank", F.lit(top_n + 1)))
    # repeats count: "a---a" with a in the top list matches twice and is dropped
    matches = exploded.join(F.broadcast(top.select("category", "tag")), ["category", "tag"])
    labels = (matches.groupBy(key, "category").agg(F.count("*").alias("m"), F.min("tag").alias("label"))
              .filter(F.col("m") == 1).drop("m"))
    return labels, top


def discrimination(features: DataFrame, tags: DataFrame, names: list[str], tag_cols: list[str],
                   key: str = "track_id", col: str = "features", top_n: int = 10,
                   always_include: dict[str, str] | None = None, min_rows: int = 10,
                   standardize: bool = True) -> DataFrame:
    """A14 for every category x feature: ``category, feature, f_statistic, p_value,
    eta_squared, significant, rank`` (rank 1 = largest F within the category)."""
    from .linalg import fit_scaler

    filled, _ = fill_missing(features.select(key, col), col)
    if standardize:
        filled = fit_scaler(filled, col).apply(filled, col)
    labels, _ = single_top_labels(tags, tag_cols, key, top_n, always_include)
    names_arr = F.array(*[F.lit(n) for n in names])
    long = (labels.join(filled, key)
            .select("category", "label", F.posexplode(col).alias("idx", "value"))
            .withColumn("feature", F.get(names_arr, F.col("idx"))))
    # A category with fewer than min_rows labeled tracks is skipped; after the
    # fill every feature of a labeled track has a value, so n is that row count
    res = anova(long, ["category", "feature"], "label", "value").filter(F.col("n") >= min_rows)
    return with_pvalues(res, ["category"]).select(
        "category", "feature", "f_statistic", "p_value", "eta_squared", "significant", "rank",
        "n", "n_groups")


def discrimination_summary(res: DataFrame) -> DataFrame:
    """Per category feature count, significant count, mean F, mean eta squared."""
    return res.groupBy("category").agg(
        F.count("*").alias("n_features"),
        F.count_if(F.col("significant")).alias("n_significant"),
        F.avg("f_statistic").alias("mean_f"),
        F.avg("eta_squared").alias("mean_eta_squared"))


def feature_pairs(res: DataFrame, group_cols: list[str], n: int = 6) -> DataFrame:
    """T5: the top-n features by F as consecutive pairs (1,2), (3,4), (5,6)."""
    top = res.filter(F.col("rank") <= n).select(*group_cols, "rank", "feature")
    a = top.filter(F.col("rank") % 2 == 1).select(*group_cols, ((F.col("rank") + 1) / 2).cast("int").alias("pair"),
                                                  F.col("feature").alias("feature_x"))
    b = top.filter(F.col("rank") % 2 == 0).select(*group_cols, (F.col("rank") / 2).cast("int").alias("pair"),
                                                  F.col("feature").alias("feature_y"))
    return a.join(b, group_cols + ["pair"], "left")


#: Value ranges of a refinement pass, and groups above which their states meet the rows in a shuffle join.
RANGES, FEW_GROUPS = 1024, 100_000


def _place(v, lo, hi, by_ratio):
    """The number of the range of ``v`` within [lo, hi]: equal widths, or widths that halve towards ``lo`` (for
    values of very different sizes).  It never falls as ``v`` grows."""
    span = hi - lo
    huge = F.lit(1.7976931348623157e308)
    t = F.when(span <= huge, (v - lo) / span).otherwise((v / 2 - lo / 2) / (hi / 2 - lo / 2))
    even = F.least(F.floor(t * RANGES), F.lit(RANGES - 1).cast("bigint"))
    ratio = F.when(t <= 0, 0).otherwise(F.greatest(F.lit(1).cast("bigint"), RANGES - 1 + F.floor(F.log2(t) * 16)))
    inner = F.when(F.lit(by_ratio), ratio).otherwise(even)
    # infinite ends are ranges of their own
    return F.when(v == lo, F.lit(-1).cast("bigint")).when(v == hi, F.lit(RANGES).cast("bigint")).otherwise(F.coalesce(inner, F.lit(0).cast("bigint")))


def value_quantiles(long: DataFrame, group_cols: list[str], value_col: str = "value", passes: int = 200) -> DataFrame:
    """Count and quartiles per group, exact at any size: the smallest value with at least that share of the group's
    values up to it.  Nulls and NaN count as rows but are no values.

    Distributed selection by range refinement.  Each quartile of each group has a rank and a value range that holds it;
    a pass counts the values of all groups by ``RANGES`` parts of their ranges, keeps the part of each rank (its least and
    largest value are the next range), and ends where that is one value.  Equal parts and parts of equal ratio take
    turns.  A pass shuffles at most ``RANGES`` + 2 counts for each quartile; no value is collected or sorted."""
    key = F.struct(*group_cols)
    v = F.col(value_col).cast("double")
    rows = long.select(key.alias("g"), F.when(~F.isnan(v), v).alias("v"))
    total = cut_lineage(rows.groupBy("g").agg(F.count("*").alias("n"), F.count("v").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    few = total.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    share = F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    state = total.where("m > 0").select("g", share.alias("q"), F.lit(0).cast("bigint").alias("below"), "m", "lo", "hi")
    state = state.withColumn("rank", F.greatest(F.ceil(F.col("q") * F.col("m")), F.lit(1).cast("bigint"))).drop("m")
    state, done = cut_lineage(state), []
    for turn in range(passes):
        done.append(state.where("lo = hi").select("g", "q", F.col("lo").alias("value")))
        state = state.where("lo < hi")
        if state.isEmpty():
            break
        # the ranges of a group's three quartiles in one row
        side = state.groupBy("g").agg(F.collect_list(F.struct("q", "rank", "below", "lo", "hi")).alias("open"))
        side = side.withColumnRenamed("g", "own")
        met = rows.where("v IS NOT NULL").join(F.broadcast(side) if few else side, F.col("g").eqNullSafe(F.col("own")))
        inside = met.select("g", "v", F.explode("open").alias("s")).where((F.col("v") >= F.col("s.lo")) & (F.col("v") <= F.col("s.hi")))
        at = _place(F.col("v"), F.col("s.lo"), F.col("s.hi"), turn % 2 == 1)
        parts = inside.groupBy("g", F.col("s.q").alias("q"), F.col("s.rank").alias("rank"), F.col("s.below").alias("below"), at.alias("at")).agg(
            F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        w = Window.partitionBy("g", "q").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        parts = parts.withColumn("upto", F.col("below") + F.sum("c").over(w)).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank")))
        state = cut_lineage(parts.select("g", "q", (F.col("upto") - F.col("c")).alias("below"), "lo", "hi", "rank"))
    else:
        raise RuntimeError(f"quantiles: not settled after {passes} passes")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    one = lambda q: F.max(F.when(F.col("q") == q, F.col("value")))
    found = found.groupBy(F.col("g").alias("own")).agg(one(0.25).alias("q25"), one(0.5).alias("median"), one(0.75).alias("q75"))
    out = total.join(found, F.col("g").eqNullSafe(F.col("own")), "left")
    return out.select(*[F.col(f"g.{c}").alias(c) for c in group_cols], "n", "q25", "median", "q75")


def value_density(long: DataFrame, group_cols: list[str], value_col: str = "value", bins: int = 32) -> DataFrame:
    """The outline of each group's violin: ``bin`` (from 0), its ``left`` and ``right`` edge between the group's least and
    largest value, ``n`` values and their ``density`` (share of the group over the width; null for a group of one value).
    Nulls, NaN and infinite values are left out; empty bins have no row."""
    v = F.col(value_col).cast("double")
    rows = long.select(F.struct(*group_cols).alias("g"), v.alias("v")).where(F.abs(v) < F.lit(float("inf")))
    ends = rows.groupBy("g").agg(F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumnRenamed("g", "own")
    few = ends.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    met = rows.join(F.broadcast(ends) if few else ends, F.col("g").eqNullSafe(F.col("own")))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1).cast("bigint"))).otherwise(0)
    counted = met.groupBy("g", "m", "lo", "hi", at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    return counted.select(*[F.col(f"g.{c}").alias(c) for c in group_cols], "bin", (F.col("lo") + F.col("bin") * width).alias("left"),
                          (F.col("lo") + (F.col("bin") + 1) * width).alias("right"), "n",
                          F.when(width > 0, F.col("n") / F.col("m") / width).alias("density"))


def contrast_valley_pairs(names: list[str]) -> list[tuple[str, str]]:
    """Fixed scatter pairs: spectral contrast i against spectral valley i, when both exist."""
    have = set(names)
    return [(f"spec_contrast_mean_{i}", f"spec_valley_mean_{i}") for i in range(6)
            if f"spec_contrast_mean_{i}" in have and f"spec_valley_mean_{i}" in have]


def pair_values(features: DataFrame, labels: DataFrame, names: list[str], pairs: list[tuple[str, str]],
                key: str = "track_id", col: str = "features", label_col: str = "label") -> DataFrame:
    """Scatter input (T5 pairs or fixed pairs): ``(pair, x, y, label)`` per labeled track and pair."""
    idx = {n: i for i, n in enumerate(names)}
    arr = F.array(*[F.struct(F.lit(f"{a}|{b}").alias("pair"), F.get(F.col(col), idx[a]).alias("x"),
                             F.get(F.col(col), idx[b]).alias("y")) for a, b in pairs])
    carry = [c for c in labels.columns if c != key]          # label plus e.g. category
    j = labels.join(features.select(key, col), key)
    return j.select(*carry, F.explode(arr).alias("p")).select("p.pair", "p.x", "p.y", *carry)


def _top_features(res: DataFrame, names: list[str], n: int) -> list[tuple[str, int, str]]:
    """(category, rank, feature) of the top ``n`` features of each category: at most n rows a category reach the driver."""
    rows = res.filter(F.col("rank") <= n).select("category", "rank", "feature").collect()
    return sorted((r["category"], r["rank"], r["feature"]) for r in rows if r["feature"] in set(names))


def top_feature_values(features: DataFrame, labels: DataFrame, names: list[str], res: DataFrame, n: int = 6, key: str = "track_id",
                       col: str = "features") -> DataFrame:
    """Violin input (T9): ``(category, feature, label, value)`` of the top ``n`` features of each category, per labeled track."""
    idx = {f: i for i, f in enumerate(names)}
    top = _top_features(res, names, n)
    kind = "array<struct<category:string,feature:string,value:double>>"
    arr = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(f).alias("feature"), F.get(F.col(col), idx[f]).alias("value")) for c, _, f in top]).cast(kind)
    j = labels.select(key, F.col("category").alias("own"), "label").join(features.select(key, col), key)
    each = j.select("label", F.explode(F.filter(arr, lambda s: s["category"] == F.col("own"))).alias("p"))
    return each.select("p.category", "p.feature", "label", "p.value")


def top_pair_values(features: DataFrame, labels: DataFrame, names: list[str], res: DataFrame, n: int = 6, key: str = "track_id",
                    col: str = "features") -> DataFrame:
    """Scatter input (T5): ``(category, pair, feature_x, feature_y, x, y, label)`` of the consecutive pairs among each category's top ``n``
    features, per labeled track."""
    idx = {f: i for i, f in enumerate(names)}
    by = {(c, r): f for c, r, f in _top_features(res, names, n)}
    pairs = [(c, (r + 1) // 2, f, by[c, r + 1]) for (c, r), f in sorted(by.items()) if r % 2 and (c, r + 1) in by]
    kind = "array<struct<category:string,pair:int,feature_x:string,feature_y:string,x:double,y:double>>"
    arr = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(k).alias("pair"), F.lit(a).alias("feature_x"), F.lit(b).alias("feature_y"),
                             F.get(F.col(col), idx[a]).alias("x"), F.get(F.col(col), idx[b]).alias("y")) for c, k, a, b in pairs]).cast(kind)
    j = labels.select(key, F.col("category").alias("own"), "label").join(features.select(key, col), key)
    each = j.select("label", F.explode(F.filter(arr, lambda s: s["category"] == F.col("own"))).alias("p"))
    return each.select("p.*", "label")


def tonal_vectors(features: DataFrame, labels: DataFrame, names: list[str], key: str = "track_id",
                  col: str = "features", label_col: str = "label") -> DataFrame:
    """3-D tonal plot input: the key vector of every labeled track."""
    idx = {n: i for i, n in enumerate(names)}
    carry = [c for c in labels.columns if c != key]
    j = labels.join(features.select(key, col), key)
    return j.select(key, *carry, *[F.get(F.col(col), idx[f"key_vector_{a}"]).alias(a) for a in "xyz"])
