"""Tag-table operators: merges (J1-J4), filters (W1-W10) and profiles.

All of them are single DataFrame plans.  Profiles are one aggregation each
(partial aggregation on the map side, a handful of rows to the driver).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tags import is_tagged, n_tagged, split_tags

KEYS = ["track_id", "path"]
TAG_COLS = ["genre", "mood", "instrument"]


# ---- contracts -------------------------------------------------------------

class DuplicateKeyError(ValueError):
    pass


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once (A4 / J4 check), with their counts."""
    return df.groupBy(*keys).count().filter(F.col("count") > 1)


def assert_unique(df: DataFrame, keys: list[str], what: str = "table") -> None:
    """Raise when a key repeats; only one offending key reaches the driver."""
    bad = duplicate_keys(df, keys).limit(1).collect()
    if bad:
        raise DuplicateKeyError(f"{what}: key {[bad[0][k] for k in keys]} occurs {bad[0]['count']} times")


# ---- merges ----------------------------------------------------------------

def merge_outer(tables: dict[str, DataFrame], keys: list[str] = KEYS) -> DataFrame:
    """Full outer merge of category tables on the keys; missing tag -> ``""``.

    Expressed as union + group-by: one shuffle for any number of categories, instead of
    a chain of full outer joins that each re-shuffle on the coalesced key.  A key that a
    table repeats keeps every combination of its rows, as a join does; the programs'
    one-to-one checks (A4, J4) then raise.
    """
    parts = [t.select(*keys, F.lit(cat).alias("_cat"), F.col(cat).alias("_tag"))
             for cat, t in tables.items()]
    u = reduce(lambda a, b: a.unionByName(b), parts)
    found = [F.collect_list(F.when(F.col("_cat") == cat, F.coalesce("_tag", F.lit("")))).alias(cat) for cat in tables]
    out = u.groupBy(*keys).agg(*found)
    for cat in tables:
        out = out.withColumn(cat, F.explode_outer(cat))
    return out.select(*keys, *[F.coalesce(F.col(cat), F.lit("")).alias(cat) for cat in tables])


def merge_inner(a: DataFrame, b: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Inner merge of two category tables."""
    return a.join(b, keys, "inner")


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str] = KEYS,
                    how: str = "left", validate: bool = True) -> DataFrame:
    """Left join validated one-to-one (a repeated key on either side raises)."""
    if validate:
        assert_unique(left, keys, "left side")
        assert_unique(right, keys, "right side")
    return left.join(right, keys, how)


# ---- filters ---------------------------------------------------------------

def filter_min_tags(df: DataFrame, min_tags: int = 2, cols: list[str] = TAG_COLS) -> DataFrame:
    """W1 (>=2 of three), W2 (both of two), W3 (>=1), W5 (treated as W2)."""
    return df.filter(n_tagged(cols) >= min_tags)


def filter_any_tag(df: DataFrame, cols: list[str] = TAG_COLS) -> DataFrame:
    """OR of non-empty predicates (on null-free tags this equals W3)."""
    cond = reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit("x")) != "" for c in cols])
    return df.filter(cond)


def filter_labeled(df: DataFrame, label: str) -> DataFrame:
    """Drop rows with an empty or null label."""
    return df.filter(is_tagged(label))


# ---- profiles --------------------------------------------------------------

def tag_coverage(df: DataFrame, cols: list[str] = TAG_COLS) -> DataFrame:
    """A2: per category rows, non-empty count and percentage (null when no rows)."""
    wide = df.agg(F.count("*").alias("n_rows"),
                  *[F.count_if(is_tagged(c)).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = wide.selectExpr("n_rows", f"stack({len(cols)}, {stack}) as (category, n_tagged)")
    return long.select("category", "n_rows", "n_tagged",
                       F.when(F.col("n_rows") > 0,
                              F.col("n_tagged") * 100.0 / F.col("n_rows")).alias("pct"))


def filter_retention(df: DataFrame, keep: Column, cols: list[str] = TAG_COLS) -> DataFrame:
    """A3: rows kept by a predicate, share kept, and non-empty counts among kept rows."""
    return df.agg(F.count("*").alias("n_total"),
                  F.count_if(keep).alias("n_kept"),
                  F.try_divide(F.count_if(keep) * 100.0, F.count("*")).alias("pct_kept"),
                  *[F.count_if(keep & is_tagged(c)).alias(f"{c}_tagged") for c in cols])


def category_counts(df: DataFrame, cols: list[str] = TAG_COLS) -> DataFrame:
    """A5: rows by number of non-empty categories."""
    return df.groupBy(n_tagged(cols).alias("n_categories")).agg(F.count("*").alias("n_rows"))


def top_counts(df: DataFrame, col: str, n: int) -> DataFrame:
    """Most frequent non-empty values (ties by value)."""
    return (df.filter(is_tagged(col)).groupBy(F.col(col).alias("tag"))
            .agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("tag")).limit(n))


def top_tags(df: DataFrame, col: str, n: int, always_include: str | None = None) -> DataFrame:
    """Counts of ``---``-separated labels, top ``n`` plus a forced label.

    The forced label (``'sad'`` for mood in the reference) is appended when
    it occurs at all and is outside the top ``n``.  Output ``tag, n, rank``.
    """
    counts = (df.select(F.explode(split_tags(col)).alias("tag"))
              .groupBy("tag").agg(F.count("*").alias("n")))
    top = counts.orderBy(F.desc("n"), F.asc("tag")).limit(n)
    # the window runs over the <= n rows left after the limit
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("tag"))))
    if always_include is None:
        return ranked
    forced = (counts.filter(F.col("tag") == always_include)
              .join(top.select("tag"), "tag", "left_anti")
              .withColumn("rank", F.lit(n + 1)))
    return ranked.unionByName(forced)


def single_top_tag(df: DataFrame, col: str, top: list[str], out: str | None = None) -> DataFrame:
    """Keep rows holding exactly one of the top labels (repeats count) and name it."""
    out = out or f"{col}_single"
    top_arr = F.array(*[F.lit(t) for t in top]) if top else F.array().cast("array<string>")
    hits = F.filter(F.split(F.col(col), "---"), lambda t: F.array_contains(top_arr, t))
    return (df.withColumn("_hits", hits)
            .filter(F.size("_hits") == 1)
            .withColumn(out, F.get(F.col("_hits"), 0)).drop("_hits"))


def in_top(df: DataFrame, col: str, top: DataFrame, top_col: str = "tag") -> DataFrame:
    """Rows whose value is among the top values (left-semi join; top is <= n rows)."""
    return df.join(F.broadcast(top.select(F.col(top_col).alias(col))), col, "left_semi")


def check_tag_distribution(df: DataFrame, top: int = 20, cols: list[str] = TAG_COLS,
                           key: list[str] = ["path"]) -> dict[str, DataFrame]:
    """A4 + A5 + A6: the key must be unique (raises otherwise), then rows by number of
    non-empty categories and the ``top`` most frequent tags per category."""
    assert_unique(df, key, "tag table")
    tops = [top_counts(df, c, top).withColumn("category", F.lit(c)) for c in cols]
    return {"category_counts": category_counts(df, cols),
            "top_tags": reduce(lambda a, b: a.unionByName(b), tops)}


def attach_ids(df: DataFrame, ids: DataFrame, keys: list[str] = ["track_id"]) -> DataFrame:
    """Semantic IDs joined to their rows by key (never by position), one-to-one checked."""
    return join_one_to_one(df, ids, keys, "left")
