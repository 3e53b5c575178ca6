"""ID quality: cluster purity (A12), neighbor purity (K3), per-category report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tags import is_tagged
from ..session import cut_lineage
from .lsh import knn_lsh
from .neighbors import block_count, knn_exact


def cluster_purity(df: DataFrame, cluster_col: str, label_col: str) -> DataFrame:
    """Micro (size-weighted) and macro purity of clusters w.r.t. labels.

    Empty labels are excluded; nothing left gives 0.  A hot cluster or label
    is absorbed by the partial aggregation of ``(cluster, label)`` counts.
    """
    labeled = df.filter(is_tagged(F.col(label_col).cast("string")))
    per = labeled.groupBy(cluster_col, label_col).agg(F.count("*").alias("n"))
    clus = per.groupBy(cluster_col).agg(F.max("n").alias("m"), F.sum("n").alias("t"))
    return clus.agg(
        F.coalesce(F.try_divide(F.sum("m").cast("double"), F.sum("t")), F.lit(0.0)).alias("micro"),
        F.coalesce(F.avg(F.col("m") / F.col("t")), F.lit(0.0)).alias("macro"))


def neighbor_purity_from_knn(knn: DataFrame, labels: DataFrame, k: int, id_col: str = "id",
                             label_col: str = "label") -> DataFrame:
    """K3 from a K1 result: per row the majority-label share among its k neighbors
    (divided by k); micro = mean over rows, macro = mean over own-label classes."""
    lab = labels.select(F.col(id_col).alias("neighbor_id"), F.col(label_col).alias("nlabel"))
    per = knn.join(lab, "neighbor_id").groupBy(id_col, "nlabel").agg(F.count("*").alias("c"))
    score = per.groupBy(id_col).agg((F.max("c") / F.lit(float(k))).alias("s"))
    own = score.join(labels.select(id_col, label_col), id_col)
    by_label = own.groupBy(label_col).agg(F.sum("s").alias("ss"), F.count("*").alias("n"))
    return by_label.agg(
        F.coalesce(F.try_divide(F.sum("ss"), F.sum("n").cast("double")), F.lit(0.0)).alias("micro"),
        F.coalesce(F.avg(F.col("ss") / F.col("n")), F.lit(0.0)).alias("macro"))


def neighbor_purity(df: DataFrame, k: int = 20, id_col: str = "id", vec_col: str = "features",
                    label_col: str = "label", block_rows: int = 16_384, approximate: bool = False) -> DataFrame:
    """K3: neighbor purity@k among labeled rows (n <= k labeled rows gives 0); ``approximate``: neighbors by hashing
    (``lsh.knn_lsh``) instead of the exact block join."""
    labeled = df.filter(is_tagged(F.col(label_col).cast("string"))).select(id_col, vec_col, label_col)
    n = labeled.count()
    if n <= k:
        return df.sparkSession.createDataFrame([(0.0, 0.0)], "micro double, macro double")
    if approximate:
        knn, _ = knn_lsh(labeled, k, id_col, vec_col)
    else:
        knn = knn_exact(labeled, k, id_col, vec_col, "euclidean", block_rows,
                        n_blocks=block_count(n, block_rows))  # n is known: no second count
    return neighbor_purity_from_knn(knn, labeled, k, id_col, label_col)


def _same_row_sets(df: DataFrame, cols: list[str]) -> list[list[str]]:
    """Group tag columns whose labeled-row sets are identical (one aggregation)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    if not pairs:
        return [[c] for c in cols]
    diff = df.agg(*[F.count_if(is_tagged(F.col(a).cast("string")) != is_tagged(F.col(b).cast("string")))
                    .alias(f"{a}|{b}") for a, b in pairs]).collect()[0]
    groups: list[list[str]] = []
    for c in cols:
        for g in groups:
            if diff[f"{g[0]}|{c}"] == 0:
                g.append(c)
                break
        else:
            groups.append([c])
    return groups


def quality_report(df: DataFrame, tag_cols: list[str], cluster_col: str = "semantic_id",
                   id_col: str = "track_id", vec_col: str | None = None, k: int = 20,
                   block_rows: int = 16_384, approximate: bool = False) -> DataFrame:
    """Cluster purity (and neighbor purity@k when ``vec_col`` is given) per tag column.

    Neighbor purity needs the kNN among each category's labeled rows (exact, or by hashing if
    ``approximate``); categories that label the same rows share one kNN computation.
    """
    rows = []
    for c in tag_cols:
        rows.append(cluster_purity(df, cluster_col, c).select(
            F.lit(c).alias("category"), F.col("micro").alias("cluster_micro"),
            F.col("macro").alias("cluster_macro"),
            F.lit(None).cast("double").alias("neighbor_micro"), F.lit(None).cast("double").alias("neighbor_macro")))
    if vec_col:
        for group in _same_row_sets(df, tag_cols):
            labeled = df.filter(is_tagged(F.col(group[0]).cast("string")))
            n = labeled.count()
            knn = None
            if n > k and approximate:
                knn, _ = knn_lsh(labeled.select(id_col, vec_col), k, id_col, vec_col)
            elif n > k:
                knn = knn_exact(labeled.select(id_col, vec_col), k, id_col, vec_col, "euclidean", block_rows,
                                n_blocks=block_count(n, block_rows))
            if knn is not None and len(group) > 1:
                knn = cut_lineage(knn)  # computed once, read by every category of the group
            for c in group:
                if knn is None:
                    np_ = df.sparkSession.createDataFrame([(0.0, 0.0)], "micro double, macro double")
                else:
                    np_ = neighbor_purity_from_knn(knn, labeled.select(id_col, c), k, id_col, c)
                rows.append(np_.select(
                    F.lit(c).alias("category"), F.lit(None).cast("double").alias("cluster_micro"),
                    F.lit(None).cast("double").alias("cluster_macro"),
                    F.col("micro").alias("neighbor_micro"), F.col("macro").alias("neighbor_macro")))
    # one row per category from the union of one-row results (no join on a constant key)
    u = reduce(lambda a, b: a.unionByName(b), rows)
    metrics = ["cluster_micro", "cluster_macro"] + (["neighbor_micro", "neighbor_macro"] if vec_col else [])
    return u.groupBy("category").agg(*[F.max(m).alias(m) for m in metrics])
