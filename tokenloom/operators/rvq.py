"""Residual vector quantization: fit (M4) and apply (M5).

A codebook is a small table ``(level int, token int, center array<double>)``.
Fitting runs distributed k-means (``operators.kmeans``) on the residual of each
level; ``n_init`` restarts keep the lowest training cost.  Applying a codebook is one pass over the data: every Arrow batch is
assigned to its nearest center level by level with BLAS, the codebook
(levels x K x dim doubles, size-checked) travels inside the task closure.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import as_doubles
from ..session import cut_lineage
from .kmeans import fit_kmeans

MAX_CODEBOOK_VALUES = 5_000_000  # 40 MB of doubles; K=128 x d=221 x L=3 is 85k


def codebook_arrays(codebook: DataFrame) -> list[np.ndarray]:
    """Codebook table -> one (K, dim) array per level (model-sized, size-checked)."""
    size = codebook.select(F.sum(F.size("center")).alias("s")).collect()[0]["s"] or 0
    if size > MAX_CODEBOOK_VALUES:
        raise ValueError(f"codebook has {size} values; limit {MAX_CODEBOOK_VALUES}")
    rows = codebook.orderBy("level", "token").collect()
    levels: dict[int, dict[int, list[float]]] = {}
    for r in rows:
        levels.setdefault(int(r["level"]), {})[int(r["token"])] = list(r["center"])
    out = []
    for lv in sorted(levels):
        toks = levels[lv]
        k = max(toks) + 1
        dim = len(next(iter(toks.values())))
        arr = np.full((k, dim), np.inf)  # a missing token can never be nearest
        for t, c in toks.items():
            arr[t] = c
        out.append(arr)
    return out


def nearest(r: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Index of the nearest center per row (lowest index on ties)."""
    finite = np.isfinite(centers).all(axis=1)
    c = np.where(finite[:, None], centers, 0.0)
    d2 = (r * r).sum(1)[:, None] - 2.0 * (r @ c.T) + (c * c).sum(1)[None, :]
    d2[:, ~finite] = np.inf
    return np.argmin(d2, axis=1)


def _assign(levels: list[np.ndarray], col: str, keep_residual: str | None, out_cols: list[str]):
    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                out = pdf[out_cols].copy()
                out["codes"] = pd.Series([], dtype=object)
                if keep_residual:
                    out[keep_residual] = pd.Series([], dtype=object)
                yield out
                continue
            r = np.stack(pdf[col].to_numpy()).astype(float)
            codes = np.zeros((len(pdf), len(levels)), dtype=np.int32)
            for lv, centers in enumerate(levels):
                t = nearest(r, centers)
                codes[:, lv] = t
                r = r - centers[t]
            out = pdf[out_cols].copy()
            out["codes"] = list(codes)
            if keep_residual:
                out[keep_residual] = list(r)
            yield out
    return run


def apply_codebooks(df: DataFrame, levels: list[np.ndarray], col: str = "features",
                    keep_residual: str | None = None, out_cols: list[str] | None = None) -> DataFrame:
    """M5 core: add ``codes array<int>`` (and optionally the final residual).

    ``out_cols`` (default: every input column) are the columns carried back out
    of the Arrow batch; leaving the vector out halves the data moved through Python.
    """
    src = df.withColumn(col, as_doubles(col))
    out_cols = list(src.columns) if out_cols is None else list(out_cols)
    fields = [src.schema[c] for c in out_cols] + [T.StructField("codes", T.ArrayType(T.IntegerType()))]
    if keep_residual:
        fields.append(T.StructField(keep_residual, T.ArrayType(T.DoubleType())))
    src = src.select(*dict.fromkeys(out_cols + [col]))
    return src.mapInPandas(_assign(levels, col, keep_residual, out_cols), T.StructType(fields))


def apply_rvq(df: DataFrame, codebook: DataFrame, col: str = "features",
              out_cols: list[str] | None = None) -> DataFrame:
    """M5: RVQ apply with a stored codebook table."""
    return apply_codebooks(df, codebook_arrays(codebook), col, out_cols=out_cols)


def fit_rvq(df: DataFrame, n_levels: int = 2, n_clusters: int = 128, max_iter: int = 200,
            n_init: int = 1, seed: int = 42, col: str = "features", tol: float = 1e-4) -> tuple[DataFrame, DataFrame, dict]:
    """M4: fit one k-means codebook per level on the running residual.

    Returns ``(codebook, codes, info)``; ``codes`` keeps every input column plus
    ``codes array<int>`` computed with the same assignment as ``apply_rvq``,
    so applying the returned codebook reproduces the codes exactly.  The
    residual of each level is checkpointed into the shared checkpoint folder.

    Every level runs ``operators.kmeans``: k-means|| seeding over all rows and Lloyd
    steps, all ``n_init`` restarts advancing in the same pass over the data.
    """
    spark: SparkSession = df.sparkSession
    residual = cut_lineage(df.select(as_doubles(col).alias("_r")))
    levels: list[np.ndarray] = []
    costs = []
    for lv in range(n_levels):
        centers, cost, _ = fit_kmeans(residual, n_clusters, max_iter, n_init, seed + lv, "_r", tol)
        levels.append(centers)
        costs.append(cost)
        if lv + 1 < n_levels:
            nxt = apply_codebooks(residual, [centers], "_r", keep_residual="_next", out_cols=[])
            residual = cut_lineage(nxt.select(F.col("_next").alias("_r")))
    codebook = spark.createDataFrame(
        [(lv, t, [float(x) for x in c]) for lv, cs in enumerate(levels) for t, c in enumerate(cs)],
        "level int, token int, center array<double>")
    codes = apply_codebooks(df, levels, col)
    return codebook, codes, {"train_cost": costs, "n_levels": n_levels, "n_clusters": n_clusters}
