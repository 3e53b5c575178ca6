"""Feature-matrix operators: column statistics (A15), standardization (M1),
Gram/covariance (A16) and PCA (M2, M3).

Vectors are ``array<double>`` columns.  Statistics are aggregations with
map-side partial aggregation; only model-sized results (d means, d stds,
a d x d covariance, d x k loadings) ever reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import as_doubles

MAX_MODEL_DIM = 4096  # d x d covariance and d-long literals stay model-sized


def _elements(column) -> tuple[np.ndarray, np.ndarray]:
    """Position in its list and value of every non-null element of an Arrow list column; null lists have none."""
    lists = column.drop_null()
    size = np.diff(lists.offsets.to_numpy())
    values = lists.flatten()
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    there = values.is_valid().to_numpy(zero_copy_only=False)
    return at[there], values.filter(values.is_valid()).to_numpy()


def _column_sums(d: int, center: np.ndarray | None):
    """Per partition one array: the number of values and their sum by position, or the squares of their distances to ``center``."""
    import pyarrow as pa

    def run(batches):
        out = np.zeros(2 * d)
        for batch in batches:
            at, v = _elements(batch.column(0))
            out[:d] += np.bincount(at, minlength=d)
            out[d:] += np.bincount(at, v if center is None else (v - center[at]) ** 2, minlength=d)
        yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], names=["stats"])
    return run


def column_stats(df: DataFrame, col: str = "features") -> DataFrame:
    """Per-dimension mean and population std of the non-null values: ``(idx, mean, std, n)``.

    Two passes (sums, then squares around the mean, which keeps the digits), each with one array per partition summed in a
    tree: no element becomes a row.  A dimension without values has null mean and std."""
    from .dictlearn import sum_partials

    vec = df.select(as_doubles(col).alias("v"))
    d = df.agg(F.max(F.size(F.col(col)))).first()[0] or 0
    if d > MAX_MODEL_DIM:
        raise ValueError(f"feature width {d} exceeds {MAX_MODEL_DIM}")
    schema = "idx int, mean double, std double, n long"
    if d <= 0:
        return df.sparkSession.createDataFrame([], schema)
    first = sum_partials(vec.mapInArrow(_column_sums(d, None), "stats array<double>"))
    n = first[:d]
    mean = np.divide(first[d:], n, out=np.zeros(d), where=n > 0)
    second = sum_partials(vec.mapInArrow(_column_sums(d, mean), "stats array<double>"))
    std = np.sqrt(np.divide(second[d:], n, out=np.zeros(d), where=n > 0))
    rows = [(i, float(mean[i]), float(std[i]), int(n[i])) if n[i] else (i, None, None, 0) for i in range(d)]
    return df.sparkSession.createDataFrame(rows, schema)


def vector_stats(df: DataFrame, col: str = "features") -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and population std of complete vectors, and their number, in one summary of
    whole vectors (no element becomes a row)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    s = df.select(Summarizer.metrics("mean", "variance", "count").summary(
        array_to_vector(as_doubles(col))).alias("s")).select("s.*").first()
    n = int(s["count"]) if s["count"] else 0
    if not n:
        return np.zeros(0), np.zeros(0), 0
    return s["mean"].toArray(), np.sqrt(s["variance"].toArray() * (n - 1) / n), n


@dataclass
class Scaler:
    mean: np.ndarray
    scale: np.ndarray  # population std, 0 replaced by 1

    def apply(self, df: DataFrame, col: str = "features", out: str | None = None) -> DataFrame:
        """Element-wise ``(x_i - mean_i) / std_i`` as d code-generated expressions
        (about twice as fast as a ``transform`` lambda, which Spark interprets)."""
        out = out or col
        x = as_doubles(col)
        z = F.array(*[(F.get(x, i) - F.lit(float(m))) / F.lit(float(s))
                      for i, (m, s) in enumerate(zip(self.mean, self.scale))])
        return df.withColumn(out, z)


def fit_scaler(df: DataFrame, col: str = "features") -> Scaler:
    """M1 fit: population statistics; a zero std divides by 1 (two d-long vectors to the
    driver).  Rows hold no nulls here (P18 fills them before)."""
    mean, std, _ = vector_stats(df, col)
    if len(mean) > MAX_MODEL_DIM:
        raise ValueError(f"feature width {len(mean)} exceeds {MAX_MODEL_DIM}")
    return Scaler(mean, np.where(std == 0.0, 1.0, std))


def standardize(df: DataFrame, col: str = "features", out: str | None = None) -> tuple[DataFrame, Scaler]:
    """M1: ``(x - mean) / std`` with population std."""
    scaler = fit_scaler(df, col)
    return scaler.apply(df, col, out), scaler


# ---- Gram / covariance (A16) -------------------------------------------------

def _partial_gram(width: int, col: str):
    def run(batches):
        acc = np.zeros((width, width))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[col].to_numpy()).astype(float)
                acc += x.T @ x
        yield pd.DataFrame({"stats": [acc.ravel()]})
    return run


def gram_long(df: DataFrame, col: str = "features", normalize: bool = True, fanout: int = 64) -> DataFrame:
    """``(i, j, value)`` of X^T X (divided by n when ``normalize``).

    Each partition multiplies its own block with BLAS and emits ONE array of d*d
    partial sums; arrays are summed in ``fanout`` groups, then together.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    first = df.select(F.size(col).alias("d")).limit(1).collect()
    if not first:
        raise ValueError("empty input")
    d = int(first[0]["d"])
    if d > MAX_MODEL_DIM:
        raise ValueError(f"feature width {d} exceeds {MAX_MODEL_DIM}")
    vec = df.select(as_doubles(col).alias(col))
    part = vec.mapInPandas(_partial_gram(d, col), "stats array<double>")
    grouped = part.groupBy(F.pmod(F.spark_partition_id(), F.lit(fanout)).alias("g")).agg(
        Summarizer.sum(array_to_vector("stats")).alias("s"))
    g = grouped.agg(Summarizer.sum(F.col("s")).alias("s")).select(F.posexplode(vector_to_array("s")).alias("at", "value")).select(
        F.floor(F.col("at") / d).cast("int").alias("i"), (F.col("at") % d).cast("int").alias("j"), "value")
    if normalize:
        n = df.count()
        g = g.withColumn("value", F.col("value") / F.lit(float(n)))
    return g


# ---- PCA (M2, M3) -------------------------------------------------------------

@dataclass
class PcaModel:
    mean: np.ndarray          # d
    components: np.ndarray    # d x k, sign-fixed
    ratio: np.ndarray         # explained variance ratio of every fitted component

    @property
    def k(self) -> int:
        return self.components.shape[1]

    def variance_table(self, spark: SparkSession) -> DataFrame:
        """S8 second table: ``(component, ratio, cumulative)``."""
        cum = np.cumsum(self.ratio)
        rows = [(i, float(r), float(c)) for i, (r, c) in enumerate(zip(self.ratio, cum))]
        return spark.createDataFrame(rows, "component int, ratio double, cumulative double")

    def transform(self, df: DataFrame, col: str = "features", out: str = "pca") -> DataFrame:
        """Scores ``(x - mean) @ components`` in Arrow batches (BLAS per batch)."""
        mean, comp = self.mean, self.components

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def project(s: pd.Series) -> pd.Series:
            if len(s) == 0:
                return pd.Series([], dtype=object)
            x = np.stack(s.to_numpy()).astype(float)
            y = (x - mean) @ comp
            return pd.Series(list(y))

        return df.withColumn(out, project(as_doubles(col)))


def _fix_signs(components: np.ndarray) -> np.ndarray:
    """Hard part 4: the largest-magnitude loading of every component is positive."""
    idx = np.argmax(np.abs(components), axis=0)
    signs = np.sign(components[idx, np.arange(components.shape[1])])
    signs[signs == 0] = 1.0
    return components * signs


def fit_pca(df: DataFrame, col: str = "features", k: int | None = None,
            ratio: float | None = None) -> PcaModel:
    """M2 (fixed ``k``) or M3 (smallest k whose cumulative ratio exceeds ``ratio``).

    The covariance is accumulated by MLlib's PCA (tree aggregation of the
    Gramian on the executors); the d x d eigen-problem runs on the driver,
    which is model-sized (d <= a few hundred features).
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    # one statistics pass gives the width and the mean for the scores
    mean, _, _ = vector_stats(df, col)
    d = len(mean)
    if d == 0 or d > MAX_MODEL_DIM:
        raise ValueError(f"feature width {d} outside 1..{MAX_MODEL_DIM}")
    vec = df.select(array_to_vector(as_doubles(col)).alias("v"))
    model = PCA(k=d, inputCol="v", outputCol="p").fit(vec)
    pc = model.pc.toArray()
    ratios = model.explainedVariance.toArray()
    if k is None:
        if ratio is None:
            raise ValueError("give k or ratio")
        cum = np.cumsum(ratios)
        k = int(min(np.searchsorted(cum, ratio, side="right") + 1, d))
    k = max(1, min(int(k), d))
    return PcaModel(mean, _fix_signs(pc[:, :k]), ratios[:k])
