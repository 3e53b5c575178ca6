"""Samples and plot-input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash32, seeded_key
from ..functions.tags import is_tagged
from .tags import in_top, top_counts


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all) in seeded md5 order of ``key``.

    Planned as a top-n (each partition keeps n rows, then one merge), never
    a full sort.
    """
    k = seeded_key(seed, key)
    return df.orderBy(hash32(k), F.md5(k)).limit(n)


def plot_input(df: DataFrame, label_col: str, score_col: str, key: str, top: int = 5,
               cap: int = 1000, seed: int = 42, n_dims: int = 3) -> DataFrame:
    """Rows labelled with one of the ``top`` labels, capped at ``cap`` rows,
    with the first ``n_dims`` scores."""
    labeled = df.filter(is_tagged(label_col))
    tops = top_counts(labeled, label_col, top)
    kept = in_top(labeled, label_col, tops)
    capped = hash_sample(kept, key, cap, seed)
    return capped.select(key, label_col, *[F.get(F.col(score_col), i).alias(f"pc{i + 1}") for i in range(n_dims)])


def preview(df: DataFrame, n: int = 5, order: list[str] | None = None) -> DataFrame:
    """The first rows in the order of the given columns (a top-n), or any (a limit; nothing else is computed)."""
    return df.orderBy(*order).limit(n) if order else df.limit(n)
