"""Array<double> vector expressions that stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_doubles(x: Column | str) -> Column:
    """array<float|int|double> -> array<double> as a plain cast (code-generated;
    higher-order functions such as ``transform`` are evaluated interpreted)."""
    return _c(x).cast("array<double>")


def sq_norm(x: Column | str) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda acc, v: acc + v * v)


def l2_normalize(x: Column | str, eps: float = 1e-12) -> Column:
    """X / (||x|| + eps)."""
    norm = F.sqrt(sq_norm(x)) + F.lit(eps)
    return F.transform(_c(x), lambda v: v / norm)


def round_all(x: Column | str, digits: int = 6) -> Column:
    return F.transform(_c(x), lambda v: F.round(v, digits))


def nan_to_zero(x: Column | str) -> Column:
    """P18 on an array: null or NaN element -> 0."""
    return F.transform(_c(x), lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))


def pick_indices(x: Column | str, idx: list[int]) -> Column:
    """Elements at the given 0-based positions (null when out of range)."""
    return F.array(*[F.get(_c(x), i) for i in idx]) if idx else F.array().cast("array<double>")
