"""Deterministic, seedable picks and orders from md5 of a key.

The same numbers come out of DuckDB with
``('0x' || substr(md5(key), 1, 8))::BIGINT``, which keeps every random-looking
choice reproducible and checkable in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(seed: int | str, *parts: Column | str) -> Column:
    cols = [F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]
    return F.concat_ws(":", F.lit(str(seed)), *cols)


def hash32(key: Column) -> Column:
    """First 32 bits of md5(key) as a non-negative bigint."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def pick(key: Column, n: int | Column) -> Column:
    """Uniform-looking choice in [0, n)."""
    n_col = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(hash32(key), n_col.cast("bigint")).cast("int")
