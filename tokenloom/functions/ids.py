"""Semantic-ID string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def codes_to_id(codes: Column | str) -> Column:
    """``[1, 23]`` -> ``'<001><023>'``; tokens of 4+ digits are kept whole."""
    col = F.col(codes) if isinstance(codes, str) else codes
    return F.concat_ws("", F.transform(col, lambda c: F.format_string("<%03d>", c)))


def id_second_token(target: Column | str) -> Column:
    """Plot label = second ``>``-separated piece plus ``>``."""
    col = F.col(target) if isinstance(target, str) else target
    return F.concat(F.try_element_at(F.split(col, ">"), F.lit(2)), F.lit(">"))
