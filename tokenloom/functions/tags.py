"""Tag column expressions (P1, W1-W4, W8 predicates)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three tag prefixes of the tag files.
GENRE_PREFIX = "genre---"
INSTRUMENT_PREFIX = "instrument---"
MOOD_PREFIX = "mood/theme---"
TAG_SEPARATOR = "---"


def grab_tag(tags: Column | str, prefix: str) -> Column:
    """First whitespace token starting with ``prefix``; text after the prefix.

    A null field, or a field with no matching token, gives ``""``.
    """
    col = F.col(tags) if isinstance(tags, str) else tags
    tokens = F.split(F.trim(col), r"\s+")
    hits = F.filter(tokens, lambda t: t.startswith(prefix))
    first = F.get(hits, 0)
    return F.coalesce(F.substring(first, len(prefix) + 1, 1 << 30), F.lit(""))


def is_tagged(c: Column | str) -> Column:
    """Non-empty tag test; null counts as empty."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.length(col) > 0, F.lit(False))


def n_tagged(cols: list[str]) -> Column:
    """Number of non-empty tag columns in a row."""
    total = F.lit(0)
    for c in cols:
        total = total + is_tagged(c).cast("int")
    return total


def split_tags(c: Column | str) -> Column:
    """Multi-label tag text -> array of labels, empty labels removed."""
    col = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(col, TAG_SEPARATOR), lambda t: F.length(t) > 0)
