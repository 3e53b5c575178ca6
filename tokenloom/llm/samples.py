"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column) -> Column:
    """Rows kept out of all training: those with crc32 of the id's text divisible by 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def known_labels(labels: DataFrame, label_col: str, id_col: str) -> DataFrame:
    """``doc_id``, ``label`` (0 or 1) of every labelled id that is not held out.  An id with contradicting labels counts as 1."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    return known.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``text``, ``label`` (0 or 1) of at most ``rows`` labelled documents that are not held out:
    those with the smallest hash of their id.  An id with contradicting labels counts as 1."""
    known = known_labels(labels, label_col, id_col)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.join(F.broadcast(known), "doc_id").select("doc_id", "text", "label")  # at most ``rows`` rows of 12 bytes
