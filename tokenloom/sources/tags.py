"""Tag TSV scan.

A tag file is tab separated with a header row.  Tags themselves are tab
separated too, so a track with several tags makes a row LONGER than the
header.  The reference's parser skips such rows and keeps short rows with
nulls; ``multi_tag='drop'`` reproduces that, ``'keep'`` reads every tag
field.  Columns never shift (D2) and null keys are dropped (D3).

The file is read with ``spark.read.text`` (not the CSV reader, whose
DROPMALFORMED mode would also drop short rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import GENRE_PREFIX, INSTRUMENT_PREFIX, MOOD_PREFIX, grab_tag

# Category name -> tag prefix in the tag field.
CATEGORY_PREFIX = {"genre": GENRE_PREFIX, "instrument": INSTRUMENT_PREFIX, "mood": MOOD_PREFIX}


def parse_tag_lines(lines: DataFrame, header: str, category: str,
                    multi_tag: str = "drop", line_col: str = "value") -> DataFrame:
    """Parse TSV lines (one string column) into ``track_id, path, <category>``.

    ``header`` is the header line; rows equal to it are skipped, so a
    directory of files that each carry the header reads correctly.
    """
    if multi_tag not in ("drop", "keep"):
        raise ValueError("multi_tag must be 'drop' or 'keep'")
    names = [h.strip().lower() for h in header.split("\t")]  # S3
    for need in ("track_id", "path", "tags"):
        if need not in names:
            raise ValueError(f"tag file header lacks column {need!r}: {names}")
    n = len(names)
    fields = F.split(F.col(line_col), "\t")
    rows = lines.filter(F.col(line_col) != F.lit(header)).select(fields.alias("f"))
    tag_pos = names.index("tags")
    if multi_tag == "drop":
        rows = rows.filter(F.size("f") <= n)  # S2: long rows are skipped
        tags = F.get(F.col("f"), tag_pos)
    else:
        tags = F.array_join(F.slice(F.col("f"), tag_pos + 1, 1 << 20), " ")
    out = rows.select(
        F.get(F.col("f"), names.index("track_id")).alias("track_id"),
        F.get(F.col("f"), names.index("path")).alias("path"),
        grab_tag(tags, CATEGORY_PREFIX[category]).alias(category),
    )
    return out.filter(F.col("track_id").isNotNull() & F.col("path").isNotNull())  # D3


def read_header(spark: SparkSession, path: str) -> str:
    """First line of the (first) tag file: one row to the driver."""
    head = spark.read.text(path).limit(1).collect()
    if not head:
        raise ValueError(f"empty tag file: {path}")
    return head[0][0]


def line_counts(header: str, line_col: str = "value") -> dict[str, Column]:
    """Aggregates over the lines of a tag file, its header left out: data rows, rows longer than the header
    (several tab-separated tags, skipped by default), rows shorter than the header
    (kept, missing fields null), rows without a key (dropped), rows kept."""
    names = [h.strip().lower() for h in header.split("\t")]
    n, f, data = len(names), F.split(F.col(line_col), "\t"), F.col(line_col) != F.lit(header)
    key_missing = F.get(f, names.index("track_id")).isNull() | F.get(f, names.index("path")).isNull()
    return {"n_rows": F.count_if(data), "n_long": F.count_if(data & (F.size(f) > n)), "n_short": F.count_if(data & (F.size(f) < n)),
            "n_null_key": F.count_if(data & (F.size(f) <= n) & key_missing), "n_kept": F.count_if(data & (F.size(f) <= n) & ~key_missing)}


def read_tag_tsv(spark: SparkSession, path: str, category: str, multi_tag: str = "drop",
                 header: str | None = None, watch=None) -> DataFrame:
    """``load_tag_tsv`` - one tag category file (or a folder of them).

    ``header`` may be given when a folder holds many part files; otherwise the
    first line of the first file is the header.  With ``watch`` (``store.Watch``) the lines
    are counted while they are read."""
    header = header if header is not None else read_header(spark, path)
    lines = spark.read.text(path)
    if watch is not None:
        lines = watch.on(lines, f"lines_{category}", **line_counts(header))
    return parse_tag_lines(lines, header, category, multi_tag)


def scan_report(spark: SparkSession, path: str, header: str | None = None) -> DataFrame:
    """S2/D2/D3 profile of a tag file in one aggregation (``line_counts``)."""
    header = header if header is not None else read_header(spark, path)
    return spark.read.text(path).agg(*[c.alias(name) for name, c in line_counts(header).items()])
