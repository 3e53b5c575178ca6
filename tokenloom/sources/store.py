"""Table persistence (S6-S10): Parquet by default, CSV with header on request.

Models are small tables (codebook, dictionary, config); data tables keep
``features array<double>`` and only turn wide at the CSV sink.
"""

from __future__ import annotations

import json
from typing import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, write_shared_bytes


def _fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def table_exists(spark: SparkSession, path: str) -> bool:
    """A stored table is complete when its ``_SUCCESS`` marker exists."""
    try:
        return _fs_exists(spark, path.rstrip("/") + "/_SUCCESS")
    except Exception:  # no JVM handle (Spark Connect): a readable table counts as complete
        try:
            spark.read.format("binaryFile").load(path.rstrip("/") + "/_SUCCESS").limit(1).collect()
            return True
        except Exception:
            return False


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    if fmt == "csv":
        write_csv(df, path, mode)
    else:
        df.write.mode(mode).format(fmt).save(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    if not table_exists(spark, path):
        raise FileNotFoundError(f"no stored table at {path}")
    if fmt == "csv":
        return read_csv(spark, path, schema)
    return spark.read.format(fmt).load(path)


def widen(df: DataFrame, names: list[str], col: str = "features") -> DataFrame:
    """Array column -> one double column per catalog name (for the CSV sink)."""
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, *[F.get(F.col(col), i).alias(n) for i, n in enumerate(names)])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header; array columns are written as JSON text."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("array", "struct", "map"):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    df.select(*cols).write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV with header; an empty field reads back as null."""
    r = spark.read.option("header", True)
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def _made_path(path: str) -> str:
    return path.rstrip("/") + ".made.json"


def is_current(spark: SparkSession, path: str, made: dict) -> bool:
    """Whether the stored table is complete and was made with the parameters ``made``."""
    if not table_exists(spark, path) or not _fs_exists(spark, _made_path(path)):
        return False
    rows = spark.read.option("wholetext", "true").text(_made_path(path)).collect()
    return bool(rows) and rows[0][0] == json.dumps(made, sort_keys=True)


def materialize(spark: SparkSession, path: str, builder: Callable[[], DataFrame],
                fmt: str = "parquet", rebuild: bool = False, made: dict | None = None) -> DataFrame:
    """Reuse the stored table when complete (``_SUCCESS``), else build and store it.

    With ``made`` (the parameters that shape the table, those of earlier stages included)
    a table stored under other parameters, or under unknown ones, is built anew.
    Reading back the written table also cuts the lineage of the builder plan.
    """
    fresh = table_exists(spark, path) if made is None else is_current(spark, path, made)
    if rebuild or not fresh:
        if made is not None:
            delete_path(spark, _made_path(path))
        write_table(builder(), path, fmt)
        if made is not None:
            write_shared_bytes(spark, _made_path(path), json.dumps(made, sort_keys=True).encode())
    return read_table(spark, path, fmt)


class Watch:
    """Counts of the rows that pass through a job, taken while it runs (``DataFrame.observe``): no scan of their own."""

    def __init__(self) -> None:
        self.parts: dict[str, Observation] = {}

    def on(self, df: DataFrame, stage: str, **metrics: Column) -> DataFrame:
        """``df``, whose rows are counted by the aggregates ``metrics`` when it is computed."""
        self.parts[stage] = Observation()
        return df.observe(self.parts[stage], *[c.alias(name) for name, c in metrics.items()])

    def rows(self) -> list[tuple[str, str, int]]:
        """(stage, metric, value), after the job."""
        return [(stage, name, int(value or 0)) for stage, seen in self.parts.items() for name, value in seen.get.items()]


METRICS_SCHEMA = "stage string, metric string, value long"


def materialize_watched(spark: SparkSession, path: str, builder: Callable[[Watch], DataFrame], rebuild: bool = False,
                        made: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """``materialize`` with counts: the stored table and its metrics ``(stage, metric, value)``, taken by the job that wrote it
    and stored beside it, so a reused table has them too."""
    metrics = path.rstrip("/") + ".metrics"
    watch = Watch()
    current = (table_exists(spark, path) if made is None else is_current(spark, path, made)) and table_exists(spark, metrics)
    df = materialize(spark, path, lambda: builder(watch), rebuild=rebuild or not current, made=made)
    if watch.parts:
        write_table(spark.createDataFrame(watch.rows(), METRICS_SCHEMA).coalesce(1), metrics)
    return df, read_table(spark, metrics)


def write_splits(df: DataFrame, path: str, split_col: str = "split", splits=("train", "val", "test")) -> None:
    """Each split of a training set as CSV with header under ``path/<split>``; ``df`` should be
    a stored table (it is read once per split)."""
    for name in splits:
        write_csv(df.filter(F.col(split_col) == name).drop(split_col), f"{path.rstrip('/')}/{name}")


def read_splits(spark: SparkSession, path: str, schema, split_col: str = "split", splits=("train", "val", "test")) -> DataFrame:
    """The stored splits together, with their names."""
    parts = [read_table(spark, f"{path.rstrip('/')}/{name}", "csv", schema).withColumn(split_col, F.lit(name)) for name in splits]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- models (S8, S9) --------------------------------------------------------

def save_model(spark: SparkSession, root: str, name: str, tables: dict[str, DataFrame]) -> None:
    for part, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}/{part}")


def load_model(spark: SparkSession, root: str, name: str, parts: list[str]) -> dict[str, DataFrame]:
    out = {}
    for part in parts:
        p = f"{root.rstrip('/')}/{name}/{part}"
        if not table_exists(spark, p):
            raise FileNotFoundError(f"no saved model part {name}/{part} under {root}")
        out[part] = spark.read.parquet(p)
    return out
