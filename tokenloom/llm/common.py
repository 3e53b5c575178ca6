"""Helpers of the training-data operators: tables, group streams and connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.session import checkpoint_dir, cut_lineage  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the frame lacks (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most ``rows`` rows in an Arrow batch of this session: ten thousand long texts take too much
    memory outside the heap, once for each running task."""
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= rows:
        spark.conf.set(ARROW_ROWS, str(rows))


def buckets(df: DataFrame) -> int:
    """The number of buckets of a packed exchange: the session's shuffle partitions, which the
    cluster sizes by its input."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def groups(batches: Iterator[pa.RecordBatch], key: str, most: int = 1 << 20) -> Iterator[pa.Table]:
    """Tables of the rows of one key each, from batches sorted by the key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                part = batch.slice(start, i - start)
                if held and held[-1].column(batch.schema.get_field_index(key))[0].as_py() != keys[start]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(part)
                start = i
    if held:
        yield pa.Table.from_batches(held)


def released(run):
    """The task function, with the memory that it freed given back to the system at its end: Spark keeps
    Python workers for later tasks, and their heaps would add to the executor's for as long."""
    def inner(*args):
        try:
            yield from run(*args)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not the GNU C library
                pass
    return inner


def map_groups(df: DataFrame, key: str, fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over the rows of each key.  The groups must have a bounded size."""
    def run(batches):
        for group in groups(batches, key):
            yield from fn(group)
    return df.repartition(buckets(df), key).sortWithinPartitions(key).mapInArrow(released(run), schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest vertex reachable over the undirected edges (``a``, ``b`` bigint): ``vertex``,
    ``component_id``, for every vertex that has an edge.

    Alternates the large-star and small-star steps, so a hub of any degree needs one row per
    edge and a chain of n vertices about log n rounds.  Each round is one shuffle, written to
    the shared checkpoint folder; nothing but a row count and a checksum reaches the driver.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    pairs, before = cut_lineage(pairs), None
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        # large star: larger neighbours of a vertex go to its smallest
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .where("a <> b").distinct())
        # small star: smaller neighbours and the vertex itself go to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("low").alias("b")),
            F.struct(F.col("a").alias("a"), F.col("low").alias("b")))).alias("e"))
            .select("e.*").where("a <> b").distinct())
        pairs = cut_lineage(small)
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    star = pairs.groupBy("a").agg(F.min("b").alias("component_id"))
    roots = star.select(F.col("component_id").alias("vertex"), "component_id").distinct()
    return star.select(F.col("a").alias("vertex"), "component_id").unionByName(roots)


__all__ = ["table", "shared_path", "unused", "buckets", "small_batches", "released", "groups", "map_groups", "components", "cut_lineage", "StorageLevel"]
