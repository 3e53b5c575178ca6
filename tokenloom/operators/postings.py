"""Stored candidate index (J9, K4): posting lists of (level, token) in numbered segments.

``write_index`` stores, for every level and token, the rows that have the token there, as segments of about
``segment_rows`` rows: a token that a third of all rows share is many segments, dealt over many tasks.
Segments lie in folders by level and token bucket, so a lookup reads only the folders of its
queries' tokens; the queries meet the segments there (Spark broadcasts them while they are few), and neither the
corpus nor the whole index is shuffled.  A posting holds its row's whole codes: a row that shares several
tokens with a query is given by the first of them only, so no distinct over the results is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Counts of more tokens than this meet the rows in a shuffle join instead of a broadcast one.
FEW_TOKENS = 100_000


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("level", "token"), F.lit(buckets)).cast("int")


def write_index(coded: DataFrame, path: str, id_col: str = "id", codes_col: str = "codes", segment_rows: int = 8192,
                buckets: int = 64) -> None:
    """Store the postings and their counts below ``path``.  Null codes and null tokens are not indexed."""
    long = coded.select(F.col(id_col).alias("id"), F.col(codes_col).alias("codes"), F.posexplode(codes_col).alias("level", "token"))
    long = long.where(F.col("token").isNotNull())
    spark = coded.sparkSession
    long.groupBy("level", "token").agg(F.count("*").alias("n")).write.parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    few = counts.limit(FEW_TOKENS + 1).count() <= FEW_TOKENS
    segment = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / segment_rows)).cast("int")
    rows = long.join(F.broadcast(counts) if few else counts, ["level", "token"]).withColumn("segment", segment)
    lists = rows.groupBy("level", "token", "segment").agg(F.sort_array(F.collect_list(F.struct("id", "codes"))).alias("rows"))
    lists = lists.withColumn("bucket", _bucket(buckets)).repartition("level", "bucket", F.floor(F.col("segment") / 64))
    lists.sortWithinPartitions("level", "bucket", "token", "segment").write.partitionBy("level", "bucket").parquet(f"{path}/postings")
    spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(segment_rows).alias("segment_rows")).write.parquet(f"{path}/config")


def _asked(spark: SparkSession, path: str, queries: DataFrame, id_col: str, codes_col: str) -> tuple[DataFrame, int]:
    buckets = spark.read.parquet(f"{path}/config").first()["buckets"]
    q = queries.select(F.col(id_col).alias("qid"), F.col(codes_col).alias("qcodes"), F.posexplode(codes_col).alias("level", "token"))
    return q.where(F.col("token").isNotNull()).withColumn("bucket", _bucket(buckets)), buckets


def candidates(spark: SparkSession, path: str, queries: DataFrame, id_col: str = "id", codes_col: str = "codes") -> DataFrame:
    """``(qid, id)`` for all indexed rows that share a token with the query at any level, each once, the query's own id
    excluded."""
    q, _ = _asked(spark, path, queries, id_col, codes_col)
    postings = spark.read.parquet(f"{path}/postings")
    # the folders of the queries' tokens: at most levels x buckets pairs
    wanted = q.select("level", "bucket").distinct().collect()
    by_level: dict[int, list[int]] = {}
    for r in wanted:
        by_level.setdefault(r["level"], []).append(r["bucket"])
    inside = F.lit(False)
    for level, own in sorted(by_level.items()):
        inside = inside | ((F.col("level") == level) & F.col("bucket").isin(sorted(own)))
    hit = postings.where(inside).join(q, ["level", "bucket", "token"])
    each = hit.select("qid", "qcodes", "level", F.explode("rows").alias("row"))
    first = F.array_position(F.zip_with(F.col("row.codes"), F.col("qcodes"), lambda a, b: F.coalesce(a == b, F.lit(False))), True) - 1
    return each.where((first == F.col("level")) & (F.col("row.id") != F.col("qid"))).select("qid", F.col("row.id").alias("id"))


def candidate_bounds(spark: SparkSession, path: str, queries: DataFrame, id_col: str = "id", codes_col: str = "codes") -> DataFrame:
    """``(qid, at_least, at_most)``: bounds on the number of rows that share a token with the query (its own row, if indexed,
    included), from the stored counts alone."""
    q, _ = _asked(spark, path, queries, id_col, codes_col)
    counts = spark.read.parquet(f"{path}/counts")
    own = q.join(counts, ["level", "token"]).groupBy("qid").agg(F.max("n").alias("at_least"), F.sum("n").alias("at_most"))
    out = queries.select(F.col(id_col).alias("qid")).join(own, "qid", "left")
    return out.select("qid", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("at_least", "at_most")))
