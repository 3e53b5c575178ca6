"""Training-set preparation (R1-R5) and ranked-candidate scoring (K5).

Every "random" choice is an md5 pick of (seed, row key, copy number, purpose),
so a prompt set is reproducible and checkable in SQL (D13).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import hash32, pick, seeded_key

# Prompt templates of the three-category training set, in order.
PROMPT_TEMPLATES_3 = [
    "recommend a song with {tags}",
    "find a track that is {tags}",
    "suggest music with {tags}",
    "what song has {tags}?",
    "which track is {tags}?",
    "play something {tags}",
    "show me {tags} music",
    "I want {tags} music",
    "looking for {tags} songs",
    "need {tags} tracks",
]
# Connectors for exactly two tag parts.
CONNECTORS = [" and ", " ", ", "]
# Prompt templates of the two-category (genre, instrument) set, in order.
PROMPT_TEMPLATES_2 = [
    "{genre} with {instrument}",
    "{instrument} playing {genre}",
    "recommend a {genre} track with {instrument}",
    "{genre} music featuring {instrument}",
    "a {instrument}-based {genre} song",
    "{genre} performed on {instrument}",
    "{instrument} in {genre} style",
    "create {genre} using {instrument}",
    "{genre} track with {instrument} sounds",
    "{instrument} rendition of {genre}",
]


def _lit_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _tag(c: str, empty_as_tag: bool) -> Column:
    col = F.col(c)
    return col if empty_as_tag else F.nullif(col, F.lit(""))


def prompt3(mood: str = "mood", genre: str = "genre", instrument: str = "instrument",
            key: Column | None = None, seed: int = 42, templates: list[str] = PROMPT_TEMPLATES_3,
            empty_as_tag: bool = False) -> Column:
    """Prompt from mood, genre and ``with <instrument>``; null when no part exists.

    ``""`` counts as missing (D6) unless ``empty_as_tag``.
    """
    key = key if key is not None else F.lit("")
    parts = F.filter(F.array(_tag(mood, empty_as_tag), _tag(genre, empty_as_tag),
                             F.concat(F.lit("with "), _tag(instrument, empty_as_tag))),
                     lambda x: x.isNotNull())
    conn = F.get(_lit_array(CONNECTORS), pick(seeded_key(seed, key, F.lit("c")), len(CONNECTORS)))
    n = F.size(parts)
    text = (F.when(n == 1, F.get(parts, 0))
            .when(n == 2, F.concat(F.get(parts, 0), conn, F.get(parts, 1)))
            .when(n >= 3, F.array_join(parts, " ")))
    tmpl = F.get(_lit_array(templates), pick(seeded_key(seed, key, F.lit("t")), len(templates)))
    return F.when(text.isNotNull(), F.replace(tmpl, F.lit("{tags}"), text))


def prompt2(genre: str = "genre", instrument: str = "instrument", key: Column | None = None,
            seed: int = 42, random_template: bool = True,
            templates: list[str] = PROMPT_TEMPLATES_2) -> Column:
    """R2: both tags required (null or empty gives no prompt)."""
    key = key if key is not None else F.lit("")
    g, i = F.col(genre), F.col(instrument)
    idx = pick(seeded_key(seed, key, F.lit("t")), len(templates)) if random_template else F.lit(0)
    tmpl = F.get(_lit_array(templates), idx)
    filled = F.replace(F.replace(tmpl, F.lit("{genre}"), g), F.lit("{instrument}"), i)
    return F.when((F.length(g) > 0) & (F.length(i) > 0), filled)


def copies(count: Column, threshold: int = 16, max_replication: int = 6) -> Column:
    """R3 rule: ``n = 1`` if ``c >= T`` else ``min(M, T div c + 1)``."""
    return F.when(count >= threshold, F.lit(1)).otherwise(
        F.least(F.lit(max_replication), F.floor(F.lit(threshold) / count).cast("int") + 1))


def upsample(df: DataFrame, id_col: str = "semantic_id", threshold: int = 16,
             max_replication: int = 6) -> DataFrame:
    """Rare IDs are replicated; adds ``id_count`` and ``rep`` (1..n).

    The per-ID counts come from a partially aggregated group-by and are joined
    back (adaptive execution splits a hot ID's partition), not from a window
    that would put a hot ID in one task.
    """
    counts = df.groupBy(id_col).agg(F.count("*").alias("id_count"))
    j = df.join(counts, id_col)
    return j.withColumn("rep", F.explode(F.sequence(F.lit(1), copies(F.col("id_count"), threshold,
                                                                       max_replication))))


def training_pairs(df: DataFrame, key_col: str = "track_id", id_col: str = "semantic_id",
                   threshold: int = 16, max_replication: int = 6, seed: int = 42,
                   two_tags: bool = False) -> DataFrame:
    """R1/R2 + R3 + W10: ``(key, rep, prompt, target)`` with null prompts dropped."""
    up = upsample(df, id_col, threshold, max_replication)
    key = F.concat_ws(":", F.col(key_col).cast("string"), F.col("rep").cast("string"))
    p = prompt2(key=key, seed=seed) if two_tags else prompt3(key=key, seed=seed)
    return (up.select(key_col, "rep", p.alias("prompt"), F.col(id_col).alias("target"))
            .filter(F.col("prompt").isNotNull()))


def split_sizes(n: int, test_size: float = 0.2, val_share: float = 0.5) -> tuple[int, int, int]:
    """R4 sizes: temp = ceil(test_size n), test = ceil(val_share temp), val = rest."""
    n_temp = math.ceil(test_size * n)
    n_test = math.ceil(val_share * n_temp)
    return n - n_temp, n_temp - n_test, n_test


def running_total(df: DataFrame, order_key: Column, weight: Column, n_buckets: int = 64) -> DataFrame:
    """``total``: the exact sum of the integer ``weight`` over all rows up to and with this one, in the order of
    ``(hash32(order_key), md5(order_key))``, without one giant partition.

    The 32-bit hash is uniform for distinct keys, so value ranges of it form
    balanced buckets: the sum of each bucket (a few rows), prefix offsets on the
    driver, and a running sum inside each bucket by a window partitioned by bucket.
    """
    keyed = df.withColumn("_h", hash32(order_key)).withColumn("_m", F.md5(order_key)).withColumn("_w", weight.cast("long")).withColumn(
        "_b", F.floor(F.col("_h") * F.lit(n_buckets) / F.lit(float(1 << 32))).cast("int"))
    sums = sorted((r["_b"], r["n"]) for r in keyed.groupBy("_b").agg(F.sum("_w").alias("n")).collect())
    offsets, run = [], 0
    for b, n in sums:
        offsets.append((b, run))
        run += n
    spark = df.sparkSession
    off = spark.createDataFrame(offsets or [(0, 0)], "_b int, _off long")
    w = Window.partitionBy("_b").orderBy("_h", "_m").rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.withColumn("_local", F.sum("_w").over(w)).join(F.broadcast(off), "_b")  # a row for each bucket
    return out.withColumn("total", F.col("_off") + F.col("_local")).drop("_h", "_m", "_w", "_b", "_local", "_off")


def global_rank(df: DataFrame, order_key: Column, n_buckets: int = 64) -> DataFrame:
    """Exact 1-based ``rank`` in the order of ``running_total``."""
    return running_total(df, order_key, F.lit(1), n_buckets).withColumnRenamed("total", "rank")


ROWS_PER_BUCKET = 2_000_000  # rows one window task sorts in global_rank


def split_exact(df: DataFrame, key: Column, seed: int = 42, test_size: float = 0.2,
                val_share: float = 0.5, n_buckets: int = 64) -> DataFrame:
    """Exact 80/10/10 split (``split`` = train/val/test) in seeded hash order.

    The bucket count grows with the row count so no bucket holds more than about
    ``ROWS_PER_BUCKET`` rows."""
    n = df.count()
    n_train, n_val, _ = split_sizes(n, test_size, val_share)
    n_buckets = max(n_buckets, math.ceil(n / ROWS_PER_BUCKET))
    ranked = global_rank(df, seeded_key(seed, key), n_buckets)
    part = (F.when(F.col("rank") <= n_train, F.lit("train"))
            .when(F.col("rank") <= n_train + n_val, F.lit("val")).otherwise(F.lit("test")))
    return ranked.withColumn("split", part)


def split_by_group(df: DataFrame, group_col: str, seed: int = 42, test_size: float = 0.2,
                   val_share: float = 0.5, n_buckets: int = 64) -> DataFrame:
    """R4 for rows that must stay together (the copies of a track): whole groups in seeded hash order, row counts as near to
    80/10/10 as groups allow.

    A weighted prefix sum over the groups puts each one on the line of all rows; it goes to the split in which its
    middle lies, so a split's size is off by at most half of the group on each of its borders.  Rows
    without a group are one group."""
    n = df.count()
    n_train, n_val, _ = split_sizes(n, test_size, val_share)
    sizes = df.groupBy(F.col(group_col).alias("_group")).agg(F.count("*").alias("_size"))
    key = seeded_key(seed, F.coalesce(F.col("_group").cast("string"), F.lit("")))
    n_buckets = max(n_buckets, math.ceil(n / ROWS_PER_BUCKET))
    placed = running_total(sizes, key, F.col("_size"), n_buckets)
    middle = 2 * F.col("total") - F.col("_size")  # twice the middle
    part = F.when(middle <= 2 * n_train, "train").when(middle <= 2 * (n_train + n_val), "val").otherwise("test")
    placed = placed.select("_group", part.alias("split"))
    return df.join(placed, F.col(group_col).eqNullSafe(F.col("_group"))).drop("_group")


def hits_at_k(candidates: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """K5: share of queries whose target is among their first k candidates
    (spaces removed from candidates); queries without candidates are misses."""
    c = candidates.filter(F.col("rank") <= k).select(
        "query_id", F.replace(F.col("candidate"), F.lit(" "), F.lit("")).alias("candidate"))
    hit = (truth.select("query_id", "target").join(c, "query_id", "left")
           .groupBy("query_id").agg(F.max((F.col("candidate") == F.col("target")).cast("int")).alias("hit")))
    return hit.agg(F.count("*").alias("n_queries"),
                   F.sum(F.coalesce(F.col("hit"), F.lit(0))).cast("long").alias("n_hits"),
                   F.avg(F.coalesce(F.col("hit"), F.lit(0)).cast("double")).alias("hits_at_k"))
