"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Short test items are searched inside long documents.  A document as a whole is far larger than an
item, so its MinHash agrees with no item's; the search domains are therefore windows, partitioned by
size.  An item of 2^c to 2^(c+1)-1 shingle positions belongs to size class c.  For each class present
among the items, every document is cut into half-blocks of 2^c positions, and three half-blocks in a
row form a window: any run of the item's length lies in one window, at a Jaccard similarity of a third
to two thirds.

A document and an item are candidates when one of ``permutations`` minwise values of a window agrees
with the item's (bands of one row, as fits such similarities).  They can agree only where the item's
own minwise shingle stands in the window, so all shingle positions are first joined to the items'
minwise shingles, and a window's minimum is worked out where one was met.  Candidates are verified on
the whole sets: share of the item's distinct shingles that the document holds, at least ``percent`` %.

Only DataFrame functions.  The items' minwise values, and their whole sets, are broadcast up to ``broadcast_rows``
values of 8 bytes each (both are counted), beyond that they are joined by a shuffle.

Edge cases: null texts count as empty; texts and items under ``width`` words have no shingle and match
nothing; repeated document rows of one id give one result; rows without an id are not searched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingles(text: Column, width: int = 5) -> Column:
    """Hashes of the word shingles of a text in order; none below ``width`` words.

    One expression, in which a variable holds the words: were they a column of their own, a filter
    pushed below could put their expression into the loop over the positions."""
    words = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.transform(F.array(hashes), lambda w: F.when(F.size(w) >= width, F.transform(
        F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))).otherwise(
        F.array().cast("array<bigint>")))[0]


def _seeds(spark, n: int) -> list[int]:
    return [r[0] for r in spark.range(n).select(F.xxhash64(F.lit("permutation"), "id")).collect()]


def _array(values: list[int]) -> str:
    return "array(" + ", ".join(f"{v}L" if v != -2**63 else "bigint('-9223372036854775808')" for v in values) + ")"


def contained_items(docs: DataFrame, items: DataFrame, percent: int = 80, width: int = 5, permutations: int = 20,
                    broadcast_rows: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and item that it contains: ``doc_id``, ``item_id``, ``n_shared``, ``n_item``
    (distinct shingles) and ``containment``."""
    spark = docs.sparkSession
    seeds = _array(_seeds(spark, permutations))
    texts = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("t")).where("item_id IS NOT NULL")
    known = cut_lineage(texts.select("item_id", shingles(F.col("t"), width).alias("s"))).where("size(s) > 0").select(
        "item_id", F.expr("int(floor(log2(size(s))))").alias("class"), F.array_distinct("s").alias("s"))
    keys = known.select("item_id", "class", F.explode(F.expr(
        f"transform({seeds}, v -> named_struct('seed', v, 'key', array_min(transform(s, x -> x ^ v)) ^ v))")).alias("k")).select(
        "item_id", "class", "k.seed", "k.key")
    n_items, n_values = known.agg(F.count("*"), F.coalesce(F.sum(F.size("s")), F.lit(0))).first()
    n_keys = n_items * permutations
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).where("doc_id IS NOT NULL")
    # an item's minwise shingle must stand in a window to be its minimum: only there the window is looked at
    probes = own.select("doc_id", F.posexplode_outer(shingles(F.col("t"), width)).alias("pos", "key"))
    side = F.broadcast(keys) if n_keys <= broadcast_rows else keys
    agreed = probes.join(side, "key").groupBy("doc_id").agg(
        F.collect_set(F.struct("item_id", "class", "seed", "key", "pos")).alias("agreed"))
    full = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    size = "shiftleft(1, m.class)"
    sets = full.join(agreed, "doc_id").select("doc_id", "agreed", shingles(F.col("t"), width).alias("s")).select("doc_id", "s", F.expr(
        "transform(array(s), t -> array_distinct(transform(filter(agreed, m -> exists("
        f"sequence(greatest(m.pos div {size} - 2, 0), m.pos div {size}), b -> "
        f"array_min(transform(slice(t, int(b * {size}) + 1, 3 * {size}), y -> y ^ m.seed)) = m.key ^ m.seed)), "
        "m -> m.item_id)))[0]").alias("items"))
    # whole sets of the candidates
    each = sets.select("doc_id", "s", F.explode_outer("items").alias("item_id")).join(
        (F.broadcast(known) if n_items + n_values <= broadcast_rows else known).select("item_id", F.col("s").alias("own")), "item_id")
    counted = each.select("doc_id", "item_id", F.size(F.array_intersect("s", "own")).cast("bigint").alias("n_shared"),
                          F.size("own").cast("bigint").alias("n_item"))
    return counted.where(F.col("n_shared") * 100 >= F.col("n_item") * percent).groupBy("doc_id", "item_id").agg(
        F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item")).withColumn(
        "containment", F.col("n_shared") / F.col("n_item"))
