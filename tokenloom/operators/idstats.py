"""Code and semantic-ID statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def code_distribution(df: DataFrame, codes_col: str = "codes", vocab: int | None = None) -> DataFrame:
    """Distinct tokens used per level (and the share of the vocabulary)."""
    long = df.select(F.posexplode(codes_col).alias("level", "token"))
    out = long.groupBy("level").agg(F.count_distinct("token").alias("n_tokens"))
    if vocab:
        out = out.withColumn("usage", F.col("n_tokens") / F.lit(float(vocab)))
    return out


def id_diversity(df: DataFrame, id_col: str = "semantic_id", approx: bool = False) -> DataFrame:
    """Distinct IDs / rows (``approx`` uses HyperLogLog++ instead of an exact distinct)."""
    distinct = F.approx_count_distinct(id_col) if approx else F.count_distinct(id_col)
    return df.agg(distinct.alias("n_ids"), F.count("*").alias("n_rows")).withColumn(
        "diversity", F.try_divide(F.col("n_ids").cast("double"), F.col("n_rows")))


def id_counts(df: DataFrame, id_col: str = "semantic_id") -> DataFrame:
    """Rows per ID (partial aggregation absorbs a hot ID)."""
    return df.groupBy(id_col).agg(F.count("*").alias("n"))


def occupancy(df: DataFrame, id_col: str = "semantic_id") -> DataFrame:
    """A10: UniqueIDs, MeanPerID, SingletonPct."""
    c = id_counts(df, id_col)
    return c.agg(F.count("*").alias("unique_ids"),
                  F.avg("n").alias("mean_per_id"),
                  F.avg((F.col("n") == 1).cast("double")).alias("singleton_pct"))


def exact_median(values: DataFrame, col: str) -> DataFrame:
    """Exact median of an integer column without gathering the values in one task.

    The histogram ``(value, count)`` has one row per distinct value (for rows
    per ID that is a few hundred rows at most), so the cumulative window over it
    is small; the two middle positions are averaged for an even count.
    """
    hist = values.groupBy(F.col(col).alias("v")).agg(F.count("*").alias("c"))
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("hi", F.sum("c").over(w)).withColumn("lo", F.col("hi") - F.col("c") + 1)
    pos = (cum.withColumn("t", F.sum("c").over(Window.partitionBy()))
           .withColumn("p1", F.floor((F.col("t") + 1) / 2)).withColumn("p2", F.floor(F.col("t") / 2) + 1))
    hit = pos.filter(((F.col("lo") <= F.col("p1")) & (F.col("p1") <= F.col("hi")))
                     | ((F.col("lo") <= F.col("p2")) & (F.col("p2") <= F.col("hi"))))
    both = hit.agg(
        F.max(F.when((F.col("lo") <= F.col("p1")) & (F.col("p1") <= F.col("hi")), F.col("v"))).alias("a"),
        F.max(F.when((F.col("lo") <= F.col("p2")) & (F.col("p2") <= F.col("hi")), F.col("v"))).alias("b"))
    return both.select(((F.col("a") + F.col("b")) / 2.0).alias("median"))


def occupancy_detail(df: DataFrame, id_col: str = "semantic_id") -> DataFrame:
    """A10 plus median rows per ID and the singleton count."""
    c = id_counts(df, id_col)
    summary = c.agg(F.count("*").alias("unique_ids"),
                    F.avg("n").alias("mean_per_id"),
                    F.count_if(F.col("n") == 1).alias("n_singletons"),
                    F.avg((F.col("n") == 1).cast("double")).alias("singleton_pct"))
    med = exact_median(c, "n").select(F.col("median").alias("median_per_id"))
    # two one-row results side by side: a union + max keeps it free of any join
    a = summary.withColumn("median_per_id", F.lit(None).cast("double"))
    b = med.select(F.lit(None).cast("long").alias("unique_ids"), F.lit(None).cast("double").alias("mean_per_id"),
                   F.lit(None).cast("long").alias("n_singletons"), F.lit(None).cast("double").alias("singleton_pct"),
                   F.col("median_per_id").cast("double").alias("median_per_id"))
    return a.unionByName(b).agg(*[F.max(x).alias(x) for x in a.columns])


def top_ids(df: DataFrame, n: int = 10, id_col: str = "semantic_id") -> DataFrame:
    """A11 tail / T3: the n most common IDs (ties by ID)."""
    return id_counts(df, id_col).orderBy(F.desc("n"), F.asc(id_col)).limit(n)


def vocab_check(df: DataFrame, vocab: int, codes_col: str = "codes") -> DataFrame:
    """Tokens outside the ``<000>..<vocab-1>`` vocabulary."""
    long = df.select(F.explode(codes_col).alias("token"))
    return long.agg(F.count("*").alias("n_tokens"),
                    F.count_if(F.col("token") >= vocab).alias("n_out_of_vocab"),
                    F.max("token").alias("max_token"),
                    F.lit(vocab).alias("vocab"))
