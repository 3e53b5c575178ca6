"""Derived inputs for the registered queries: every one is a Spark projection of
the given tables (``part``, ``embeddings``, ``events``, ``documents``,
``labels``), so each query's work grows with the data.

Stand-ins (see FIXTURES.md): ``part`` rows are tracks with genre = p_type,
mood = first word of p_name, instrument = p_brand; ``embeddings`` rows are
feature vectors with a 10-class label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_leaf import CHROMATIC_SCALE
from ..functions.vectors import as_doubles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def track_keys(p: DataFrame) -> list[Column]:
    return [F.concat(F.lit("track_"), F.col("p_partkey").cast("string")).alias("track_id"),
            F.concat(F.lit("mp3/"), F.col("p_partkey").cast("string"), F.lit(".mp3")).alias("path")]


def tag_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Three category tables with partial overlap (a track is in one, two or three of them)."""
    p = table(spark, sf_dir, "part")
    return {
        "genre": p.filter(F.col("p_size") <= 35).select(*track_keys(p), F.lower("p_type").alias("genre")),
        "mood": p.filter(F.col("p_size") >= 15).select(
            *track_keys(p), F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)).alias("mood")),
        "instrument": p.filter(F.col("p_size").between(10, 45)).select(
            *track_keys(p), F.lower("p_brand").alias("instrument")),
    }


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", as_doubles("embedding").alias("features"))


def id_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks with tags and a semantic ID derived from brand and size (R1-R4 input)."""
    p = table(spark, sf_dir, "part")
    brand_no = F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2)).cast("int")
    return p.select(
        "p_partkey",
        F.when(F.col("p_size") >= 8, F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)))
        .otherwise(F.lit("")).alias("mood"),
        F.when(F.col("p_size") <= 44, F.lower("p_type")).otherwise(F.lit("")).alias("genre"),
        F.when(F.col("p_retailprice") >= 905, F.lower("p_brand")).otherwise(F.lit("")).alias("instrument"),
        F.format_string("<%03d><%03d>", brand_no, (F.col("p_size") / 10).cast("int")).alias("semantic_id"),
    )


def multi_label_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``---``-joined multi-label tags per track (A7/W6/S11 input)."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("track_id"),
        F.replace(F.col("p_name"), F.lit(" "), F.lit("---")).alias("mood"),
        F.lower("p_type").alias("genre"),
        F.concat_ws("---", F.lower("p_brand"),
                    F.when(F.col("p_size") > 40, F.lower("p_type"))).alias("instrument"),
    )


TAG_HEADER = "TRACK_ID\tARTIST_ID\tPATH\tTAGS"


def _doc_struct(v, label):
    """A feature document (full-run leaves) rendered from one 64-value embedding."""
    g = lambda i: F.get(v, i)
    diag = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: F.transform(
        F.sequence(F.lit(0), F.lit(12)), lambda j: F.when(i == j, F.get(v, i + 13) * F.get(v, i + 13))
        .otherwise(F.lit(0.0))))
    keys = F.array(*[F.lit(k) for k in CHROMATIC_SCALE])
    return F.struct(
        F.struct(F.struct(F.slice(v, 1, 13).alias("mean"), diag.alias("cov")).alias("mfcc"),
                 F.struct(F.slice(v, 47, 13).alias("mean")).alias("gfcc"),
                 F.struct(g(26).alias("mean")).alias("spectral_centroid"),
                 F.struct(g(46).alias("mean")).alias("spectral_flux"),
                 F.struct(g(47).alias("mean")).alias("spectral_spread"),
                 F.struct(g(48).alias("mean")).alias("spectral_skewness"),
                 F.struct(g(49).alias("mean")).alias("spectral_kurtosis"),
                 F.struct(g(50).alias("mean")).alias("spectral_rms"),
                 F.struct(g(51).alias("mean")).alias("erbbands_spread"),
                 F.struct(g(52).alias("mean")).alias("erbbands_flatness_db"),
                 F.struct(g(53).alias("mean")).alias("erbbands_crest"),
                 F.struct(g(54).alias("mean")).alias("dissonance"),
                 F.abs(g(55)).alias("average_loudness"),
                 F.struct((g(56) * g(56)).alias("var")).alias("spectral_complexity"),
                 F.struct(g(57).alias("mean")).alias("spectral_entropy"),
                 F.struct(F.slice(v, 28, 6).alias("mean")).alias("spectral_contrast_coeffs"),
                 F.struct(F.slice(v, 34, 6).alias("mean")).alias("spectral_contrast_valleys"),
                 F.struct(g(40).alias("mean")).alias("barkbands_skewness"),
                 F.struct(g(41).alias("mean")).alias("barkbands_kurtosis")).alias("lowlevel"),
        F.struct((F.lit(100.0) + g(39) * 50).alias("bpm"), F.abs(g(43)).alias("onset_rate"),
                 F.abs(g(58)).alias("danceability"),
                 F.struct(g(44).alias("mean"), (g(45) * g(45)).alias("var")).alias("beats_loudness"))
        .alias("rhythm"),
        F.struct(F.struct(F.transform(F.slice(v, 1, 36), lambda x: F.abs(x)).alias("mean")).alias("hpcp"),
                 F.get(keys, F.pmod(label, F.lit(12))).alias("key_key"),
                 F.when(F.pmod(label, F.lit(2)) == 0, F.lit("major")).otherwise(F.lit("minor")).alias("key_scale"),
                 F.abs(g(42)).alias("key_strength"),
                 F.struct(g(59).alias("mean")).alias("hpcp_entropy"),
                 g(60).alias("tuning_equal_tempered_deviation")).alias("tonal"))


def render_corpus(spark: SparkSession, sf_dir: str, root: str) -> dict[str, str]:
    """Write the reference's on-disk inputs, derived by Spark from ``part`` and ``embeddings``:
    three tag TSV folders (partial overlap, multi-tag rows longer than the header, rows
    without a tag) and a JSON-lines feature-document dump for tracks that have an embedding.
    Returns the paths; nothing passes through the driver."""
    root = root.rstrip("/")
    p = table(spark, sf_dir, "part")
    tk = track_keys(p)
    pid = F.col("p_partkey").cast("string")
    fields = {
        "genre": (F.col("p_size") <= 35, [F.concat(F.lit("genre---"), F.lower("p_type"))],
                  F.col("p_size") > 33),
        "mood": (F.col("p_size") >= 15, [F.concat(F.lit("mood/theme---"), F.split_part("p_name", F.lit(" "),
                                                                                     F.lit(1)))], None),
        "instrument": (F.col("p_size").between(10, 45),
                       [F.concat(F.lit("instrument---"), F.lower("p_brand"))], None),
    }
    paths = {}
    for cat, (keep, tag, second) in fields.items():
        extra = (F.when(second, F.concat(F.lit(cat + "---"), F.split_part("p_name", F.lit(" "), F.lit(2))))
                 if second is not None else F.lit(None).cast("string"))
        tag_field = F.when(F.col("p_size") % 9 == 0, F.lit(None).cast("string")).otherwise(tag[0])
        line = F.concat_ws("\t", tk[0], F.concat(F.lit("artist_"), pid), tk[1], tag_field, extra)
        lines = spark.createDataFrame([(TAG_HEADER,)], "value string").unionByName(
            p.filter(keep).select(line.alias("value")))
        paths[cat] = f"{root}/tags/{cat}"
        lines.write.mode("overwrite").text(paths[cat])
    e = table(spark, sf_dir, "embeddings")
    doc = F.to_json(F.struct(F.concat(F.lit("mp3/"), F.col("vec_id").cast("string"), F.lit(".json")).alias("path"),
                             _doc_struct(F.col("embedding").cast("array<double>"), F.col("label")).alias("doc")))
    paths["docs"] = f"{root}/docs"
    e.select(doc.alias("value")).write.mode("overwrite").text(paths["docs"])
    return paths
