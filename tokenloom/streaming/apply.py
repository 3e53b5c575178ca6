"""Stateless model application on streaming DataFrames.

A stored codebook or dictionary is a small, fixed model, so applying it is a
per-row map: the same functions serve batch and streaming DataFrames.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions.ids import codes_to_id
from ..functions.vectors import as_doubles
from ..operators.dictlearn import sparse_codes
from ..operators.rvq import apply_codebooks
from ..session import checkpoint_dir


#: Files of a micro-batch: a table of many part files is no long row of small jobs.
FILES_PER_BATCH = 64


def stream_rvq_ids(stream: DataFrame, levels: list[np.ndarray], col: str = "features") -> DataFrame:
    """Streaming M5 + M11: adds ``codes`` and ``semantic_id``."""
    return apply_codebooks(stream, levels, col).withColumn("semantic_id", codes_to_id("codes"))


def stream_dictionary_ids(stream: DataFrame, atoms: np.ndarray, n_nonzero: int,
                          col: str = "features") -> DataFrame:
    """Streaming M10 + M11."""
    return sparse_codes(stream, atoms, n_nonzero, col).withColumn("semantic_id", codes_to_id("codes"))


def stream_codes(spark: SparkSession, folder: str, levels: list[np.ndarray],
                 pattern: str = "embeddings.parquet") -> DataFrame:
    """Run the streaming apply over the tables of ``folder`` matching ``pattern`` (files, or
    folders of part files) until caught up, and return the result.

    The coded rows go to a Parquet table below the session's shared checkpoint folder
    (no row passes the driver), beside the stream's own checkpoint; every micro-batch
    is an ordinary Spark job.
    """
    tables = f"{folder.rstrip('/')}/{{{pattern}}}"  # always a glob: a stream's plain path may be no single file
    schema = spark.read.parquet(tables).schema
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(tables)
              .select("vec_id", as_doubles("embedding").alias("features")))
    coded = stream_rvq_ids(stream, levels).select("vec_id", "codes", "semantic_id")
    name = "rvq_stream_" + uuid.uuid4().hex[:12]
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    q = (coded.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
         .option("checkpointLocation", f"{ckpt}/state").start(f"{ckpt}/rows"))
    q.awaitTermination()
    return spark.read.schema(coded.schema).parquet(f"{ckpt}/rows")


def stream_documents_jsonl(spark: SparkSession, folder: str, path_field: str = "path",
                           doc_field: str = "doc"):
    """New JSON-lines document files arriving in ``folder`` as ``(rel_path, doc variant)``."""
    from pyspark.sql import functions as F
    lines = spark.readStream.format("text").load(folder)
    v = F.try_parse_json(F.col("value"))
    return lines.select(F.try_variant_get(v, f"$.{path_field}", "string").alias("rel_path"),
                        F.try_variant_get(v, f"$.{doc_field}", "variant").alias("doc")) \
        .filter(F.col("rel_path").isNotNull())


def stream_track_ids(spark: SparkSession, doc_folder: str, tags: DataFrame, features, scaler, pca,
                     levels: list[np.ndarray]) -> DataFrame:
    """Semantic IDs for tracks whose documents arrive as a stream, with stored models.

    Stream-static inner join of the documents with the tag table (J5), one catalog
    projection, missing values filled (P18), the stored scaler (M1) and PCA (M2/M3),
    then the stored codebook (M5) and the ID string (M11).  Every step is stateless,
    so each micro-batch is an ordinary Spark job and no state store is needed.
    """
    from pyspark.sql import functions as F

    from ..functions.vectors import nan_to_zero
    from ..sources.documents import json_name
    docs = stream_documents_jsonl(spark, doc_folder)
    keyed = tags.withColumn("rel_path", json_name("path"))
    joined = docs.join(keyed, "rel_path")
    feats = joined.select("track_id", nan_to_zero(features.vector(F.col("doc"))).alias("features"))
    z = scaler.apply(feats, "features")
    scores = pca.transform(z, "features", "pca").select("track_id", F.col("pca").alias("features"))
    return stream_rvq_ids(scores, levels).select("track_id", "codes", "semantic_id")
