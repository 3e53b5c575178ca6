"""The corpus pipeline: ``documents`` to token ids, in five stages of one training-data operator each.

A stage takes ``(spark, docs, sf_dir)`` and returns the rows it keeps, or rewrites, with the columns of
``docs``; the last one adds the tokens.  ``run`` writes each stage's rows as Parquet into the cluster's
shared folder and reads them back for the next, so a lost executor costs no more than one stage's tasks.
A stage's copy of the corpus is deleted when the next one is complete; the last one stays, the result reads it.

Rows without a ``doc_id`` pass the stages that compare documents; null texts count as empty; rows that
share an id are judged by their own texts (those with equal texts are dropped or kept together); further columns of any
name are carried along, only the last stage replaces columns called ``n_tokens``, ``ids``, ``decoded`` or ``round_trip``.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import bpe, containment, pii, setjoin, toxicity
from tokenloom.llm.common import shared_path, table, unused
from tokenloom.session import delete_path

#: Score from which a document is rejected as toxic.
TOXIC = 0.5
#: Similarity (percent) of the five-word shingle sets from which documents are near duplicates.
SIMILAR = 80
#: Share (percent) of a test item's shingles from which a document counts as contaminated.
CONTAINED = 80
#: Session setting with the key of the pseudonyms.  Without it each run draws a key of its own: its pseudonyms can't be
#: turned back or linked with another run's.
KEY_SETTING = "spark.tokenloom.pseudonymKey"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score, by a lexicon learned from the labels, is below ``TOXIC``."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "toxicity")
    return toxicity.score_rows(docs, lexicon, score_col=score).where(F.col(score) < TOXIC).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    digest = unused(docs, "digest")
    groups = setjoin.near_duplicates(docs, percent=SIMILAR, digest=True)
    gone = groups.where(~F.col("kept")).select("doc_id", F.col("digest").alias(digest)).distinct()
    return docs.withColumn(digest, F.xxhash64("text")).join(gone, ["doc_id", digest], "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    found = containment.contained_items(docs, table(spark, sf_dir, "benchmark"), percent=CONTAINED)
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by pseudonyms."""
    key = spark.conf.get(KEY_SETTING, None) or secrets.token_hex(16)
    return pii.pseudonymize(docs, key).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ``n_tokens``, ``ids`` and ``round_trip``: whether the text decoded from the ids is the text."""
    keep = tuple(c for c in docs.columns if c not in ("n_tokens", "ids", "decoded", "round_trip"))
    encoded = bpe.encode(docs, bpe.read_vocabulary(), keep=keep)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return encoded.select(*keep, "n_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", hide_private),
    ("bpe", tokenize),
]

#: The stages learn, hash and tokenize, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder, before = table(spark, sf_dir, "documents"), shared_path(spark, "corpus-pipeline"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete_path(spark, before)
        before = f"{folder}/{name}"
    return docs
