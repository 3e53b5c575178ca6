"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import conversations, languages, licenses, periods, pii, quality, secrets, toxicity, vectors
from tokenloom.llm.common import shared_path, table

#: Key of the registered queries; a deployment passes its own.
PII_KEY = "registered-query"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn
    return add


@query("op1_license_scan", licenses.oracle_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


@query("op2_pii_pseudonyms")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, PII_KEY)


OP3_SQL = r"""
WITH texts AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT 'doc' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'item', item_id, text FROM benchmark)),
words AS (SELECT kind, id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM texts WHERE len(w) >= 5),
rolled AS (
  SELECT kind, id, n, pos,
    string_agg(word, ' ') OVER (PARTITION BY kind, id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM words),
shingles AS (SELECT DISTINCT kind, id, s FROM rolled WHERE pos <= n - 4),
sizes AS (SELECT id, count(*) AS n_item FROM shingles WHERE kind = 'item' GROUP BY id),
shared AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
  FROM shingles d JOIN shingles i ON d.s = i.s AND d.kind = 'doc' AND i.kind = 'item' GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM shared JOIN sizes ON item_id = id WHERE n_shared * 100 >= n_item * 80
"""


@query("op3_decontamination", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.llm.containment import contained_items
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_quality_ranking")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rank_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP5_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM texts),
rolled AS (
  SELECT doc_id, n, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s
  FROM words),
shingles AS (SELECT DISTINCT doc_id, s FROM rolled WHERE pos <= greatest(n - 4, 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.x, reach.r FROM reach JOIN links l ON l.y = reach.doc_id)
SELECT doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""


@query("op5_near_duplicates", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.llm.setjoin import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_secret_ledger")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_versions(table(spark, sf_dir, "documents"), shared_path(spark, "secret-ledger"))
    return secrets.digests(found)


OP7_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
    AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach(vec_id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.x, reach.r FROM reach JOIN links l ON l.y = reach.vec_id),
counted AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(max(n), 0)::BIGINT AS n_links, min(r) AS component_id, vec_id = min(r) AS kept
FROM reach LEFT JOIN counted ON x = vec_id GROUP BY vec_id
"""


@query("op7_near_vectors", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op8_toxicity_lexicon")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


OP9_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)),
windows AS (
  SELECT doc_id, pos, word,
    CASE WHEN count(*) OVER ahead = 13 THEN string_agg(word, ' ') OVER ahead END AS win
  FROM words WINDOW ahead AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
firsts AS (SELECT win, min(doc_id) AS low FROM windows WHERE win IS NOT NULL GROUP BY win),
marked AS (
  SELECT w.doc_id, w.pos, w.word,
    max(CASE WHEN f.low < w.doc_id THEN 1 ELSE 0 END)
      OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
  FROM windows w LEFT JOIN firsts f ON w.win = f.win),
summed AS (
  SELECT doc_id, count(*) AS n, sum(gone) AS gone,
    coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0), '') AS kept
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_words, coalesce(s.gone, 0)::BIGINT AS n_removed,
  sha256(coalesce(s.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN summed s USING (doc_id)
"""


@query("op9_substring_dedup", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.llm.substrings import dedup_substrings
    return dedup_substrings(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


@query("op10_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.llm.bpe import encode, read_vocabulary
    return encode(table(spark, sf_dir, "documents"), read_vocabulary(), digest=True)


@query("op11_language_mixture")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return languages.identify(docs, languages.learn(docs))


@query("op12_periodic_runs", periods.ORACLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periods.planted(table(spark, sf_dir, "documents"))
    return periods.digests(periods.periodic_runs(docs))


@query("op13_conversation_repair", conversations.ORACLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.digests(*conversations.repair(rows, "present"))


__all__ = ["QUERIES", "ORACLE_SQL", "F"]
