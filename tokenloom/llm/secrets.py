"""Secret scan with an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its content.  The ledger (a Parquet table of
``blob`` and findings, in folders by ``rule_version``, of which a run reads its own) says which blobs were scanned under which version of the
rules; a run scans each blob without such an entry once, whichever path holds it, appends it, and joins
the findings back to all paths.  Running again over old and new versions scans only what is new; a new
version of the rules scans everything once more.

The text is shuffled once, beside the ids of the rows that stand for unseen blobs; all else are
digests.  Edge cases: null texts count as empty; rows without an id and repeated rows are scanned once
by content and get a row each; an interrupted run leaves no entry of what it did not write.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULE_VERSION = "2"
#: Base kinds in their order (fixed patterns), and the least length of group 2 or of the whole match.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
BASE = ("assign", "access", "hex")
#: Further kinds: private key blocks, signed web tokens, tokens with a known beginning, random-looking strings.
_MORE = (
    ("pem", "-----BEGIN", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")),
    ("jwt", "eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("prefix", "_", re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|[sr]k_live_[A-Za-z0-9]{16,})")),
)
_LONG = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
KINDS = (*BASE, *(k for k, _, _ in _MORE), "entropy")


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; code points, end exclusive."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    for k, (_, sign, pattern) in enumerate(_MORE, len(BASE)):
        if sign in text:
            found += [(m.start(), m.end(), k) for m in pattern.finditer(text)]
    for m in _LONG.finditer(text):
        s = m.group()
        if _entropy(s) >= 4.2 and any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s):
            found.append((m.start(), m.end(), len(KINDS) - 1))
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


def _scan(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            blobs, spans = [], []
            for blob, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                blobs.append(blob)
                spans.append([{"start": s, "end": e, "kind": k} for s, e, k in find_secrets(text or "")])
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(spans, pa.list_(pa.struct(
                [("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])))], names=["blob", "spans"])


def _blob(text: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def ledger(spark, path: str) -> DataFrame:
    """The entries so far; empty without a ledger at the path."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    schema = "blob binary, spans array<struct<start:bigint,end:bigint,kind:string>>, rule_version string"
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def scan_versions(docs: DataFrame, path: str, rule_version: str = RULE_VERSION, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Scan what the ledger at ``path`` lacks and append it; then one row for each input row: ``doc_id``, ``blob``
    (hex) and ``spans`` (start, end, kind)."""
    spark = docs.sparkSession
    versions = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    paths = versions.select("doc_id", _blob("text").alias("blob"))
    known = ledger(spark, path).where(F.col("rule_version") == rule_version).select("blob")
    unseen = paths.groupBy("blob").agg(F.min("doc_id").alias("probe")).join(known, "blob", "left_anti")
    # one row stands for each unseen blob; the digest guards against ids that hold several texts
    texts = versions.join(unseen.withColumnRenamed("blob", "want"), F.col("doc_id").eqNullSafe(F.col("probe")))
    texts = texts.where(_blob("text") == F.col("want")).select("want", "text")
    found = texts.mapInArrow(_scan, "blob binary, spans array<struct<start:bigint,end:bigint,kind:string>>")
    found.groupBy("blob").agg(F.first("spans").alias("spans")).withColumn("rule_version", F.lit(rule_version)) \
        .write.mode("append").partitionBy("rule_version").parquet(path)
    entries = ledger(spark, path).where(F.col("rule_version") == rule_version).groupBy("blob").agg(F.first("spans").alias("spans"))
    return paths.join(entries, "blob").select("doc_id", F.lower(F.hex("blob")).alias("blob"), "spans")


def digests(found: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base kinds, ``base_sha256`` (digest of their spans) and ``spans`` (all, as text)."""
    base = F.col("spans.kind")
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda k: k == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in BASE),
                        F.sha2(shown(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


__all__ = ["scan_versions", "find_secrets", "digests", "ledger"]
