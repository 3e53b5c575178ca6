"""Periodic runs of words, found through multi-scale minimizers.

A run is a stretch of consecutive words of smallest period q (words q apart are the same) and at least
``max(least, times * q)`` words, which no neighbouring word extends.  Periods up to ``SHORT`` are found by
direct scans at that lag.  Beyond, scale by scale, for periods q in (W, 2W] with W = 16, 32, 64, ...:

1. k-grams of k = 2W words are hashed by doubling, and the smallest of each W consecutive ones is marked.
   Inside a run equal k-grams stand at multiples of q only (k >= q), and windows a period apart hold the
   same k-grams, so each minimizer has its equal one exactly a period further on.
2. Equal minimizers that follow each other at a distance in (W, 2W] are seeds of that lag.  Minimizers of
   a run are at most W apart, so seeds of one lag whose k-grams touch are joined; joined seeds too short
   for a run with W words added at both ends are left out.
3. What remains is compared word by word at its lag and extended to the first difference at both ends.

A stretch that lies in a run whose period divides its own is that run again and is left out.  So the runs
found are exact but for 64-bit collisions of k-grams of one chunk, which can hide a run, never make one.

Texts are read whole, each chunk of about a megabyte (or one longer text) at a time; nothing is shuffled.
Edge cases: a null text has no words; a text without runs is returned with its words joined by one space;
repeated rows and rows without an id are judged one by one; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import hashing as H
from tokenloom.llm.common import released, small_batches

U64 = np.uint64
#: Periods up to here are found by direct scans at each lag; a power of two.
SHORT = 16
WORD = r"[^\x20\x09-\x0D]+"
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of true values."""
    edge = np.diff(same.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` (a power of two) consecutive values."""
    step = 1
    while step < width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return values


def _seeds(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Position and lag of each minimizer that is followed by its equal at a lag in (width, 2 width]."""
    low = U64((1 << max(1, (len(grams) - 1).bit_length())) - 1)
    marked = np.zeros(len(grams), dtype=bool)
    marked[(_smallest((grams & ~low) | np.arange(len(grams), dtype=U64), width) & low).astype(np.int64)] = True
    at = np.flatnonzero(marked)
    at = at[np.argsort(grams[at], kind="stable")]
    lag = np.diff(at)
    pair = (grams[at[1:]] == grams[at[:-1]]) & (lag > width) & (lag <= 2 * width)
    return at[:-1][pair], lag[pair]


def _joined(at: np.ndarray, lag: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(first, last, lag) of seeds of one lag that follow each other within ``size``."""
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    new = np.flatnonzero((np.diff(lag) != 0) | (np.diff(at) > size)) + 1
    first, last = np.append(0, new), np.append(new, len(at)) - 1
    return list(zip(at[first].tolist(), at[last].tolist(), lag[first].tolist()))


def _extended(words: np.ndarray, lo: int, hi: int, lag: int, step: int) -> tuple[int, int]:
    """lo and hi moved outwards as far as words ``lag`` apart are the same."""
    most = len(words) - lag
    while lo > 0:
        part = words[max(0, lo - step):lo] != words[max(0, lo - step) + lag:lo + lag]
        bad = np.flatnonzero(part)
        lo = max(0, lo - step) if not len(bad) else lo - len(part) + int(bad[-1]) + 1
        if len(bad):
            break
    while hi < most:
        part = words[hi:min(most, hi + step)] != words[hi + lag:min(most, hi + step) + lag]
        bad = np.flatnonzero(part)
        hi = min(most, hi + step) if not len(bad) else hi + int(bad[0])
        if len(bad):
            break
    return lo, hi


def find_runs(words: np.ndarray, longest: int | None = None, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs by start, then period.  ``longest``: no run has more words."""
    if times < 4:
        raise ValueError("times: runs of at least four periods are found")
    longest = len(words) if longest is None else longest
    found: dict[int, set[tuple[int, int]]] = defaultdict(set)
    for q in range(1, min(SHORT, longest // times) + 1):
        s, e = _stretches(words[q:] == words[:-q])
        long = e - s >= max(least - q, (times - 1) * q)
        found[q].update(zip(s[long].tolist(), (e[long] + q).tolist()))
    width, grams, size = SHORT, None, 1
    while longest >= max(least, times * (width + 1)):
        if grams is None:
            grams = H.mix64(words.astype(np.int64).view(U64) * U64(0x9E3779B97F4A7C15))
        while size < 2 * width:  # hashes of twice as many words
            grams = H.mix64(grams[:-size] * U64(0xD6E8FEB86659FD93) + (grams[size:] ^ (grams[size:] >> U64(29))))
            size *= 2
        at, lag = _seeds(grams, width)
        for first, last, q in _joined(at, lag, size) if len(at) else ():
            if last + size - first >= (times - 1) * q - 2 * (width - 1):
                lo, hi = _extended(words, first, last + size, q, width)
                s, e = _stretches(words[lo:hi] == words[lo + q:hi + q])
                long = e - s >= max(least - q, (times - 1) * q)
                found[q].update(zip((s[long] + lo).tolist(), (e[long] + lo + q).tolist()))
        width *= 2
    return _primitive(found)


def _primitive(found: dict[int, set[tuple[int, int]]]) -> list[tuple[int, int, int]]:
    """The stretches that lie in no other one whose period divides theirs."""
    spans = {q: np.array(sorted(x), dtype=np.int64).reshape(-1, 2) for q, x in found.items() if x}
    out = []
    for q, own in spans.items():
        keep = np.ones(len(own), dtype=bool)
        for d, other in spans.items():
            if d < q and q % d == 0:
                k = np.searchsorted(other[:, 0], own[:, 0], side="right") - 1
                keep &= (k < 0) | (other[k, 1] < own[:, 1])
        out += [(s, e - s, q) for s, e in own[keep].tolist()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def _scan(least: int, times: int):
    schema = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            for ids, texts in H.chunks(batch):
                split = [t.split() for t in texts]  # bytes are split at spaces, tabs and line ends only
                number = dict.fromkeys(w for words in split for w in words)
                for k, w in enumerate(number):
                    number[w] = k
                bounds = np.cumsum([0] + [len(x) + 1 for x in split])
                words = np.empty(bounds[-1], dtype=np.int64)
                for k, x in enumerate(split):  # a number of its own ends each text: no run goes beyond it
                    words[bounds[k]:bounds[k + 1] - 1] = np.fromiter(map(number.__getitem__, x), np.int64, len(x))
                    words[bounds[k + 1] - 1] = -1 - k
                runs: list[list] = [[] for _ in split]
                found = find_runs(words, max(map(len, split)), least, times)
                where = np.searchsorted(bounds, [r[0] for r in found], side="right") - 1
                for k, (start, length, period) in zip(where.tolist(), found):
                    runs[k].append({"start": start - int(bounds[k]), "length": length, "period": period})
                kept = [b" ".join(_collapsed(x, r) if r else x) for x, r in zip(split, runs)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(list(map(len, split)), pa.int64()), pa.array(runs, schema), pa.array(
                    kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])
    return run


def _collapsed(words: list[bytes], runs: list[dict]) -> list[bytes]:
    """The words without those that stand in a run behind its first period."""
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for r in runs:
        change[r["start"] + r["period"]] += 1
        change[r["start"] + r["length"]] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row ``doc_id``, ``n_words``, ``runs`` (start, length, period; by start, then period) and
    ``collapsed``: the text with each run cut down to its first period, words joined by one space."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(released(_scan(least, times)), f"doc_id {kind}, n_words bigint, runs {_RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, every tenth text (by the id's hash) made periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    own = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    own = own.withColumn("words", F.when(F.size(words) > 0, words)).withColumn("n", F.size("words"))
    own = own.withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    own = own.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    # from word a on: the first p words of that part, again and again, cut to its length
    part, rest = F.expr("slice(words, a + 1, p)"), F.col("n") - F.col("a")
    copies = F.flatten(F.array_repeat(part, F.ceil(rest / F.col("p")).cast("int")))
    text = F.concat(F.expr("slice(words, 1, a)"), F.slice(copies, F.lit(1), rest))
    return own.select("doc_id", F.when(F.col("words").isNotNull(), F.array_join(text, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """``doc_id``, ``n_runs``, the longest run (ties: smallest start, then period) and digests of the runs and the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed: Column = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    own = found.select("*", best.alias("best"))
    return own.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
                      (-F.col("best.period")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
                      F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: CRC-32 of the decimal id, by its table of 256 values, then every stretch of equal words at every lag.
ORACLE_SQL = r"""
WITH RECURSIVE bits(i, v, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT i, v FROM bits WHERE k = 8),
crc(doc_id, s, k, c) AS (
  SELECT DISTINCT doc_id, doc_id::VARCHAR, 1, 4294967295::BIGINT FROM documents
  UNION ALL SELECT doc_id, s, k + 1, xor(c >> 8, v) FROM crc JOIN tab ON i = xor(c, ascii(s[k])) & 255 WHERE k <= len(s)),
hashed AS (SELECT doc_id, xor(c, 4294967295) AS h FROM crc WHERE k = len(s) + 1),
texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
cut AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, (h // 10) % 8 AS g8
  FROM texts JOIN hashed USING (doc_id)),
words AS (
  SELECT doc_id, n, i, CASE WHEN planted AND i >= a THEN w[a + (i - a) % (1 + (n - a) // (3 + g8)) + 1] ELSE w[i + 1] END AS word
  FROM cut, unnest(range(n)) AS u(i)),
same AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same),
stretches AS (
  SELECT doc_id, q, min(i) AS s, max(i) + q + 1 AS e FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (
  SELECT doc_id, s AS start, e - s AS length, q AS period FROM stretches x WHERE NOT EXISTS (
    FROM stretches y WHERE y.doc_id = x.doc_id AND y.q < x.q AND x.q % y.q = 0 AND y.s <= x.s AND y.e >= x.e)),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS txt,
    first(start ORDER BY length DESC, start, period) AS start, first(length ORDER BY length DESC, start, period) AS length,
    first(period ORDER BY length DESC, start, period) AS period FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, i FROM runs, unnest(range(start + period, start + length)) AS u(i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS txt FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(l.txt, '')) AS runs_sha256, sha256(coalesce(k.txt, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
