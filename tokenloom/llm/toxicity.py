"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding.

Texts are folded (case, look-alike letters of other scripts, invisible signs, digits and signs that
stand for letters inside a word) and matched in one pass against all terms: whole words, or stems that
a word begins with.  A hit inside an exception phrase doesn't count.  The score is a logistic function
of the weight of the hits and of the length, so that one hit weighs less in a long text.

The lexicon can be given or learned: from a bounded sample of labelled rows, one document of each
group that shares a minwise shingle, terms are taken that occur in toxic documents significantly more
often than in others (log likelihood ratio, corrected for the number of terms tried) and at least
``least_lift`` times as often; a term's weight is its log odds.  Words that
precede a hit in several clean documents and in no toxic one become exception phrases.

Edge cases: null texts count as empty; a text without words has no hit and is scored by its length 0;
without toxic rows in the sample every score is that of the sample's rate.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tokenloom.llm import hashing as H
from tokenloom.llm.common import released, small_batches
from tokenloom.llm.samples import held_out, labelled

#: Letters of other scripts that look like Latin ones (fixed values).
LOOK_ALIKE = dict(zip("аеорсухіјѕһԁԛԝкмтвнαορνικτυχεη", "aeopcyxijshdqwkmtbhaopviktuxen"))
INVISIBLE = "­​‌‍⁠﻿"
#: Digits and signs that stand for letters inside a word.
STAND_IN = dict(zip("013457@$", "oieastas"))
_FOLD = str.maketrans(LOOK_ALIKE | {c: None for c in INVISIBLE})
_INNER = re.compile(r"(?<=[^\W\d_])[013457@$]+(?=[^\W\d_])")
_OTHER = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalnum()})
_CACHE: dict = {}


def fold(text: str | None) -> str:
    """The words of the text, folded, each with a space before and behind."""
    t = (text or "").lower()
    if not t.isascii():
        t = t.translate(_FOLD)
    t = _INNER.sub(lambda m: "".join(STAND_IN[c] for c in m.group()), t)
    return f" {' '.join(t.translate(_OTHER).split())} "


@dataclass
class Lexicon:
    """``terms``: term to weight; a term ``" word "`` is a whole word, ``" stem"`` begins one.
    ``exceptions``: folded phrases, whose hits don't count.  ``curve``: bias, and factors of the hits' weight and the length."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-3.0, 2.0, -0.3)
    key: int = field(default=0)

    def automaton(self):
        key = (tuple(sorted(self.terms.items())), self.exceptions)
        if key not in _CACHE:
            import ahocorasick
            a = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                a.add_word(term, (len(term), weight, term))
            for phrase in self.exceptions:
                a.add_word(phrase, (len(phrase), None, phrase))
            if len(a):
                a.make_automaton()
            _CACHE[key] = a
        return _CACHE[key]

    def hits(self, folded: str) -> list[tuple[int, int, float, str]]:
        """(start, end, weight, term) of the hits outside exception phrases."""
        a = self.automaton()
        if not len(a):
            return []
        found = [(end - n + 1, end + 1, w, t) for end, (n, w, t) in a.iter(folded)]
        free = sorted((s, e) for s, e, w, _ in found if w is None)
        starts, reach = [s for s, _ in free], list(accumulate((e for _, e in free), max))  # the furthest end of those that start up to here

        def excepted(start: int, end: int) -> bool:
            k = bisect_right(starts, start)
            return k > 0 and reach[k - 1] >= end
        return [h for h in found if h[2] is not None and not excepted(h[0], h[1])]


def measures(lexicon: Lexicon, text: str | None) -> tuple[float, float]:
    """The hits' weight, a word counted once however many terms it has, and the length; both as logarithms."""
    folded = fold(text)
    best: dict[int, float] = {}
    for start, _, w, _ in lexicon.hits(folded):
        best[start] = max(best.get(start, 0.0), w)
    return math.log1p(sum(best.values())), math.log1p(folded.count(" ") - 1)


def terms_of(folded: str, least: int = 3, most: int = 7) -> set[str]:
    words, out = set(folded.split()), set()
    for w in words:
        out.add(f" {w} ")
        for n in range(least, min(most, len(w)) + 1):
            out.add(f" {w[:n]}")
    return out


def _sketched(batches):
    for batch in batches:
        for ids, texts, labels in H.chunks(batch, columns=3):
            words, counts = H.hashed_words(texts, lower=True)
            at, sketch = 0, []
            for n in counts.tolist():
                s = H.shingle_set(words[at:at + n], 5)
                sketch.append(int(s[0]) >> 1 if len(s) else 0)
                at += n
            yield pa.RecordBatch.from_arrays([pa.array([t.decode("utf-8", "surrogatepass") for t in texts], pa.string()), pa.array(
                labels, pa.int32()), pa.array(sketch, pa.int64())], names=["text", "label", "sketch"])


def _term_counts(batches):
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                (toxic if label else clean).update(terms_of(fold(text)))
            if len(toxic) + len(clean) > 150_000:
                yield _counted(toxic, clean)
                toxic, clean = Counter(), Counter()
    yield _counted(toxic, clean)


def _counted(toxic: Counter, clean: Counter) -> pa.RecordBatch:
    terms = list(toxic.keys() | clean.keys())
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array(
        [clean[t] for t in terms], pa.int64())], names=["term", "toxic", "clean"])


def _ratio(x: int, y: int, n: int, m: int) -> float:
    """Log likelihood ratio of x in n against y in m."""
    def part(k, all_, p):
        return (k * math.log(p) if k else 0.0) + ((all_ - k) * math.log(1 - p) if all_ - k else 0.0)
    p, own, other = (x + y) / (n + m), x / n, y / m
    if own <= other:
        return 0.0
    return 2 * (part(x, n, own) + (part(y, m, other) if 0 < other < 1 else 0.0) - part(x, n, p) - part(y, m, p)) \
        if 0 < own < 1 else 2 * ((part(y, m, other) if 0 < other < 1 else 0.0) - part(x, n, p) - part(y, m, p))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", rows: int = 20_000, most_terms: int = 1000,
          least_docs: int = 3, least_lift: float = 12.0, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """A lexicon from at most ``rows`` labelled documents, of at most ``most_terms`` terms.  Candidate terms with
    their counts (at most 20 for each term kept) and the sample's measures reach the driver."""
    small_batches(docs.sparkSession)
    sample = labelled(docs, labels, label_col, rows, id_col, text_col).mapInArrow(released(_sketched), "text string, label int, sketch bigint")
    sample = sample.groupBy("sketch", "label").agg(F.min("text").alias("text")).select("text", "label").persist()
    try:
        sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
        n, m = sizes.get(1, 0), sizes.get(0, 0)
        if not n or not m:
            return Lexicon({}, (), (math.log((n + 0.5) / (m + 0.5)), 0.0, 0.0))
        counts = sample.mapInArrow(released(_term_counts), "term string, toxic bigint, clean bigint").groupBy("term").agg(
            F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).persist()
        tried = counts.where(f"toxic >= {least_docs}").count()
        best = counts.where((F.col("toxic") >= least_docs) & (F.col("toxic") * m > least_lift * F.col("clean") * n)).orderBy(
            F.desc(F.col("toxic") - F.col("clean") * n / m), "term").limit(20 * most_terms).collect()
        counts.unpersist()
        need = 2 * math.log(max(2, tried)) + 6
        ranked = []
        for r in best:
            weight = math.log((r["toxic"] + 0.5) / (n + 1) * (m + 1) / (r["clean"] + 0.5))
            g = _ratio(r["toxic"], r["clean"], n, m)
            if g >= need and weight >= math.log(least_lift):
                ranked.append((g, len(r["term"]), r["term"], r["toxic"], weight))
        terms = {t[2]: t[-1] for t in _pick(sorted(ranked, reverse=True), most_terms)}
        lexicon = Lexicon(terms, _exceptions(sample, Lexicon(terms)))
        found = sample.mapInArrow(released(_measured(lexicon)), "a double, b double, label int").orderBy("a", "b", "label").collect()
        lexicon.curve = _fit_curve(np.array([(r["a"], r["b"]) for r in found]), np.array([r["label"] for r in found]))
        return lexicon
    finally:
        sample.unpersist()


def _pick(ranked: list[tuple], most: int) -> list[tuple]:
    """Terms in order of rank, without those that a stem already picked says as well (or that say as well as the
    words they begin)."""
    picked: dict[str, tuple] = {}
    begun: dict[str, int] = {}  # beginnings of picked terms: most documents of one
    for t in ranked:
        term, docs, weight = t[2:]
        stems = [term[:n] for n in range(3, len(term) + 1)]
        if len(picked) < most and not any(x in picked and picked[x][-1] >= weight - 0.5 for x in stems) \
                and begun.get(term, 0) < 0.9 * docs:
            picked[term] = t
            for x in stems:
                begun[x] = max(begun.get(x, 0), docs)
    return list(picked.values())


def _exceptions(sample: DataFrame, lexicon: Lexicon, least: int = 5, most: int = 500) -> tuple[str, ...]:
    """Phrases of a word and a hit, in at least ``least`` clean documents and no toxic one."""
    def run(batches):
        for batch in batches:
            phrases, label = [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded, seen = fold(text), set()
                for start, end, _, term in lexicon.hits(folded):
                    before = folded.rfind(" ", 0, start)
                    if before >= 0:
                        stop = end if term.endswith(" ") else folded.index(" ", end - 1) + 1
                        seen.add(folded[before:stop])
                phrases += seen
                label += [y] * len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(label, pa.int32())], names=["phrase", "label"])
    found = sample.mapInArrow(released(run), "phrase string, label int").groupBy("phrase").agg(
        F.sum("label").alias("toxic"), F.count("*").alias("n")).where(f"toxic = 0 AND n >= {least}").orderBy(F.desc("n"), "phrase").limit(most)
    return tuple(r["phrase"] for r in found.collect())


def _measured(lexicon: Lexicon):
    def run(batches):
        for batch in batches:
            rows = [measures(lexicon, t) for t in batch.column(0).to_pylist()]
            a, b = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.float64()), pa.array(b, pa.float64()), batch.column(1)], names=["a", "b", "label"])
    return run


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float, float]:
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(z) + ridge * np.eye(3), z.T @ (y - p) / len(z) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


def score_rows(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The input with its score; a column of that name is replaced."""
    small_batches(docs.sparkSession)
    bias, hit, length = lexicon.curve
    own = docs.drop(score_col)
    at, names = own.columns.index(text_col), [*own.columns, score_col]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x = np.array([measures(lexicon, t) for t in part.column(at).to_pylist()]).reshape(-1, 2)
                value = bias + x @ np.array([hit, length])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(value, -30, 30))))], names=names)
    return own.mapInArrow(released(run), StructType([*own.schema.fields, StructField(score_col, DoubleType())]))


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` (score at least ``threshold``), for every row."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return score_rows(own, lexicon).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                           (F.col("score") >= threshold).cast("int").alias("predicted"))
