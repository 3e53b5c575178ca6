"""Document quality by Bradley-Terry pairwise ranking.

Preference pairs (a document marked good over one marked bad) come from all labelled rows: these are dealt into blocks
and every pair within a block counts (a single block, so all pairs, up to ``BLOCK_ROWS`` rows).  A logistic loss on the
difference of their features gives a linear score, whose scale is the log odds that one document beats another; each
Newton step is one Spark pass over the blocks.  Means, deviations and the cut are those of all labelled rows.  The cut is
a quantile of their scores, the share marked bad; scores are shifted so that it lies at ``threshold``.

Features are counted over whole texts, in numpy-free passes over bytes and words; labels, language,
source and id are not among them.  Edge cases: null texts count as empty and are scored like any text;
without labels of both kinds every score is 0.5.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.samples import held_out, known_labels
from tokenloom.operators.dictlearn import sum_partials
from tokenloom.session import cut_lineage

UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
SIGNS = b"!#$%&*@^_~|<>{}[]\\/=+"
MARKS = b".,;:!?"
FEATURES = ("words", "upper", "digits", "signs", "marks", "distinct", "top_word", "word_length", "sign_words", "upper_words",
            "bars", "lines", "same_lines", "runs", "tail_signs", "empty")


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]

    def share(signs):
        return (len(raw) - len(raw.translate(None, signs))) / size
    counts = Counter(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    signed = sum(c for w, c in counts.items() if w.translate(None, SIGNS) != w) / n
    upper = sum(c for w, c in counts.items() if w.isupper() and len(w) > 1) / n
    tail = sum(c for w, c in counts.items() if w[-1:] in (b"!", b"$", b"%", b"&", b"#", b"*")) / n
    same = sum(a == b for a, b in zip(words, words[1:])) / n
    return [math.log1p(n), share(UPPER), share(DIGITS), share(SIGNS), share(MARKS), math.log1p(len(counts)) / math.log1p(n),
            max(counts.values()) / n, math.log(size / n), signed, upper, share(b"|"), math.log(size / len(lines)),
            1 - len(set(lines)) / len(lines), same, tail, 0.0]


#: Rows of a block, and rows of the rarer kind that it has at least (some are copied into several blocks where they are too few).
BLOCK_ROWS, LEAST_RARE = 4096, 512
TILE = 1024  # good rows whose margins over a block's bad rows are worked out at once


def _sums(of):
    """Per partition the sum over its batches of what ``of`` makes of a batch's features."""
    def run(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                own = of(np.stack(pdf["x"].to_numpy()).astype(float))
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"stats": [total]})
    return run


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every feature over all rows (1 where all values are equal)."""
    n = len(FEATURES)
    s = sum_partials(rows.mapInPandas(_sums(lambda x: np.append(x.sum(axis=0), len(x))), "stats array<double>"))
    mean = s[:n] / s[n]
    dev = np.sqrt(sum_partials(rows.mapInPandas(_sums(lambda x: ((x - mean) ** 2).sum(axis=0)), "stats array<double>")) / s[n])
    dev[dev <= 1e-12 * np.maximum(1.0, np.abs(mean))] = 1.0
    return mean, dev


def _blocks(rows: DataFrame, good: int, bad: int) -> DataFrame:
    """One row a block: ``label`` and ``x`` of its rows, flat."""
    n_blocks = max(1, math.ceil((good + bad) / BLOCK_ROWS))
    copies = min(n_blocks, math.ceil(LEAST_RARE * n_blocks / min(good, bad)))
    own = F.when(F.col("label") == int(good <= bad), F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.select("label", "x", F.explode(own).alias("_c"), F.xxhash64("doc_id").alias("_h"))
    block = F.pmod(F.col("_h") + F.col("_c"), F.lit(n_blocks))
    held = dealt.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("label", "x"))).alias("r"))
    return cut_lineage(held.select(F.col("r.label").alias("label"), F.flatten("r.x").alias("x")))


def _step(w: np.ndarray, mean: np.ndarray, dev: np.ndarray):
    """Per partition: pairs, gradient and curvature of the log likelihood that the good one wins, over all pairs of its blocks."""
    n = len(w)

    def run(batches):
        pairs, grad, curve = 0, np.zeros(n), np.zeros((n, n))
        for pdf in batches:
            for label, x in zip(pdf["label"], pdf["x"]):
                z = np.clip((np.asarray(x, float).reshape(-1, n) - mean) / dev, -8, 8)
                label = np.asarray(label)
                bad = z[label == 0]
                for lo in range(0, int(label.sum()), TILE):
                    good = z[label == 1][lo:lo + TILE]
                    p = 1 / (1 + np.exp(-np.clip((good @ w)[:, None] - (bad @ w)[None, :], -30, 30)))
                    grad += good.T @ (1 - p).sum(axis=1) - bad.T @ (1 - p).sum(axis=0)
                    p *= 1 - p
                    cross = good.T @ p @ bad
                    curve += (good * p.sum(axis=1)[:, None]).T @ good + (bad * p.sum(axis=0)[:, None]).T @ bad - cross - cross.T
                    pairs += p.size
        yield pd.DataFrame({"stats": [np.concatenate([[pairs], grad, curve.ravel()])]})
    return run


def _order_value(values: DataFrame, at: float, most: int = 10_000) -> float:
    """The value (column ``v``) at position ``at`` of the order, between two of them by interpolation.  Each pass counts
    all values left in 4,096 bins and keeps the bin with the position, until at most ``most`` values are left."""
    rank = math.floor(at)
    while True:
        n, lo, hi = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
        if n <= most or lo == hi:
            break
        bin_ = F.least(F.floor((F.col("v") - lo) / ((hi - lo) / 4096)), F.lit(4095)).cast("int")
        counts = sorted(tuple(r) for r in values.groupBy(bin_.alias("b")).count().collect())
        for b, count in counts:
            if rank < count:
                break
            rank -= count
        if count == n:  # not to be told apart further
            return lo
        values = values.where(bin_ == b)
    if lo == hi:
        return lo
    held = sorted(r[0] for r in values.collect())
    after = held[min(rank + 1, len(held) - 1)]
    return held[rank] + (at - math.floor(at)) * (after - held[rank])


def fit(rows: DataFrame, ridge: float = 1e-3, rounds: int = 30):
    """Weights over standardized features, and the mean, deviation and cut that go with them, from ``doc_id``, ``x`` and
    ``label`` of all rows; only sums of 16 x 16 numbers reach the driver."""
    n = len(FEATURES)
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    good, bad = sizes.get(1, 0), sizes.get(0, 0)
    if not good + bad:
        return np.zeros(n), np.zeros(n), np.ones(n), 0.0
    mean, dev = _moments(rows)
    if not good or not bad:
        return np.zeros(n), mean, dev, 0.0
    blocks = _blocks(rows, good, bad)
    w = np.zeros(n)
    for _ in range(rounds):  # Newton steps on the logistic loss of "the good one wins"
        s = sum_partials(blocks.mapInPandas(_step(w, mean, dev), "stats array<double>"))
        pairs, grad, curve = s[0], s[1:n + 1], s[n + 1:].reshape(n, n)
        step = np.linalg.solve(curve / pairs + ridge * np.eye(n), grad / pairs - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-7:
            break

    def value(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"v": np.clip((np.stack(pdf["x"].to_numpy()).astype(float) - mean) / dev, -8, 8) @ w})
    values = cut_lineage(rows.mapInPandas(value, "v double"))
    return w, mean, dev, _order_value(values, bad / (good + bad) * (good + bad - 1))


def _feature_rows(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            rows = [features(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``x``, the features, of every row."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_feature_rows, f"doc_id {dict(own.dtypes)['doc_id']}, x array<double>")


def _learned(table: DataFrame, labels: DataFrame, label_col: str, id_col: str):
    return fit(cut_lineage(table.join(known_labels(labels, label_col, id_col), "doc_id").select("doc_id", "x", "label")))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text"):
    """The model, from every labelled document that is not held out."""
    return _learned(featured(docs, id_col, text_col), labels, label_col, id_col)


def _scored(table: DataFrame, model, threshold: float) -> DataFrame:
    w, mean, dev, cut = model
    shift = math.log(threshold / (1 - threshold)) if w.any() else 0.0

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(FEATURES))
            value = np.clip((x - mean) / dev, -8, 8) @ w - cut + shift
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(value, -30, 30))))],
                                             names=["doc_id", "score"])
    scored = table.mapInArrow(run, f"doc_id {dict(table.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def score(docs: DataFrame, model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (the cut lies at ``threshold``) and ``predicted``, for every row."""
    return _scored(featured(docs, id_col, text_col), model, threshold)


def rank_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.3, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Trained and scored on features that are worked out once."""
    table = cut_lineage(featured(docs, id_col, text_col))
    return _scored(table, _learned(table, labels, label_col, id_col), threshold)
