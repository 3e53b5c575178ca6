"""Language identification by multilingual mixture inference.

A text's words are draws from a mixture of languages.  A word's likelihood in a language is that of its character n-grams
(one to three characters, the word's edges among them; mean over the three orders of the sums of log probabilities).
Expectation-maximisation estimates the text's language proportions; languages without a noticeable share go at once, the
others one by one from the smallest as long as the penalised likelihood (``penalty`` times half the logarithm of the
number of words for each language) doesn't fall.  The set that is left, with its proportions, is the result.

N-gram counts are learned from about ``rows`` documents of each language (those whose id's hash is under a bound; a
word counts once a document), hashed into a fixed number of buckets and smoothed towards the mean of the languages.  The model has at
most 4 million numbers however many languages there are, and is the only thing to reach the driver and all tasks.  Scoring is one
pass over whole texts, with all texts of a chunk of about a megabyte in the same EM steps; nothing is shuffled.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; rows without an id or a language teach nothing but
are scored; equal likelihoods go to the language that comes first; without any labelled row all is ``und``; repeated
rows are scored alike; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import hashing as H
from tokenloom.llm.common import released, small_batches

UNKNOWN = "und"
ORDERS = (1, 2, 3)
#: Numbers of a model (languages x orders x buckets), and languages, at most.
MODEL_VALUES, MAX_LANGUAGES = 1 << 22, 1000
#: Words: no spaces, no ASCII but letters.
_WORD = re.compile(r"[^\s\x00-\x40\x5B-\x60\x7B-\x7F]+")
_LETTER = re.compile(r"[^\W\d_]")


def held_out(id_col: Column) -> Column:
    """Rows kept out of the training: those whose id's crc32 leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    languages: list[str]
    bits: int
    logs: np.ndarray  # (orders x buckets) x languages: log probabilities

    @classmethod
    def of(cls, languages: list[str], bits: int, counts: np.ndarray, strength: float = 500.0) -> "Model":
        """Counts by (order, bucket) and language, smoothed by ``strength`` draws from the mean of all languages."""
        logs = np.zeros(counts.shape, dtype=np.float32)
        for k in range(len(ORDERS)):
            part = slice(k << bits, (k + 1) << bits)
            own = counts[part].astype(float)
            total = own.sum(axis=0)
            mean = (own / np.maximum(total, 1)).mean(axis=1, keepdims=True) * 0.99 + 0.01 / (1 << bits)
            logs[part] = np.log((own + strength * mean) / (total + strength))
        return cls(languages, bits, logs)


def _grams(words: list[str], bits: int):
    """For each order the buckets of the n-grams of the words, and the bounds of each word's n-grams."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.array(list(map(len, words)), dtype=np.int64)
    start = np.cumsum(size + 1) - size  # of each word in the codes
    for k, n in enumerate(ORDERS):
        value = np.full(len(codes) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            value = H.mix64(value * np.uint64(0x9E3779B97F4A7C15) + codes[i:len(codes) - n + 1 + i])
        lo = start if n == 1 else start - 1
        yield (value >> np.uint64(64 - bits)).astype(np.int64) + (k << bits), lo, lo + size + (0 if n == 1 else 3 - n)


def _split(texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words with a letter; (text, word, times) of each text's distinct words by text; and which texts have a letter."""
    split = [_WORD.findall(t.decode("utf-8", "surrogatepass").lower()) for t in texts]
    number = {w: k for k, w in enumerate(dict.fromkeys(w for words in split for w in words if w.isalpha() or _LETTER.search(w)))}
    words = list(number)
    flat = [[number[w] for w in words_ if w in number] for words_ in split]
    sizes = np.array(list(map(len, flat)), dtype=np.int64)
    key = np.repeat(np.arange(len(texts)), sizes) * max(1, len(words)) + np.array([k for x in flat for k in x], dtype=np.int64)
    key, times = np.unique(key, return_counts=True)
    return words, key // max(1, len(words)), key % max(1, len(words)), times, sizes > 0


def _likelihoods(model: Model, words: list[str]) -> np.ndarray:
    out = np.zeros((len(words), len(model.languages)))
    for at, lo, hi in _grams(words, model.bits):
        for lang in range(out.shape[1]):
            sums = np.concatenate([[0.0], np.cumsum(model.logs[at, lang], dtype=float)])
            out[:, lang] += sums[hi] - sums[lo]
    return out / len(ORDERS)


class _Mixtures:
    """The rows (text, word, times) of some texts, and EM over all of them at once."""

    def __init__(self, ll: np.ndarray, text: np.ndarray, times: np.ndarray, n: int):
        self.top = ll.max(axis=1)
        self.like = np.exp(ll - self.top[:, None])
        self.text, self.times = text, times.astype(float)
        self.start = np.searchsorted(text, np.arange(n))  # each text has a row
        self.total = np.add.reduceat(self.times, self.start)

    def fit(self, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Shares after EM from the given ones (zeros stay zeros), and the log likelihood of each text."""
        for _ in range(rounds):
            joint = self.like * share[self.text]
            joint *= (self.times / np.maximum(joint.sum(axis=1), 1e-300))[:, None]
            new = np.add.reduceat(joint, self.start, axis=0) / self.total[:, None]
            moved, share = np.abs(new - share).max(), new
            if moved < 1e-4:
                break
        mass = np.maximum((self.like * share[self.text]).sum(axis=1), 1e-300)
        return share, np.add.reduceat(self.times * (np.log(mass) + self.top), self.start)

    def only(self, texts: np.ndarray) -> "_Mixtures":
        """Those of some texts (numbers in order)."""
        keep = np.zeros(len(self.start), dtype=bool)
        keep[texts] = True
        rows, out = keep[self.text], object.__new__(_Mixtures)
        out.top, out.like, out.times = self.top[rows], self.like[rows], self.times[rows]
        out.text = (np.cumsum(keep) - 1)[self.text[rows]]
        out.start, out.total = np.searchsorted(out.text, np.arange(len(texts))), self.total[texts]
        return out


def _cut(share: np.ndarray, lost: np.ndarray) -> np.ndarray:
    share = np.where(lost, 0.0, share)
    return share / share.sum(axis=1, keepdims=True)


def mixtures(ll: np.ndarray, text: np.ndarray, times: np.ndarray, n: int, penalty: float = 2.0, least: float = 0.02, rounds: int = 25) -> np.ndarray:
    """Shares (texts x languages) of the set of languages with the best penalised likelihood.  ``ll``: log likelihoods of each row's word;
    ``text``: the row's text, ascending, each of the n texts with a row at least; ``times``: how often the text has the word."""
    all_ = _Mixtures(ll, text, times, n)
    share, _ = all_.fit(np.full((n, ll.shape[1]), 1 / ll.shape[1]), rounds)
    small = share < np.minimum(least, share.max(axis=1, keepdims=True))
    share, like = all_.fit(_cut(share, small), rounds)
    price = penalty * 0.5 * np.log1p(all_.total)
    open_ = np.flatnonzero((share > 0).sum(axis=1) > 1)
    while len(open_):
        part, own = all_.only(open_), share[open_]
        last = np.where(own > 0, own, 2.0)
        # of equal shares the language that comes last goes first
        last = last.shape[1] - 1 - np.argmin(last[:, ::-1], axis=1)
        tried, now = part.fit(_cut(own, np.arange(own.shape[1]) == last[:, None]), rounds)
        better = now + price[open_] >= like[open_]
        won = open_[better]
        share[won], like[won] = tried[better], now[better]
        open_ = won[(share[won] > 0).sum(axis=1) > 1]
    return share


# ---- in Spark ---------------------------------------------------------------------------

def _counted(languages: list[str], bits: int):
    number = {lang: k for k, lang in enumerate(languages)}

    def emit(counts: dict[int, np.ndarray]):
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), lang), pa.int32()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())],
                                             names=["lang", "gram", "n"])

    def run(batches):
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for langs, texts in H.chunks(batch):
                words, text, word, _, _ = _split(texts)
                if not words:
                    continue
                lang_of = np.array([number[x] for x in langs])[text]
                grams = list(_grams(words, bits))
                for lang in np.unique(lang_of).tolist():
                    weight = np.bincount(word[lang_of == lang], minlength=len(words))  # documents of the language with the word
                    own = counts.setdefault(lang, np.zeros(len(ORDERS) << bits, dtype=np.int64))
                    for at, lo, hi in grams:
                        change = np.bincount(lo, weight, len(at) + 1) - np.bincount(hi, weight, len(at) + 1)
                        own += np.bincount(at, np.cumsum(change[:-1]), len(own)).astype(np.int64)
            if len(counts) > 32:
                yield from emit(counts)
                counts = {}
        yield from emit(counts)
    return run


def learn(docs: DataFrame, rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from about ``rows`` documents of each language, none of them held out."""
    spark = docs.sparkSession
    small_batches(spark)
    key = F.col(id_col).cast("string")
    own = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    own = own.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(key), F.lit(1 << 32)).alias("hash"))
    sizes = {r["lang"]: r["count"] for r in own.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], 10, np.zeros((len(ORDERS) << 10, 0), dtype=np.float32))
    bits = min(16, max(10, (MODEL_VALUES // (len(ORDERS) * len(languages))).bit_length() - 1))
    rate = spark.createDataFrame([(k, -(-(rows << 32) // n)) for k, n in sizes.items()], "lang string, bound bigint")
    sample = own.join(F.broadcast(rate), "lang").where("hash < bound").select("lang", "text")  # a row a language
    found = sample.mapInArrow(released(_counted(languages, bits)), "lang int, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(ORDERS) << bits, len(languages)), dtype=np.int64)
    counts[found["gram"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
    return Model.of(languages, bits, counts)


def _scored(model: Model, penalty: float):
    names = np.array([*model.languages, UNKNOWN], dtype=object)

    def run(batches):
        for batch in batches:
            for ids, texts in H.chunks(batch):
                words, text, word, times, letters = _split(texts)
                shares = np.zeros((len(texts), len(model.languages)))
                if words and model.languages:
                    with_ = np.flatnonzero(letters)
                    shares[with_] = mixtures(_likelihoods(model, words)[word], (np.cumsum(letters) - 1)[text], times, len(with_), penalty)
                top = np.argmax(shares, axis=1) if model.languages else np.zeros(len(texts), dtype=np.int64)
                score = shares.max(axis=1, initial=0.0)
                pred = names[np.where(score > 0, top, len(model.languages))]
                order = np.argsort(-shares, axis=1, kind="stable")
                sets = [[k for k in row if own[k] > 0] for row, own in zip(order.tolist(), shares)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, batch.column(0).type), pa.array(pred.tolist(), pa.string()), pa.array(np.minimum(score, 1.0)),
                    pa.array([names[x].tolist() for x in sets], pa.list_(pa.string())),
                    pa.array([own[x].tolist() for x, own in zip(sets, shares)], pa.list_(pa.float64()))], names=["doc_id", "lang_pred", "score", "languages", "shares"])
    return run


def identify(docs: DataFrame, model: Model, penalty: float = 2.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row ``doc_id``, ``held_out``, ``lang_pred`` (the language of the largest share), ``score`` (that share), and the set found:
    ``languages`` with their ``shares``, largest first."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(own.dtypes)["doc_id"]
    out = own.mapInArrow(released(_scored(model, penalty)), f"doc_id {kind}, lang_pred string, score double, languages array<string>, shares array<double>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages", "shares")
