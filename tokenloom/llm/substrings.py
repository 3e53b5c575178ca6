"""Substring deduplication by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of ``(window + 1) // 2`` words; any
window of ``window`` words holds one whole block of each text that it occurs in.  All rolling
windows of block length probe the index of reference blocks, and each hit is extended over the
``window``-word sequences around it, confirmed by a second exchange of their own fingerprints.
Runs of confirmed windows are the maximal exact repeats.

The exchanges carry packed arrays: a task sends each bucket one row of the fingerprints of its
documents, distinct within a document, so a passage that a third of all documents share costs
one small entry a document.  No pairs of documents are formed: an index entry only needs the
smallest document id.  The text is shuffled once, by document id.

Edge cases: null and empty texts have no words; a document without an id neither takes nor gives
repeats and keeps its words; rows that share an id are one document for the order (a window of
its own id never removes) and give a row each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import hashing as H
from tokenloom.llm.common import buckets

_PACKED = "bucket int, docs binary, counts binary, found binary, anchors binary"
_REPLY = "place int, docs binary, found binary"
_EMPTY = pa.RecordBatch.from_pydict({k: [] for k in ("bucket", "docs", "counts", "found", "anchors")}, schema=pa.schema(
    [("bucket", pa.int32()), *((k, pa.binary()) for k in ("docs", "counts", "found", "anchors"))]))


def _marks(words: np.ndarray, counts: np.ndarray, width: int):
    """Rolling hashes with, for each, the index of its text and its position there."""
    hashes = H.rolling(words, width)
    text = np.repeat(np.arange(len(counts)), counts)[:len(hashes)]
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    at = np.arange(len(hashes)) - first[text]
    inside = at + width <= counts[text]
    return hashes[inside], text[inside], at[inside]


def _pack(n_buckets: int, ids: np.ndarray, text: np.ndarray, hashes: np.ndarray, anchor: np.ndarray, kind):
    """One row for each bucket: document ids, number of values of each, values, anchor flags."""
    bucket = ((hashes >> H.U64(40)) % H.U64(n_buckets)).astype(np.int64)
    order = np.lexsort((hashes, text, bucket))
    bucket, text, hashes, anchor = bucket[order], text[order], hashes[order], anchor[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    if len(start):
        anchor = np.logical_or.reduceat(anchor, start)
    bucket, text, hashes = bucket[new], text[new], hashes[new]
    cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
    rows = {"bucket": [], "docs": [], "counts": [], "found": [], "anchors": []}
    for b in np.flatnonzero(np.diff(cuts)):
        lo, hi = cuts[b], cuts[b + 1]
        own, n = np.unique(text[lo:hi], return_counts=True)
        rows["bucket"].append(int(b))
        rows["docs"].append(ids[own].astype(np.int64).tobytes())
        rows["counts"].append(n.astype(np.int32).tobytes())
        rows["found"].append(hashes[lo:hi].astype(kind).tobytes())
        rows["anchors"].append(np.packbits(anchor[lo:hi]).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int32())] + [
        pa.array(rows[c], pa.binary()) for c in ("docs", "counts", "found", "anchors")],
        names=["bucket", "docs", "counts", "found", "anchors"])


def _unpack(batches, kind):
    """All of a bucket: document of each value, value, anchor flag."""
    docs, values, anchors = [], [], []
    for batch in batches:
        for d, c, f, a in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
            v = np.frombuffer(f, dtype=kind)
            values.append(v)
            docs.append(np.repeat(np.frombuffer(d, dtype=np.int64), np.frombuffer(c, dtype=np.int32)))
            anchors.append(np.unpackbits(np.frombuffer(a, dtype=np.uint8), count=len(v)).astype(bool))
    if not values:
        return np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, bool)
    return np.concatenate(docs), np.concatenate(values), np.concatenate(anchors)


def _places(docs: np.ndarray, n: int) -> np.ndarray:
    return (H.mix64(docs.view(np.uint64)) % H.U64(n)).astype(np.int64)


def _replies(n: int, docs: np.ndarray, values: np.ndarray):
    """One row for each place of documents, with the values found for its documents."""
    if not len(docs):
        return
    place = _places(docs, n)
    order = np.lexsort((docs, place))
    docs, values, place = docs[order], values[order], place[order]
    cuts = np.searchsorted(place, np.arange(n + 1))
    at = np.flatnonzero(np.diff(cuts))
    yield pa.RecordBatch.from_arrays([
        pa.array(at, pa.int32()), pa.array([docs[cuts[k]:cuts[k + 1]].tobytes() for k in at], pa.binary()),
        pa.array([values[cuts[k]:cuts[k + 1]].tobytes() for k in at], pa.binary())], names=["place", "docs", "found"])


def _known(replies: pa.Table, kind) -> dict[int, np.ndarray]:
    """The values found for each document of a place."""
    if not replies.num_rows:
        return {}
    docs = np.concatenate([np.frombuffer(x, np.int64) for x in replies.column("docs").to_pylist()])
    found = np.concatenate([np.frombuffer(x, kind) for x in replies.column("found").to_pylist()])
    order = np.argsort(docs, kind="stable")
    docs, found = docs[order], found[order]
    start = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    return dict(zip(docs[start].tolist(), np.split(found, start[1:])))


def _grouped_min(values: np.ndarray, docs: np.ndarray, use: np.ndarray):
    """For each entry, the index of its value among the distinct ones, and for those the smallest
    document among the entries in use (the largest integer without one)."""
    kinds, at = np.unique(values, return_inverse=True)
    low = np.full(len(kinds), np.iinfo(np.int64).max)
    np.minimum.at(low, at[use], docs[use])
    return at, low, len(kinds)


def _placed(n: int):
    """The place of each row: by its id, so that answers find it; rows without an id go anywhere."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            place = _places(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), n)
            place = np.where(ids.is_null().to_numpy(zero_copy_only=False), np.arange(batch.num_rows) % n, place)
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), ids, batch.column(1)], names=["place", "doc_id", "text"])
    return run


def _anchor_probes(block: int, window: int, n_buckets: int):
    def run(batches):
        for batch in batches:
            for ids, texts in H.chunks(batch):
                words, counts = H.hashed_words(texts, lower=False)
                hashes, text, at = _marks(words, counts, block)
                use = counts[text] >= window
                yield _pack(n_buckets, np.array(ids, np.int64), text[use], hashes[use], at[use] % block == 0, np.uint32)
    return run


def _anchor_hits(n: int):
    def run(batches):
        docs, values, anchors = _unpack(batches, np.uint32)
        at, low, kinds = _grouped_min(values, docs, anchors)
        high = np.full(kinds, np.iinfo(np.int64).min)
        np.maximum.at(high, at, docs)
        # probes of a later document, and reference blocks that a later document probes
        hit = (docs > low[at]) | (anchors & (docs < high[at])) if kinds else np.zeros(0, bool)
        yield from _replies(n, docs[hit], values[hit])
    return run


def _window_hits(n: int):
    def run(batches):
        docs, values, anchors = _unpack(batches, np.uint64)
        at, low, kinds = _grouped_min(values, docs, anchors)
        hit = docs > low[at] if kinds else np.zeros(0, bool)
        yield from _replies(n, docs[hit], values[hit])
    return run


def _extended(block: int, window: int, n_buckets: int):
    """The windows around the hits of each document, packed by bucket."""
    def run(left: pa.Table, right: pa.Table):
        known = _known(right, np.uint32)
        rows = [_EMPTY]
        if known:
            left = left.select(["doc_id", "text"])
            left = left.filter(pc.is_in(left.column(0), pa.array(list(known), pa.int64())))
            for batch in left.to_batches():
                rows += _around(batch, known, block, window, n_buckets)
        return pa.Table.from_batches(rows)
    return run


def _around(batch, known, block, window, n_buckets):
    for ids, texts in H.chunks(batch):
        words, counts = H.hashed_words(texts, lower=False)
        hashes, text, at = _marks(words, counts, block)
        hit = np.zeros(len(hashes), dtype=bool)
        cuts = np.searchsorted(text, np.arange(len(texts) + 1))
        for k, i in enumerate(ids):
            lo, hi = cuts[k], cuts[k + 1]
            hit[lo:hi] = np.isin(hashes[lo:hi].astype(np.uint32), known[i])
        # a hit at p is inside the windows that start at p - (window - block) .. p
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        mark = np.zeros(len(words) + 1, dtype=np.int32)
        np.add.at(mark, first[text[hit]] + np.maximum(at[hit] - (window - block), 0), 1)
        np.add.at(mark, first[text[hit]] + at[hit] + 1, -1)
        inside = np.cumsum(mark)[:-1] > 0
        hashes, text, at = _marks(words, counts, window)
        use = inside[first[text] + at] if len(text) else np.zeros(0, bool)
        yield _pack(n_buckets, np.array(ids, np.int64), text[use], hashes[use], np.ones(int(use.sum()), bool), np.uint64)


def covered(text: bytes, known: np.ndarray, window: int) -> np.ndarray:
    """Which words of the text a known window covers."""
    words, _ = H.hashed_words([text], lower=False)
    hit = np.isin(H.rolling(words, window), known)
    mark = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + window, -1)
    return np.cumsum(mark)[:-1] > 0


def _cleaned(window: int, digest: bool):
    def run(left: pa.Table, right: pa.Table):
        known = _known(right, np.uint64)
        out = []
        for batch in left.select(["doc_id", "text"]).to_batches():
            for ids, texts in H.chunks(batch):
                for i, raw in zip(ids, texts):
                    words = raw.split()
                    n, gone = len(words), 0
                    if i in known and n:
                        mask = covered(raw, known[i], window)
                        gone = int(mask.sum())
                        words = [w for w, m in zip(words, mask.tolist()) if not m]
                    kept = b" ".join(words)
                    out.append((i, n, gone, hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "surrogatepass")))
        ids, n, gone, kept = zip(*out) if out else ((), (), (), ())
        return pa.table([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                        names=["doc_id", "n_words", "n_removed", "kept"])
    return run


def dedup_substrings(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text",
                     digest: bool = False) -> DataFrame:
    """Remove every word inside a ``window``-word sequence that also starts in a document with a
    smaller id.  Returns ``doc_id``, ``n_words``, ``n_removed`` and ``kept``: the words left, joined
    by one space, or with ``digest`` their SHA-256."""
    if window < 2:
        raise ValueError("window: two words at least")
    block, n = (window + 1) // 2, buckets(docs)
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    anchors = own.where("doc_id IS NOT NULL").mapInArrow(_anchor_probes(block, window, n), _PACKED)
    hits = anchors.repartitionById(n, "bucket").mapInArrow(_anchor_hits(n), _REPLY)
    # one shuffle of the text, read by both steps below
    placed = own.mapInArrow(_placed(n), "place int, doc_id bigint, text string").repartition(n, "place")
    windows = placed.groupBy("place").cogroup(hits.groupBy("place")).applyInArrow(_extended(block, window, n), _PACKED)
    repeats = windows.repartitionById(n, "bucket").mapInArrow(_window_hits(n), _REPLY)
    return placed.groupBy("place").cogroup(repeats.groupBy("place")).applyInArrow(
        _cleaned(window, digest), "doc_id bigint, n_words bigint, n_removed bigint, kept string")
