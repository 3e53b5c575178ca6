"""Byte-level BPE encoding and decoding over a table of distinct words.

1. ``pack``: the texts are dealt to blocks (one shuffle, zstd-compressed Arrow rows).
2. ``words``: each block is split into words and sends every distinct word once to the word's bucket.
3. ``encode``: each bucket encodes every distinct word of the corpus once and answers each block.
4. ``place``: each block splits its texts again (reading the same shuffle) and puts the answered ids
   at the words' positions; the text is decoded from the ids through the id-to-piece table.

The word rule is that of byte-level BPE files that split by the usual pattern (contractions; a space
and letters, digits or other signs; white space); it runs as array operations over code points.
The vocabulary file is a parameter; its text (a fixed size) goes to the tasks, nothing of the corpus
passes the driver, and no word table is broadcast.

Edge cases: null texts count as empty; an empty text has no ids; strings of special tokens in a text
get their ids, as in the library; rows without an id or with repeated ids give a row each.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import hashing as H
from tokenloom.llm.common import buckets, released, unused

LETTER, NUMBER, SPACE, OTHER, BREAK = range(5)
_TABLES: dict[str, object] = {}


def _classes() -> np.ndarray:
    """Class of every code point; the driver works it out and the tasks get it.

    Unicode versions differ between libraries, so code points that the ``regex`` and ``unicodedata``
    modules class differently get the class that the tokenizers library gives them."""
    if "classes" not in _TABLES:
        import unicodedata

        import regex
        from tokenizers.pre_tokenizers import ByteLevel
        kind = np.full(0x110000, OTHER, dtype=np.uint8)
        category = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
        kind[np.array([c == "L" for c in category])] = LETTER
        kind[np.array([c == "N" for c in category])] = NUMBER
        points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        chars = "".join(map(chr, points))
        other = np.full(0x110000, OTHER, dtype=np.uint8)
        for pattern, value in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
            other[[points[m.start()] for m in regex.finditer(pattern, chars)]] = value
        kind[other == SPACE] = SPACE
        splitter = ByteLevel(add_prefix_space=False)
        for c in np.flatnonzero(kind != other).tolist():
            if not 0xD800 <= c < 0xE000:
                first = splitter.pre_tokenize_str(f"a{chr(c)}1")
                inner = len(splitter.pre_tokenize_str(f"!{chr(c)}!"))
                kind[c] = (LETTER if first[0][1] == (0, 2) else NUMBER if first[1][1] == (1, 3)
                           else OTHER if inner == 1 else SPACE)
        _TABLES["classes"] = kind
    return _TABLES["classes"]


def _values() -> np.ndarray:
    """Hash value of every code point."""
    if "values" not in _TABLES:
        _TABLES["values"] = H.mix64(np.arange(1, 0x110001, dtype=H.U64) * H.U64(0xA0761D6478BD642F))
    return _TABLES["values"]


def split_words(joined: str, sizes: list[int], classes: np.ndarray):
    """Code points of the texts, each followed by a break, and start, end and text of every word.
    ``joined``: the texts with a line end after each; ``sizes``: their lengths."""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    breaks = np.cumsum(np.array(sizes, dtype=np.int64) + 1) - 1
    kind = classes[codes]
    kind[breaks] = BREAK
    begin = np.flatnonzero(np.diff(kind, prepend=255) | (kind == BREAK))  # runs of one class
    what, size = kind[begin], np.diff(begin, append=len(kind))
    follows = np.append(what[1:], BREAK)
    solid = what < SPACE
    solid |= what == OTHER
    joins = np.zeros(len(begin), dtype=bool)  # a run whose word takes the space before it
    joins[1:] = solid[1:] & (what[:-1] == SPACE) & (codes[begin[1:] - 1] == 32)
    start = np.zeros(len(kind) + 2, dtype=bool)
    start[begin[solid] - joins[solid]] = True
    white = what == SPACE
    last = white & (follows == BREAK)
    start[begin[last]] = True
    inner = white & (follows != BREAK)
    start[begin[inner & (size > 1)]] = True
    start[(begin + size - 1)[inner]] = True  # joined to the next run or, if it is no space, alone
    # contractions: a lone apostrophe at a word's start, and letters
    quote = np.flatnonzero((what == OTHER) & (size == 1) & ~joins & (follows == LETTER) & (codes[begin] == 39))
    if len(quote):
        at, letters = begin[quote], size[quote + 1]
        one, two = codes[at + 1], codes[np.minimum(at + 2, len(codes) - 1)]
        n = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        pair = (letters > 1) & (((two == ord("e")) & ((one == ord("r")) | (one == ord("v"))))
                                | ((one == ord("l")) & (two == ord("l"))))
        n = np.where(pair, 2, n)
        at, n, letters = at[n > 0], n[n > 0], letters[n > 0]
        start[at + 1] = False
        rest = letters > n
        start[(at + 1 + n)[rest]] = True
    starts = np.flatnonzero(start[:len(kind)])
    text = np.searchsorted(breaks, starts)
    ends = np.minimum(np.append(starts[1:], len(kind)), breaks[text])
    return codes, starts, ends, text


def word_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, dtype=H.U64)
    values = _values()[codes]
    return H.mix64(H._spans(values, H._M_BYTE, starts, ends) + (ends - starts).astype(H.U64))


class Vocabulary:
    """A vocabulary file: special tokens, the encoder and the id-to-piece table."""

    def __init__(self, text: str):
        self.text, self.classes = text, _classes()
        data = json.loads(text)
        kind, model = data.get("pre_tokenizer") or {}, data["model"]
        if (kind.get("type"), kind.get("add_prefix_space"), kind.get("use_regex", True)) != ("ByteLevel", False, True) \
                or data.get("normalizer") or model["type"] != "BPE":
            raise ValueError("not a byte-level BPE file that splits by the usual pattern")
        self.special = {a["content"]: a["id"] for a in data.get("added_tokens", [])}
        if any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in data.get("added_tokens", [])):
            raise ValueError("special tokens that take in their surroundings are not supported")
        # printable bytes stand for themselves; the others, in order, for code points from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(own)]
        back = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.pieces = [b""] * size
        for piece, i in model["vocab"].items():
            self.pieces[i] = bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode()
        for piece, i in self.special.items():
            self.pieces[i] = piece.encode()

    def encoder(self):
        if self.text not in _TABLES:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            one = Tokenizer.from_str(self.text)
            one.no_padding()
            one.no_truncation()
            _TABLES[self.text] = one
        return _TABLES[self.text]

    def segments(self, text: str) -> Iterator[str]:
        """The text cut around special tokens, which come as parts of their own."""
        if not any(s in text for s in self.special):
            return iter([text])
        import re
        return (p for p in re.split("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")", text) if p)


def _compressed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _opened(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _pack(blocks: int):
    def run(batches):
        from pyspark import TaskContext
        at = TaskContext.get().partitionId() * 7919
        for batch in batches:
            where = (at + np.arange(batch.num_rows)) % blocks
            at += batch.num_rows
            order = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[order], np.arange(blocks + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                part = batch.take(pa.array(order[cuts[b]:cuts[b + 1]]))
                yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int32()), pa.array([_compressed(part)], pa.binary())],
                                                 names=["block", "rows"])
    return run


def _texts(rows: pa.Table, voc: Vocabulary, most: int = 1_000_000):
    """Successive (first row, number of rows, segments, row of each segment) of bounded size."""
    texts = rows.column(rows.num_columns - 1).to_pylist()
    first, held, row, size = 0, [], [], 0
    for k, t in enumerate(texts):
        if held and size + len(t or "") > most:
            yield first, k - first, held, np.array(row, np.int64) - first
            first, held, row, size = k, [], [], 0
        for part in voc.segments(t or ""):
            held.append(part)
            row.append(k)
        size += len(t or "")
    if first < len(texts):
        yield first, len(texts) - first, held, np.array(row, np.int64) - first


def _split(held: list[str], voc: Vocabulary):
    """Distinct word hashes, a (start, end) of each, each word's index among them, its segment, the segments joined.

    A special token is one word; its hash is that of its code points, set apart."""
    joined = "\n".join([*held, ""])
    codes, starts, ends, segment = split_words(joined, list(map(len, held)), voc.classes)
    hashes = word_hashes(codes, starts, ends)
    marks = [k for k, t in enumerate(held) if t in voc.special] if voc.special else []
    if marks:
        lengths = np.array([len(t) + 1 for t in held])
        begin = np.cumsum(lengths) - lengths
        keep = ~np.isin(segment, marks)
        m = np.array(marks)
        starts = np.concatenate([starts[keep], begin[m]])
        ends = np.concatenate([ends[keep], begin[m] + lengths[m] - 1])
        own = H.mix64(word_hashes(codes, begin[m], begin[m] + lengths[m] - 1) + H.U64(1))
        hashes, segment = np.concatenate([hashes[keep], own]), np.concatenate([segment[keep], m])
        order = np.argsort(starts, kind="stable")
        starts, ends, hashes, segment = starts[order], ends[order], hashes[order], segment[order]
    kinds, first, at = np.unique(hashes, return_index=True, return_inverse=True)
    return kinds, starts[first], ends[first], at.astype(np.int32), segment, joined


def _words(blocks: int, voc: Vocabulary):
    """For each block, its distinct words by bucket, sorted by hash."""
    def run(batches):
        seen: dict[int, tuple[np.ndarray, list, list]] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                known, order, words = seen.get(block, (np.zeros(0, H.U64), [], []))
                for _, _, held, _ in _texts(_opened(data), voc):
                    kinds, starts, ends, _, _, joined = _split(held, voc)
                    new = np.ones(len(kinds), dtype=bool)
                    if len(known):
                        new = known[np.minimum(np.searchsorted(known, kinds), len(known) - 1)] != kinds
                    words.extend([joined[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
                    order.append(kinds[new])
                    known = np.sort(np.concatenate([known, kinds[new]]), kind="stable")
                seen[block] = (known, order, words)
        for block, (_, order, words) in seen.items():
            known, words = np.concatenate([np.zeros(0, H.U64), *order]), np.array([*words, None], dtype=object)
            bucket = (known >> H.U64(32)) % H.U64(blocks)
            order = np.lexsort((known, bucket))
            cuts = np.searchsorted(bucket[order], np.arange(blocks + 1, dtype=H.U64))
            for b in np.flatnonzero(np.diff(cuts)):
                part = pa.RecordBatch.from_arrays([pa.array(words[order[cuts[b]:cuts[b + 1]]].tolist(), pa.string())], names=["word"])
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(b)], pa.int32()), pa.array([block], pa.int32()), pa.array([_compressed(part)], pa.binary())],
                    names=["bucket", "block", "rows"])
    return run


def _encode(voc: Vocabulary):
    """Encode each distinct word of a bucket once; answer each block in the order it asked."""
    def run(batches):
        asked, index, words = [], {}, []
        for batch in batches:
            for bucket, block, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                at = []
                for w in _opened(data).column(0).to_pylist():
                    k = index.setdefault(w, len(words))
                    if k == len(words):
                        words.append(w)
                    at.append(k)
                asked.append((bucket, block, np.array(at, np.int64)))
        one = voc.encoder()
        ids = [np.array(e.ids, np.uint32) for lo in range(0, len(words), 50_000)
               for e in one.encode_batch_fast(words[lo:lo + 50_000], add_special_tokens=False)]
        for bucket, block, at in asked:
            part = pa.RecordBatch.from_arrays([
                pa.array([[len(ids[k]) for k in at.tolist()]], pa.list_(pa.uint32())),
                pa.array([np.concatenate([ids[k] for k in at.tolist()])], pa.list_(pa.uint32()))], names=["n", "ids"])
            yield pa.RecordBatch.from_arrays([
                pa.array([block], pa.int32()), pa.array([bucket], pa.int32()), pa.array([_compressed(part)], pa.binary())],
                names=["block", "bucket", "answer"])
    return run


def _place(blocks: int, voc: Vocabulary, digest: bool, schema: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = dict(zip(right.column("bucket").to_pylist(), right.column("answer").to_pylist()))
        parts, known = [], []
        for data in left.column("rows").to_pylist():
            rows = _opened(data)
            split = []
            for first, n, held, row in _texts(rows, voc):
                kinds, _, _, at, segment, _ = _split(held, voc)
                split.append((n, kinds, at, row[segment]))
                known.append(kinds)
            parts.append((rows, split))
        known = np.unique(np.concatenate(known)) if known else np.zeros(0, H.U64)
        bucket = (known >> H.U64(32)) % H.U64(blocks)
        order = np.lexsort((known, bucket))
        counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for b in np.unique(bucket).tolist():
            got = _opened(answers[int(b)])
            counts.append(got.column("n").chunk(0).flatten().to_numpy().astype(np.int64))
            ids.append(got.column("ids").chunk(0).flatten().to_numpy())
        counts, ids = np.concatenate(counts), np.concatenate(ids)
        cuts = np.concatenate([[0], np.cumsum(counts)])
        back = np.empty(len(known), dtype=np.int64)
        back[order] = np.arange(len(known))  # from a word's rank by hash to its place in the answers
        if digest:
            own = [ids[a:b].tolist() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            shown = [",".join(map(str, x)).encode() for x in own]
            decoded = [b"".join(map(voc.pieces.__getitem__, x)) for x in own]
        tables = []
        for rows, split in parts:
            n_ids, out_ids, out_text = [], [], []
            for n, kinds, at, row in split:
                place = back[np.searchsorted(known, kinds)][at]
                ends = np.searchsorted(row, np.arange(n), side="right")
                sums = np.concatenate([[0], np.cumsum(counts[place])])
                sizes = np.diff(sums[ends], prepend=0)
                n_ids.append(sizes)
                if digest:
                    place, lo = place.tolist(), 0
                    for hi in ends.tolist():
                        mine = place[lo:hi]
                        out_ids.append(hashlib.sha256(b",".join([shown[k] for k in mine])).hexdigest())
                        text = b"".join([decoded[k] for k in mine]).decode("utf-8", "replace")
                        out_text.append(hashlib.sha256(text.encode()).hexdigest())
                        lo = hi
                else:
                    gather = np.repeat(cuts[place] - sums[:-1], counts[place]) + np.arange(sums[-1])
                    for own_ids in np.split(ids[gather].astype(np.int32), np.cumsum(sizes)[:-1]):
                        out_ids.append(own_ids)
                        out_text.append(b"".join(map(voc.pieces.__getitem__, own_ids.tolist())).decode("utf-8", "replace"))
            n_ids = np.concatenate(n_ids) if n_ids else np.zeros(0, np.int64)
            kept = [rows.column(k) for k in range(rows.num_columns - 1)]
            tables.append(pa.Table.from_arrays([*kept, pa.array(n_ids, pa.int64()), pa.array(
                out_ids, pa.string() if digest else pa.list_(pa.int32())), pa.array(out_text, pa.string())], schema=schema))
        return pa.concat_tables(tables) if tables else schema.empty_table()
    return run


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
           digest: bool = False) -> DataFrame:
    """Columns ``keep`` of every row, then ``n_tokens``, ``ids`` (array) and ``decoded`` (the text decoded
    from the ids); with ``digest`` instead of the last two ``ids_sha256`` (decimal ids joined by commas)
    and ``decoded_sha256``.  ``vocabulary`` is the text of the vocabulary file."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

    added = [StructField("n_tokens", LongType())] + (
        [StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())] if digest
        else [StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])
    own = docs.select(*keep, F.col(text_col).alias(unused(docs, "text")))  # the text stands last
    out = StructType(own.schema.fields[:-1] + added)
    voc, n = Vocabulary(vocabulary), buckets(docs)
    packed = own.mapInArrow(released(_pack(n)), "block int, rows binary").repartition(n, "block")
    words = packed.mapInArrow(released(_words(n, voc)), "bucket int, block int, rows binary")
    answers = words.repartitionById(n, "bucket").mapInArrow(released(_encode(voc)), "block int, bucket int, answer binary")
    placed = packed.groupBy("block").cogroup(answers.groupBy("block"))
    return placed.applyInArrow(_place(n, voc, digest, to_arrow_schema(out)), out)


def decode(ids: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id``, ``text``: the id-to-piece join.  Ids outside the vocabulary, and null ones, add nothing."""
    voc = Vocabulary(vocabulary)
    spark = ids.sparkSession
    pieces = spark.createDataFrame(list(enumerate(map(bytearray, voc.pieces))), "_id int, _piece binary")
    own = ids.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), F.col(ids_col).alias("_ids"))
    each = own.select("_row", "doc_id", F.posexplode_outer("_ids").alias("_pos", "_id"))
    # the table has the vocabulary's fixed size
    joined = each.join(F.broadcast(pieces), "_id", "left")
    text = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.hex(F.coalesce("_piece", F.lit(b""))).alias("h")))), lambda x: x["h"]))
    return joined.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.decode(F.unhex(text), "utf-8").alias("text")).drop("_row")


def read_vocabulary(path: str | None = None) -> str:
    """Text of a vocabulary file; by default the installed public byte-level one."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as fh:
        return fh.read()
