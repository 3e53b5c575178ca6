"""Near-duplicate documents: chosen-path set similarity join on word shingles.

1. Each document gets its set of distinct word shingles (64-bit hashes), a 128-bit fingerprint of the
   set and a signature of minwise tokens.  Documents with equal sets are one class; its number is its smallest id, or,
   where that is the smallest id of another class too (one id with several texts), the fingerprint's first half.
   Classes, not ids, are joined, and the smallest id of each component is looked up at the end.
2. Each of several independent trees sends a document to the node of its minwise token at a coordinate of the tree's
   own.  A node with more than ``leaf`` documents is split by the tree's further coordinates, ``levels`` at most.  No
   coordinate serves twice, so a pair at the threshold shares a node of a tree with the chance similarity ** levels
   at least, and the number of trees for the chance ``recall`` follows from that.
3. Nodes of at most ``leaf`` documents are first narrowed on the signatures, to the parts connected by pairs that come
   within six standard deviations of the threshold (mostly the same in every tree, and then taken once; a pair at the
   threshold falls below that about once in ten million).  Within a part all pairs not connected yet are compared on the
   full sets; a part passes on only links that connect something new, so n documents give fewer than n links.
   Levels are taken STEP at a time, to need few jobs; a node counts only if the one above is too large.
4. A node that is still too large at the last level (a family of near copies, or of pages from one template) is
   compared with its smallest document in slices; where that leaves several components, all pairs of its slices are
   compared like nodes, except slices of one component.  That costs the square of such a node's unconnected part.
5. Connected components over the links give the groups.

Edge cases: null or empty texts have an empty set and stay alone; a text shorter
than a shingle is one shingle; rows without an id link with nothing (``component_id`` null, kept);
repeated rows are judged one by one by their own text and give a row each, also where one id stands for several texts (such
an id doesn't unite their groups).  A similarity too low to be found with the chance ``recall`` raises a ValueError.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import hashing as H
from tokenloom.llm.common import buckets, components, cut_lineage, map_groups, released, small_batches

COORDS = 64
LEVELS = 4  # at most
STEP = 4
_A = (H.mix64(np.arange(1, COORDS + 1, dtype=H.U64)) >> H.U64(32)).astype(np.uint32) | np.uint32(1)
_B = H.mix64(np.arange(1001, COORDS + 1001, dtype=H.U64)).astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minwise tokens of a set, one for each coordinate."""
    low, best = (shingles >> H.U64(13)).astype(np.uint32), np.full(COORDS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(best, (low[at:at + 1024, None] * _A + _B).min(axis=0), out=best)
    return best


def _sets(lower: bool, width: int, batch: pa.RecordBatch):
    for ids, texts, digests in H.chunks(batch, columns=3):
        words, counts = H.hashed_words(texts, lower)
        at = 0
        for i, n, digest in zip(ids, counts.tolist(), digests):
            yield i, H.shingle_set(words[at:at + n], width), digest
            at += n


def _fingerprint(shingles: np.ndarray) -> bytes:
    a = H.mix64(shingles + H.U64(0x51ED270B)).sum(dtype=H.U64)
    b = H.mix64(shingles ^ H.U64(0xC2B2AE3D27D4EB4F)).sum(dtype=H.U64)
    return a.tobytes() + b.tobytes()


def _number(fingerprint: bytes) -> int:
    return int.from_bytes(fingerprint[:8], "little", signed=True)


def _signatures(lower: bool, width: int):
    def run(batches):
        for batch in batches:
            out = []
            for i, s, digest in _sets(lower, width, batch):
                own = _fingerprint(s) if len(s) else None
                out.append((i, len(s), own, _number(own) if own else None, signature(s).tobytes() if own else None, digest))
            types = pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64()
            columns = zip(*out) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "n", "print", "mark", "tokens", "digest"])
    return run


def _full_sets(lower: bool, width: int):
    """The set of each class's document, once for each node that it is in.  An id's other texts and repeated rows are left out."""
    def run(batches):
        done = set()
        for batch in batches:
            for ids, texts, nodes, stars, marks in H.chunks(batch, columns=5):
                words, counts = H.hashed_words(texts, lower)
                at, out = 0, []
                for i, n, own, star, mark in zip(ids, counts.tolist(), nodes, stars, marks):
                    held = H.shingle_set(words[at:at + n], width)
                    at += n
                    if i not in done and len(held) and _number(_fingerprint(held)) == mark:
                        done.add(i)
                        out += [(node, s, i, held.tobytes()) for node, s in zip(own, star)]
                if out:
                    columns = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                        columns, (pa.int64(), pa.bool_(), pa.int64(), pa.binary()))], names=["node", "star", "id", "shingles"])
    return run


def _shape(similarity: float, recall: float, levels: int) -> tuple[int, int]:
    """Trees and levels: as many levels as leave each level of each tree a coordinate of its own."""
    for depth in range(min(levels, LEVELS), 0, -1):
        keep = similarity ** depth
        trees = math.ceil(math.log(1 - recall) / math.log1p(-keep)) if keep < 1 else 1
        if trees * depth <= COORDS:
            return trees, depth
    raise ValueError(f"a similarity of {similarity} isn't found with the chance {recall} by {COORDS} coordinates")


def _roots(trees: int, depth: int):
    """The first node of each tree: by the minwise token at the tree's first coordinate."""
    def run(batches):
        salt = H.mix64(np.arange(1, trees + 1, dtype=H.U64))
        for batch in batches:
            ids = np.repeat(batch.column(0).to_numpy(), trees)
            tokens = _matrix(batch.column(1))[:, np.arange(trees) * depth]
            nodes = H.mix64(tokens.astype(H.U64) * H.U64(0x9E3779B97F4A7C15) + salt)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.ravel().view(np.int64)), pa.array(ids), pa.array(
                np.tile(np.arange(trees, dtype=np.int32), batch.num_rows))], names=["node", "id", "tree"])
    return run


def _matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.uint32).reshape(len(rows), COORDS)


def _branches(first: int, last: int, depth: int):
    """The nodes of the next levels, ``first`` to ``last``, with the node above each: by the tree's next coordinates."""
    def run(batches):
        for batch in batches:
            nodes, ids, tree = batch.column(0).to_numpy().view(np.uint64), batch.column(1), batch.column(2)
            tokens, row = _matrix(batch.column(3)), np.arange(batch.num_rows)
            for level in range(first, last + 1):
                chosen = tokens[row, tree.to_numpy() * depth + level - 1].astype(H.U64)
                above, nodes = nodes, H.mix64(H.mix64(nodes + H.U64(level)) + chosen * H.U64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(above.view(np.int64)), pa.array(
                    np.full(len(row), level, np.int32)), ids, tree], names=["node", "above", "level", "id", "tree"])
    return run


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.root(i)] = self.root(j)


def linked_pairs(sets: list[np.ndarray], percent: int, star: bool = False):
    """Pairs (i, j) with intersection / union of at least ``percent`` %, fewer than ``len(sets)`` of them,
    that connect everything that such pairs connect.  With ``star``: pairs with the first set only.

    Above 64 sets, signatures put the likely pairs first; every pair not connected yet is looked at in full."""
    m, sizes = len(sets), np.array([len(s) for s in sets])
    forest = _Forest(m)
    tokens = np.array([signature(s) for s in sets]) if m > 64 else None
    for i in range(1 if star else m - 1):
        rest = np.arange(i + 1, m)
        rest = rest[100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i])]
        if tokens is not None and len(rest):
            rest = rest[np.argsort(-(tokens[rest] == tokens[i]).sum(axis=1), kind="stable")]
        for j in rest.tolist():
            if forest.root(i) != forest.root(j):
                both = np.intersect1d(sets[i], sets[j], assume_unique=True).size
                if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                    forest.join(i, j)
                    yield i, j


def _compare(percent: int):
    def run(group: pa.Table):
        ids = np.array(group.column("id").to_pylist())
        order = np.argsort(ids)
        sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
        sets = [sets[k] for k in order.tolist()]
        pairs = list(linked_pairs(sets, percent, group.column("star")[0].as_py()))
        ids = ids[order]
        if pairs:
            a, b = np.array(pairs).T
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])
    return run


def _alike(percent: int):
    """The parts of a node whose signatures come near the threshold, six standard deviations below it and up."""
    need = percent / 100
    least = need - 6 * math.sqrt(need * (1 - need) / COORDS)

    def run(group: pa.Table):
        ids = np.array(group.column("id").to_pylist())
        order = np.argsort(ids)
        ids, tokens, star = ids[order], _matrix(group.column("tokens"))[order], group.column("star")[0].as_py()
        forest = _Forest(len(ids))
        for i in range(1 if star else len(ids) - 1):
            for j in (np.flatnonzero((tokens[i + 1:] == tokens[i]).mean(axis=1) >= least) + i + 1).tolist():
                forest.join(j, i)
        roots = np.array([forest.root(i) for i in range(len(ids))])
        parts = [ids[roots == r] for r in np.unique(roots)]
        parts = [p for p in parts if len(p) > 1 and (not star or p[0] == ids[0])]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.list_(pa.int64())), pa.array([star] * len(parts))], names=["ids", "star"])
    return run


def _members(leaves: DataFrame) -> DataFrame:
    return leaves.select(F.xxhash64("ids", "star").alias("node"), "star", F.explode("ids").alias("id"))


def _compared(leaves: DataFrame, docs: DataFrame, classes: DataFrame, lower: bool, width: int, percent: int) -> DataFrame:
    """Links within the leaves (``ids`` array, ``star`` boolean), on the full sets."""
    wanted = _members(leaves).groupBy("id").agg(
        F.collect_list("node").alias("nodes"), F.collect_list("star").alias("stars"))
    wanted = wanted.join(classes.select("id", "mark", F.col("low").alias("doc_id")), "id")
    rows = docs.select("doc_id", "text").join(wanted, "doc_id").select("id", "text", "nodes", "stars", "mark").mapInArrow(
        released(_full_sets(lower, width)), "node bigint, star boolean, id bigint, shingles binary")
    return map_groups(rows, "node", _compare(percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, lower: bool = True, leaf: int = 1000,
                    recall: float = 0.999, levels: int = 4, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row for each input row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable over
    links with ``100 * intersection >= percent * union``) and ``kept`` (whether it is that id); with ``digest`` also
    ``digest``, the text's ``xxhash64``, which tells rows of one id apart."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))
    signed = cut_lineage(own.mapInArrow(released(_signatures(lower, width)),
                                        "doc_id bigint, n bigint, print binary, mark bigint, tokens binary, digest bigint"))
    classes = cut_lineage(signed.where("doc_id IS NOT NULL AND print IS NOT NULL").groupBy("print").agg(
        F.first("mark").alias("mark"), F.min("doc_id").alias("low"), F.first("tokens").alias("tokens")).withColumn("id", F.col("low")))
    if classes.count() != classes.select("low").distinct().count():  # an id with several texts keeps its number for one of them
        first = classes.groupBy("low").agg(F.min("print").alias("first"))
        classes = cut_lineage(classes.join(first, "low").withColumn("id", F.when(F.col("print") == F.col("first"), F.col("low")).otherwise(
            F.col("mark"))).drop("first"))
    out = _joined(own, signed, classes, percent, width, lower, leaf, recall, levels)
    return out if digest else out.drop("digest")


def _narrowed(nodes: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The parts of the nodes (``ids``, ``star``) that come near the threshold, each once."""
    rows = _members(nodes).join(reps, "id").select("node", "star", "id", "tokens")
    return cut_lineage(map_groups(rows, "node", _alike(percent), "ids array<bigint>, star boolean").distinct())


def _slice_pairs(placed: DataFrame, leaf: int) -> DataFrame:
    """All pairs of slices of each node (``node``, ``id``, ``group``), except those of one connected group.
    Groups that fill more than a slice get slices of their own."""
    sized = placed.groupBy("node", "group").agg(F.count("*").alias("m")).withColumn("own", F.when(F.col("m") * 4 > leaf, F.col("group")))
    total = sized.groupBy("node", "own").agg(F.sum("m").alias("m")).select(
        "node", "own", F.ceil(F.col("m") * 4 / leaf).cast("bigint").alias("slices"))
    dealt = placed.join(sized.drop("m"), ["node", "group"]).alias("d").join(
        total.alias("t"), (F.col("d.node") == F.col("t.node")) & F.col("d.own").eqNullSafe(F.col("t.own")))
    parts = cut_lineage(dealt.select("d.node", "d.own", "id", F.xxhash64("d.own", F.pmod(F.xxhash64("id"), "slices")).alias("slice")).groupBy(
        "node", "own", "slice").agg(F.collect_list("id").alias("ids")))
    other = parts.select("node", F.col("own").alias("own2"), F.col("slice").alias("slice2"), F.col("ids").alias("ids2"))
    return parts.join(other, "node").where("slice <= slice2 AND (own IS NULL OR own2 IS NULL OR own <> own2)").select(
        F.sort_array(F.array_union("ids", "ids2")).alias("ids"), F.lit(False).alias("star"))


def _joined(own, signed, classes, percent, width, lower, leaf, recall, levels) -> DataFrame:
    trees, depth = _shape(percent / 100, recall, levels)
    reps = classes.select("id", "tokens")
    rows = reps.mapInArrow(released(_roots(trees, depth)), "node bigint, id bigint, tree int").selectExpr(
        "node", "0L AS above", "1 AS level", "id", "tree")
    first, last, leaves, large = 1, 1, [], None
    while True:
        rows = cut_lineage(rows)
        sizes = rows.groupBy("node").agg(F.count("*").alias("m"), F.max("level").alias("level")).where("m > 1")
        small = rows.join(sizes.where(F.col("m") <= leaf).select("node"), "node")
        big = sizes.where(F.col("m") > leaf)
        if last > first:  # only where the node above is too large
            small = small.where(F.col("level") == first).unionByName(
                small.where(F.col("level") > first).join(big.select(F.col("node").alias("above")), "above", "left_semi"))
        leaves.append(small.groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids", F.lit(False).alias("star")))
        big = big.where(F.col("level") == last).select("node")
        if big.isEmpty():
            large = None
            break
        large = rows.join(big, "node").select("node", "id", "tree")
        if last >= depth:
            break
        first, last = last + 1, min(last + STEP, depth)
        rows = large.join(reps, "id").select("node", "id", "tree", "tokens").mapInArrow(
            released(_branches(first, last, depth)), "node bigint, above bigint, level int, id bigint, tree int")
    rest = None
    if large is not None:  # too large at the last level: with the smallest id, in slices
        first = large.groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("m"))
        rest = cut_lineage(large.join(first, "node").withColumn(
            "slice", F.pmod(F.xxhash64("id"), F.ceil(F.col("m") * 4 / leaf).cast("bigint"))))
        leaves.append(rest.groupBy("node", "slice").agg(F.sort_array(F.array_distinct(F.concat(
            F.collect_list("id"), F.array(F.min("low"))))).alias("ids")).select("ids", F.lit(True).alias("star")))
    nodes = leaves[0]
    for more in leaves[1:]:
        nodes = nodes.unionByName(more)
    nodes = _narrowed(nodes.distinct(), reps, percent)
    links = cut_lineage(_compared(nodes, own, classes, lower, width, percent).distinct())
    groups = components(links)
    if rest is not None:
        placed = rest.join(groups.withColumnRenamed("vertex", "id"), "id", "left").withColumn(
            "group", F.coalesce("component_id", "id"))
        several = placed.groupBy("node").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x <> y").select("node")
        if not several.isEmpty():
            blocks = _narrowed(_slice_pairs(placed.join(several, "node").select("node", "id", "group"), leaf), reps, percent)
            groups = components(links.unionByName(_compared(blocks, own, classes, lower, width, percent)))
    grouped = classes.select("print", "id", "low").join(groups.withColumnRenamed("vertex", "id"), "id", "left").withColumn(
        "group", F.coalesce("component_id", "id"))
    lowest = grouped.groupBy("group").agg(F.min("low").alias("component_id"))
    ids = grouped.select("print", "group").join(lowest, "group").select("print", "component_id")
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "print", "digest").join(ids, "print", "left")
    out = out.select("doc_id", "n_shingles", F.expr(
        "CASE WHEN doc_id IS NOT NULL THEN coalesce(component_id, doc_id) END").alias("component_id"), "digest")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


__all__ = ["near_duplicates", "linked_pairs", "signature", "buckets"]
