"""Near-duplicate vectors by sorted projection passes.

1. Equal vectors collapse to the smallest id.
2. A pass orders the vectors lexicographically by concatenated random hashes (the signs of ``BITS`` random projections) and
   compares neighbours in that order.  A window takes about ``window`` of them and ends only where a run of equal
   prefixes of ``hashes`` signs ends: a run is never cut, and one longer than a window is followed to its end, in all pairs
   of its blocks.  Of a run's blocks, those whose vectors are connected already are left out; that is known from a few
   plain windows within such runs.
3. So a pair at the threshold meets in a pass whenever it agrees in ``hashes`` signs, with a chance that follows from its angle
   alone.  The number of passes for the chance ``recall`` follows from that, for every table, however large or
   skewed, and has no cap.  ``hashes`` (``LEAST`` at least) decides only the cost: it is chosen on the run lengths that a sample
   shows (with other planes).  Dense cones take more hashes and passes.
4. Vectors travel to the windows in single precision; cosines that rounding could have moved over the threshold are
   worked out again in double.  Links are united to components over all passes, and the links of each vector are counted within its
   component, where all of them lie, in double precision and in blocks.  That count costs the square of a group's
   size over the block size in rows.

Edge cases: vectors that are null, empty, zero or of another length than most, or hold null or non-finite components,
link with nothing, as do rows without an id; of rows that share an id the smallest vector (in byte
order) stands for it.  Every input row gives a row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import buckets, components, cut_lineage, map_groups

BITS = 48
#: Signs in which a window's runs agree at least, passes of plain windows within long runs, and passes over the planning sample.
LEAST, FIRST, SAMPLED = 4, 4, 4


def _units(batches):
    """Id and unit vector (double) of the usable rows."""
    for batch in batches:
        ids, rows = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if i is None or not v or any(c is None for c in v):
                continue
            x = np.array(v, dtype=np.float64)
            top = np.abs(x).max()
            if not np.isfinite(top) or top == 0:
                continue
            x = x / top
            ids.append(i)
            rows.append((x / math.sqrt(float(x @ x))).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], names=["id", "v"])


def _matrix(column, kind=np.float64) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=kind).reshape(len(rows), -1)


def _single(batches):
    """The unit vectors beside their single-precision form."""
    for batch in batches:
        x = _matrix(batch.column(1)).astype(np.float32) if batch.num_rows else []
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "v", "u"])


def _keys(passes: int, bits: int, size: int, seed: int):
    def run(batches):
        weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                x, ids = _matrix(part.column(1)), part.column(0).to_numpy()
                for first in range(0, passes if len(ids) else 0, 16):  # planes of 16 passes at a time: any number of passes fits in memory
                    some = min(16, passes - first)
                    planes = np.random.default_rng([seed, first]).standard_normal((size, some * bits))
                    signs = (x @ planes > 0).reshape(len(ids), some, bits)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.tile(np.arange(first, first + some, dtype=np.int32), len(ids))), pa.array((signs @ weights).ravel().astype(np.int64)),
                        pa.array(np.repeat(ids, some))], names=["pass", "key", "id"])
    return run


def passes_needed(least: float, hashes: int, recall: float) -> int:
    """Passes in which a pair at the threshold agrees in all ``hashes`` signs at least once with the chance ``recall``."""
    agree = (1 - math.acos(min(1.0, max(-1.0, least))) / math.pi) ** hashes
    return 1 if agree >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-agree))) if agree > 0 else 1 << 30


def _hashes(units: DataFrame, n: int, width: int, least: float, window: int, recall: float, seed: int) -> int:
    """The cheapest number of hashes, from the pairs that share key prefixes in a sample of about 20,000 vectors.
    A vector's turn in a pass costs about ``window`` comparisons, a pair in a run two (its copy in a block included)."""
    some = units.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, n // 20_000))) == 0)
    keys = some.mapInArrow(_keys(SAMPLED, BITS, width, seed + 2), "pass int, key bigint, id bigint").select("pass", "key").toArrow()
    tag, key = keys.column("pass").to_numpy(), keys.column("key").to_numpy()
    m, best = max(1, len(key) // SAMPLED), (math.inf, LEAST)
    for k in range(LEAST, BITS + 1):
        sizes = np.concatenate([np.unique(key[tag == t] >> (BITS - k), return_counts=True)[1] for t in range(SAMPLED)]).astype(float)
        pairs = (sizes * (sizes - 1)).sum() / SAMPLED * (n / m) ** 2
        best = min(best, (passes_needed(least, k, recall) * (n * window + 2 * pairs), k))
    return best[1]


def _numbered(batches):
    from pyspark import TaskContext
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), *batch.columns],
                                         names=["part", "pos", "pass", "key", "id"])
        at += n


def _labels(near: np.ndarray) -> np.ndarray:
    """Smallest index reachable over a symmetric matrix of links."""
    label = np.arange(len(near))
    while True:
        low = np.minimum(label, np.where(near, label, len(near)).min(axis=1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _window_links(least: float):
    """Links that connect what the window's pairs connect (``sure``), and pairs between its groups that only double precision can judge."""
    def run(group: pa.Table):
        ids = np.array(group.column("id").to_pylist())
        order = np.argsort(ids)
        ids, x = ids[order], _matrix(group.column("u"), np.float32)[order]
        slack = (x.shape[1] + 8) * 2.0 ** -23
        near = x @ x.T
        label = _labels(near >= least + slack)
        at = np.flatnonzero(label != np.arange(len(label)))
        i, j = np.nonzero(np.triu(np.abs(near - least) <= slack, 1) & (label[:, None] != label[None, :]))
        if len(at) or len(i):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[at], ids[i]])), pa.array(np.concatenate([ids[label[at]], ids[j]])),
                                              pa.array(np.arange(len(at) + len(i)) < len(at))], names=["a", "b", "sure"])
    return run


def _judged(least: float):
    def run(batches):
        for batch in batches:
            x, y = _matrix(batch.column(2)), _matrix(batch.column(3))
            yield batch.select(["a", "b"]).filter(pa.array((x * y).sum(axis=1) >= least)) if batch.num_rows else batch.select(["a", "b"])
    return run


def _links(rows: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """``a``, ``b``: links among the vectors of each block of ``rows`` (``block``, ``id``)."""
    found = cut_lineage(map_groups(rows.join(reps.select("id", "u"), "id"), "block", _window_links(least), "a bigint, b bigint, sure boolean"))
    side = lambda c: reps.select(F.col("id").alias(c), F.col("v").alias(f"v{c}"))
    unsure = found.where("NOT sure").select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "va", "vb")
    return found.where("sure").select("a", "b").unionByName(unsure.mapInArrow(_judged(least), "a bigint, b bigint"))


def _block_counts(least: float):
    """Links of each vector of the one side with the vectors of the other side."""
    def run(group: pa.Table):
        ids, side, x = np.array(group.column("id").to_pylist()), np.array(group.column("side").to_pylist()), _matrix(group.column("v"))
        one, two = side == 0, side == 1
        if two.any():
            near = x[one] @ x[two].T >= least
            out, n = np.concatenate([ids[one], ids[two]]), np.concatenate([near.sum(axis=1), near.sum(axis=0)])
        else:  # a block with itself
            near = x @ x.T >= least
            np.fill_diagonal(near, False)
            out, n = ids, near.sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(n.astype(np.int64))], names=["id", "n"])
    return run


def near_vectors(vectors: DataFrame, least: float = 0.9, window: int = 256, recall: float = 0.999, seed: int = 11,
                 id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each input row: ``vec_id``, ``n_links`` (other vectors with a cosine of at least ``least``),
    ``component_id`` (smallest id reachable) and ``kept`` (whether it is that id; true without an id)."""
    own = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v"))
    units = own.mapInArrow(_units, "id bigint, v binary").groupBy("id").agg(F.min("v").alias("v"))
    sizes = units.groupBy(F.length("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    n, width = (sizes[0]["count"], sizes[0]["n"] // 8) if sizes else (0, 1)
    units = cut_lineage(units.where(F.length("v") == 8 * width))
    reps = units.groupBy("v").agg(F.min("id").alias("id")).select("id", "v").mapInArrow(_single, "id bigint, v binary, u binary")
    reps = cut_lineage(reps)
    equal = units.join(reps.select(F.col("id").alias("b"), "v"), "v").where("id <> b").select(F.col("id").alias("a"), "b")
    hashes = _hashes(reps.select("id", "v"), n, width, least, window, recall, seed)
    passes = passes_needed(least, hashes, recall) if n > window else 1  # one window holds all
    links = _pass_links(reps, buckets(vectors), width, least, window, hashes, passes, seed)
    groups = cut_lineage(components(links.unionByName(equal).distinct()))
    n_links = _counted(groups, units, least, 2 * window)
    out = own.select("vec_id").join(groups.withColumnRenamed("vertex", "vec_id"), "vec_id", "left")
    out = out.join(n_links, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                                                     F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _ordered(reps: DataFrame, parts: int, width: int, passes: int, seed: int) -> DataFrame:
    """``pass``, ``key``, ``id`` and ``place``: the number of each vector in the order of all passes, by key."""
    rows = reps.select("id", "v").mapInArrow(_keys(passes, BITS, width, seed), "pass int, key bigint, id bigint")
    rows = rows.repartitionByRange(parts, "pass", "key", "id").sortWithinPartitions("pass", "key", "id")
    rows = cut_lineage(rows.mapInArrow(_numbered, "part int, pos bigint, pass int, key bigint, id bigint"))
    counts = dict(rows.groupBy("part").agg(F.max("pos") + 1).collect())  # one number for each partition
    before, at = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(at)
        at += counts.get(p, 0)
    offset = F.get(F.lit(before or [0]).cast("array<bigint>"), F.col("part"))
    return rows.select("pass", "key", "id", (F.col("pos") + offset).alias("place"))


def _pass_links(reps: DataFrame, parts: int, width: int, least: float, window: int, hashes: int, passes: int, seed: int) -> DataFrame:
    """``a``, ``b``: links found in the windows of all passes."""
    rows = _ordered(reps, parts, width, passes, seed).withColumn("prefix", F.shiftright("key", BITS - hashes))
    runs = cut_lineage(rows.groupBy("pass", "prefix").agg(F.count("*").alias("m"), F.min("place").alias("start")))
    short = rows.join(runs.where(F.col("m") <= window), ["pass", "prefix"])
    blocks = short.select("id", F.xxhash64("pass", F.floor(F.col("start") / window)).alias("block"))
    long = runs.where(F.col("m") > window)
    if long.isEmpty():
        return cut_lineage(_links(blocks, reps, least))
    inside = rows.join(long.select("pass", "prefix", "start"), ["pass", "prefix"])
    plain = inside.where(F.col("pass") < FIRST).select("id", F.xxhash64("pass", "prefix", F.floor((F.col("place") - F.col("start")) / window)).alias("block"))
    near = cut_lineage(_links(plain, reps, least))
    blocks = blocks.unionByName(_run_blocks(inside.select(F.xxhash64("pass", "prefix").alias("run"), "id"), components(near), window))
    return cut_lineage(_links(blocks, reps, least).unionByName(near))


def _run_blocks(rows: DataFrame, groups: DataFrame, window: int) -> DataFrame:
    """``id`` and ``block``: each pair of a long ``run`` shares a block, unless known ``groups`` connect it already.
    Members of one group that fill more than a window of a run get blocks of their own."""
    large = groups.groupBy("component_id").agg(F.count("*").alias("m")).where(F.col("m") > window).select("component_id")
    large = groups.join(large, "component_id").select(F.col("vertex").alias("id"), F.col("component_id").alias("grp"))
    keyed = cut_lineage(rows.join(large, "id", "left"))
    parts = keyed.groupBy("run", "grp").agg(F.count("*").alias("m"))
    parts = parts.withColumn("grp", F.when(F.col("m") > window, F.col("grp"))).groupBy("run", "grp").agg(F.sum("m").alias("m"))
    parts = parts.groupBy("run").agg(F.collect_list(F.struct("grp", F.ceil(F.col("m") / window).cast("int").alias("n"))).alias("parts"))
    rows = keyed.join(parts, "run").withColumn("grp", F.expr("CASE WHEN exists(parts, p -> p.grp = grp) THEN grp END"))
    rows = rows.withColumn("own", F.expr("xxhash64(grp, pmod(xxhash64(id), filter(parts, p -> p.grp <=> grp)[0].n))"))
    rows = rows.select("run", "id", "grp", "own", F.explode(F.expr(
        "flatten(transform(parts, p -> transform(sequence(0L, p.n - 1L), s -> struct(p.grp AS grp, xxhash64(p.grp, s) AS block))))")).alias("o"))
    rows = rows.where(F.col("grp").isNull() | F.col("o.grp").isNull() | (F.col("grp") != F.col("o.grp")))
    return rows.select("id", F.xxhash64("run", F.least("own", "o.block"), F.greatest("own", "o.block")).alias("block"))


def _counted(groups: DataFrame, units: DataFrame, least: float, window: int) -> DataFrame:
    """Links of each vector within its component: blocks of about ``window`` vectors, each pair of blocks a task's group."""
    sizes = groups.groupBy("component_id").agg(F.ceil(F.count("*") / window).cast("int").alias("blocks"))
    members = groups.join(sizes, "component_id").withColumn("own", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int"))
    pairs = members.select(F.col("vertex").alias("id"), "component_id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = pairs.select("id", F.xxhash64("component_id", F.least("own", "other"), F.greatest("own", "other")).alias("block"),
                        (F.col("own") > F.col("other")).cast("int").alias("side"))
    counts = map_groups(rows.join(units, "id"), "block", _block_counts(least), "id bigint, n bigint")
    return counts.groupBy(F.col("id").alias("vec_id")).agg(F.sum("n").alias("n_links"))
