"""Exact neighbors and index recall.

K1 (every row's k nearest neighbors) is a block join: rows are hashed into
B blocks of bounded size, every unordered pair of blocks meets in
one grouped task that computes the distances tile by tile with BLAS and keeps a
running top-k per row; a final per-row top-k merges the B partial
lists.  No task ever holds more than two blocks, and no pair list is
emitted, only k candidates per row per block.

K2/K4 with few queries ship them inside tasks and scan the corpus once in Arrow
batches, without a shuffle of it; any number of queries meets the corpus in a
two-sided block join (query blocks x corpus blocks).  Ids of any orderable type
are carried as they are and break ties in their own order.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import as_doubles, l2_normalize
from ..session import cut_lineage
from .sample import hash_sample

#: Queries that are shipped inside tasks at most; more meet the corpus in a block join, with the same result.
FEW_QUERIES = 10_000


def _scores(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Lower is closer: squared euclidean distance, or negative cosine similarity."""
    if metric == "euclidean":
        out = (-2.0 * q) @ c.T
        out += (q * q).sum(1)[:, None]
        out += (c * c).sum(1)[None, :]
        return out
    if metric == "cosine":
        return -(q @ c.T)
    raise ValueError(f"unknown metric {metric}")


#: Pairs rescored at once (rows of two gathered matrices).
RESCORE_PAIRS = 1 << 16


def _rescored(q: np.ndarray, c: np.ndarray, r: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Squared distances of chosen pairs by plain differences (no cancellation)."""
    out = np.empty(len(r))
    for lo in range(0, len(r), RESCORE_PAIRS):
        part = slice(lo, lo + RESCORE_PAIRS)
        out[part] = ((q[r[part]] - c[col[part]]) ** 2).sum(axis=1)
    return out


def _nearest(q: np.ndarray, c: np.ndarray, qid: np.ndarray, cid: np.ndarray, k: int, metric: str,
             limit: np.ndarray | None = None, score: np.ndarray | None = None):
    """Per query row the k best (score, id) pairs, ties by the lower id, self excluded: row positions, column
    positions, scores and 1-based ranks.

    The matrix product only picks candidates: a euclidean score from it may be off by ``slack`` (its digits cancel
    where rows lie far from the origin), so every pair within twice that of the k-th best is rescored by plain
    differences and ranked by that.  ``limit`` is a known bound on each row's k-th best score, e.g. of a running top-k;
    ``np.partition`` finds the k-th smallest in linear time where there is none."""
    score = _scores(q, c, metric) if score is None else score
    score = np.where(qid[:, None] == cid[None, :], np.inf, score)
    nq, nc = score.shape
    m = min(k, nc)
    if m == 0 or nq == 0:
        e = np.empty((0,), np.int64)
        return e, e, np.empty((0,)), np.empty((0,), np.int32)
    slack = np.zeros(nq)
    if metric == "euclidean":
        size = np.sqrt((q * q).sum(1)) + np.sqrt((c * c).sum(1).max())
        slack = (q.shape[1] + 8) * np.finfo(float).eps * size * size
    cut = np.full(nq, np.inf) if limit is None else limit + slack
    if not np.isfinite(cut).all() or (score <= cut[:, None]).sum() > 4 * m * nq:
        kth = np.partition(score, m - 1, axis=1)[:, m - 1] if m < nc else np.where(np.isfinite(score), score, -np.inf).max(axis=1)
        cut = np.minimum(cut, kth + 2 * slack)
    r, col = np.nonzero((score <= cut[:, None]) & np.isfinite(score))
    s = _rescored(q, c, r, col) if metric == "euclidean" else score[r, col]
    order = np.lexsort((cid[col], s, r))
    r, col, s = r[order], col[order], s[order]
    rank = np.arange(len(r)) - np.searchsorted(r, np.arange(nq))[r] + 1
    keep = rank <= m
    return r[keep], col[keep], s[keep], rank[keep].astype(np.int32)


def numeric_ids(df: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Integer ids are used as they are.  Any other id type gets a unique integer in the
    order of the ids (so ties go to the lowest id), from a distributed sort; returns the
    frame with ``_nid`` and the stored ``(_nid, id)`` mapping to translate results back."""
    from pyspark.sql.types import IntegralType
    if isinstance(df.schema[id_col].dataType, IntegralType):
        return df.withColumn("_nid", F.col(id_col).cast("bigint")), None
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = df.select(id_col).distinct().repartitionByRange(n, id_col).sortWithinPartitions(id_col)
    mapping = cut_lineage(ids.select(F.monotonically_increasing_id().alias("_nid"), id_col))
    return df.join(mapping, id_col), mapping


def _back(res: DataFrame, mapping: DataFrame | None, cols: dict[str, str]) -> DataFrame:
    """Translate surrogate id columns of a result back to the original ids."""
    if mapping is None:
        return res
    for col, name in cols.items():
        m = mapping.select(F.col("_nid").alias(col), F.col(mapping.columns[1]).alias(f"_{name}"))
        res = res.join(m, col).drop(col).withColumnRenamed(f"_{name}", name)
    return res


CHUNK_ROWS = 1024  # rows of each side of a distance tile inside a task (chunk x chunk doubles)
#: Blocks that rows are dealt into at most, so that a row is copied about as often at every table size; only blocks
#: that would exceed MAX_BLOCK_ROWS rows (tens of MB in a task) make for more of them.
BLOCKS, MAX_BLOCK_ROWS = 16, 65_536


def block_count(n: int, block_rows: int) -> int:
    """Blocks for ``n`` rows: of about ``block_rows`` rows, or larger ones where that were more than ``BLOCKS``."""
    return max(1, min(math.ceil(n / block_rows), max(BLOCKS, math.ceil(n / MAX_BLOCK_ROWS))))


def _few_set(mask: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of a mask with few set: eight at a time are passed over."""
    flat = mask.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    eights = np.flatnonzero(flat.view(np.uint64) != 0)
    at, step = np.nonzero(flat.reshape(-1, 8)[eights])
    return eights[at] * 8 + step


class _Side:
    """One side of a pair of blocks: its rows, and their running top-k lists (score, id) over tiles of the other side.

    ``cut`` bounds each row's k-th best score.  Candidates of a tile wait until there are twice as many as list entries;
    then they are merged at once."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, cut: np.ndarray | None, k: int, metric: str):
        self.ids, self.v, self.k, self.metric = ids, v, k, metric
        self.cut = np.full(len(ids), np.inf) if cut is None else cut.astype(float)
        self.s, self.i = np.full((len(ids), k), np.inf), np.full((len(ids), k), -1, dtype=np.int64)
        self.wait: dict[int, list] = {}
        self.norm = np.sqrt((v * v).sum(1))

    def single(self, scale: float) -> None:
        """Rows in single precision, in a unit that keeps their squares in range."""
        self.v32 = (self.v / scale).astype(np.float32)

    def add(self, part: slice, other: "_Side", o: slice, tile: np.ndarray, scale: float) -> None:
        """``tile``: single-precision scores of the rows ``part`` against the other side's rows ``o``; it only picks candidates.

        Scores from it may be off by ``slack``; pairs within that of the k-th best are rescored by plain differences.  Where it
        can't tell them apart (groups far from each other, equal rows) the tile is done in double precision."""
        nq, nc = tile.shape
        slack = (self.v.shape[1] + 8) * np.finfo(np.float32).eps * ((self.norm[part] + other.norm[o].max()) / scale) ** 2
        with np.errstate(over="ignore"):
            cut = (self.cut[part] / (scale * scale) + slack).astype(np.float32)
        if not np.isfinite(cut).all() and self.k < nc:
            kth = np.partition(tile, self.k - 1, axis=1)[:, self.k - 1]
            cut = np.fmin(cut, (kth + 2 * slack).astype(np.float32))
        cut = np.nextafter(cut, np.float32(np.inf))
        close = tile <= cut[:, None]
        if np.count_nonzero(close) > 4 * self.k * nq:
            self.rank(part, other, o)
            return
        flat = _few_set(close if close.flags.c_contiguous else close.T)
        r, c = np.divmod(flat, nc) if close.flags.c_contiguous else np.divmod(flat, nq)[::-1]
        s = _rescored(self.v[part], other.v[o], r, c)
        keep = (s <= self.cut[part][r]) & (self.ids[part][r] != other.ids[o][c]) & np.isfinite(s)
        self.later(part, nq, r[keep], s[keep], other.ids[o][c[keep]])

    def rank(self, part: slice, other: "_Side", o: slice, tile: np.ndarray | None = None) -> None:
        """The k best of a tile in double precision."""
        v = self.v[part]
        r, c, s, _ = _nearest(v, other.v[o], self.ids[part], other.ids[o], self.k, self.metric, self.cut[part], tile)
        self.later(part, len(v), r, s, other.ids[o][c])

    def later(self, part: slice, nq: int, r: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        waiting = self.wait.setdefault(part.start, [])
        waiting.append((r, s, i))
        if sum(len(w[0]) for w in waiting) >= 2 * self.k * nq:
            self.merge(part.start, nq)

    def merge(self, start: int, n: int) -> None:
        new, part = self.wait.pop(start), slice(start, start + n)
        r = np.concatenate([np.repeat(np.arange(n), self.k), *[w[0] for w in new]])
        s, i = (np.concatenate([own[part].ravel(), *[w[at] for w in new]]) for at, own in ((1, self.s), (2, self.i)))
        order = np.lexsort((i, s, r))
        r, s, i = r[order], s[order], i[order]
        rank = np.arange(len(r)) - np.searchsorted(r, np.arange(n))[r]
        keep = rank < self.k  # a row has at least its k entries
        self.s[part], self.i[part] = s[keep].reshape(n, self.k), i[keep].reshape(n, self.k)
        self.cut[part] = np.minimum(self.cut[part], self.s[part, -1])

    def finish(self, chunk_rows: int) -> None:
        for start in list(self.wait):
            self.merge(start, min(chunk_rows, len(self.ids) - start))


def _pair_lists(k: int, metric: str, chunk_rows: int):
    """One unordered block pair (a, b): every distance is computed once, in tiles of ``chunk_rows`` rows of both sides,
    and the rows of both sides keep a running top-k.  Beside the two blocks, memory is a few tiles, whatever the blocks' size."""
    def run(pdf: pd.DataFrame) -> list:
        if len(pdf) == 0:
            return []
        a_blk, b_blk = pdf["pa"].iloc[0], pdf["pb"].iloc[0]
        diagonal = a_blk == b_blk          # from the group key, never from an empty side
        left = pdf[pdf["blk"] == a_blk]
        right = pdf[pdf["blk"] == b_blk]
        if len(left) == 0 or (not diagonal and len(right) == 0):
            return []
        sides = [_Side(x["id"].to_numpy().astype(np.int64), np.stack(x["v"].to_numpy()).astype(float),
                       x["cut"].to_numpy() if "cut" in x else None, k, metric) for x in ([left] if diagonal else [left, right])]
        one, two = sides[0], sides[-1]
        scale = 1.0
        if metric == "euclidean":
            scale = max([float(np.nanmax(np.where(np.isfinite(x.norm), x.norm, 0.0))) for x in sides]) or 1.0
            for side in sides:
                side.single(scale)
        repeated = diagonal and len(np.unique(one.ids)) < len(one.ids)
        for l0 in range(0, len(one.ids), chunk_rows):
            own = slice(l0, l0 + chunk_rows)
            for r0 in range(l0 if diagonal else 0, len(two.ids), chunk_rows):
                other = slice(r0, r0 + chunk_rows)
                both = not diagonal or r0 > l0
                if metric != "euclidean":
                    tile = _scores(one.v[own], two.v[other], metric)
                    one.rank(own, two, other, tile)
                    if both:
                        two.rank(other, one, own, tile.T)
                    continue
                tile = _scores(one.v32[own], two.v32[other], metric)
                if repeated or diagonal and l0 == r0:
                    tile[one.ids[own][:, None] == two.ids[other][None, :]] = np.inf
                one.add(own, two, other, tile, scale)
                if both:
                    two.add(other, one, own, tile.T, scale)
        for side in sides:
            side.finish(chunk_rows)
        return sides
    return run


def _pair_topk(k: int, metric: str, chunk_rows: int = CHUNK_ROWS):
    """The lists of a block pair, a row an entry."""
    lists = _pair_lists(k, metric, chunk_rows)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [(np.repeat(x.ids, k), x.i.ravel(), x.s.ravel()) for x in lists(pdf)]
        if not found:
            return pd.DataFrame({"id": [], "nid": [], "score": []})
        out = pd.DataFrame({c: np.concatenate([f[at] for f in found]) for at, c in enumerate(("id", "nid", "score"))})
        return out[np.isfinite(out["score"])]
    return run


#: Lists as their bytes, a row each: a row of them costs as much to shuffle as one entry.
PACKED = "id long, nids binary, scores binary"


def _packed(x: _Side) -> pd.DataFrame:
    some = np.isfinite(x.s)
    return pd.DataFrame({"id": x.ids, "nids": [i[m].tobytes() for i, m in zip(x.i, some)], "scores": [s[m].tobytes() for s, m in zip(x.s, some)]})


def _pair_packed(k: int, metric: str, chunk_rows: int = CHUNK_ROWS):
    """The lists of a block pair that are not empty, a row a list (``PACKED``)."""
    lists = _pair_lists(k, metric, chunk_rows)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [_packed(x)[np.isfinite(x.s[:, 0])] for x in lists(pdf)]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"id": [], "nids": [], "scores": []}, dtype=object)
    return run


def _own_lists(k: int, metric: str, chunk_rows: int = CHUNK_ROWS):
    """The rows of a block with their lists among its own rows, and the bound on the k-th best score that they give."""
    lists = _pair_lists(k, metric, chunk_rows)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side, = lists(pdf.assign(pa=pdf["blk"], pb=pdf["blk"]))
        return _packed(side).assign(v=pdf["v"].to_numpy(), blk=pdf["blk"].to_numpy(), cut=side.cut)
    return run


def _block_lists(keyed: DataFrame, pairs, k: int, metric: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Lists (``PACKED``) of the rows ``id, v, blk`` in their own block first, then in the pairs of different blocks that
    ``pairs`` makes of them: there the own lists bound what can be a neighbor, so that few candidates are looked at."""
    own = cut_lineage(keyed.groupBy("blk").applyInPandas(_own_lists(k, metric, chunk_rows), f"{PACKED}, v array<double>, blk int, cut double"))
    paired = pairs(own.select("id", "v", "blk", "cut")).where("pa < pb").select("id", "v", "blk", "cut", "pa", "pb")
    return own.select("id", "nids", "scores").unionByName(paired.groupBy("pa", "pb").applyInPandas(_pair_packed(k, metric, chunk_rows), PACKED))


def _merge_packed(k: int):
    """The k best entries by (score, nid) of each id's lists."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.repeat(pdf["id"].to_numpy().astype(np.int64), [len(x) // 8 for x in pdf["nids"]])
        nid, s = np.frombuffer(b"".join(pdf["nids"]), np.int64), np.frombuffer(b"".join(pdf["scores"]), float)
        order = np.lexsort((nid, s, ids))
        ids, nid, s = ids[order], nid[order], s[order]
        rank = np.arange(len(ids)) - np.searchsorted(ids, ids) + 1
        keep = rank <= k
        return pd.DataFrame({"id": ids[keep], "rank": rank[keep].astype(np.int32), "nid": nid[keep], "score": s[keep]})
    return run


def knn_exact(df: DataFrame, k: int, id_col: str = "id", vec_col: str = "features",
              metric: str = "euclidean", block_rows: int = 16384, n_blocks: int | None = None,
              strategy: str = "blocks", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """K1: ``(id, rank, neighbor_id, distance)`` for the k nearest other rows of every row.

    Rows are hashed into B blocks of about ``block_rows`` rows, but no more than ``BLOCKS``
    (larger blocks then, of at most ``MAX_BLOCK_ROWS`` rows); every unordered
    block pair (a <= b) meets once, so each row is shuffled B times and each
    distance is computed once.  ``distance`` is euclidean (``similarity`` for
    ``metric='cosine'``).  Ties go to the lower neighbor id; a row is never its
    own neighbor (D11).  Exact search is O(n^2) work by nature, but what is shuffled
    grows with n (B copies and B lists of a row, up to ``BLOCKS * MAX_BLOCK_ROWS`` rows), and
    a task holds two blocks plus a few tiles of ``chunk_rows`` x ``chunk_rows`` distances.

    ``strategy='pivot'`` gives the same result with pivot cells and triangle-inequality
    pruning of cell pairs (``knn_pivot``): worth it for low-dimensional or clustered
    data, where it skips most pairs; in dozens of unclustered dimensions the bounds
    prune nothing and the hash blocks are cheaper.
    """
    if strategy not in ("blocks", "pivot"):
        raise ValueError("strategy must be 'blocks' or 'pivot'")
    if metric == "euclidean":
        # distances keep their digits when the data lies far from the origin: shift by about the mean,
        # a multiple of a power of two near the spread, which leaves equal distances equal
        from .linalg import Scaler, vector_stats
        mean, std, _ = vector_stats(df, vec_col)
        if len(mean):
            unit = 2.0 ** np.floor(np.log2(np.where(std > 0, std, np.maximum(np.abs(mean), 1.0))))
            df = Scaler(np.round(mean / unit) * unit, np.ones(len(mean))).apply(df.select(id_col, vec_col), vec_col)
    if strategy == "pivot":
        return knn_pivot(df, k, id_col, vec_col, metric, block_rows)
    num, mapping = numeric_ids(df.select(id_col, vec_col), id_col)
    base = num.select(F.col("_nid").alias("id"), as_doubles(vec_col).alias("v"))
    if metric == "cosine":
        base = base.withColumn("v", l2_normalize("v"))
    n = base.count()
    if n_blocks is None:
        n_blocks = block_count(n, block_rows)
    keyed = base.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))

    def pairs(rows: DataFrame) -> DataFrame:
        dealt = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("j"))
        return dealt.select("*", F.least("blk", "j").alias("pa"), F.greatest("blk", "j").alias("pb"))
    part = _block_lists(keyed, pairs, k, metric, chunk_rows)
    return _named_lists(topk_merge(part, ["id"], k, packed=n), mapping, metric, id_col)


def _named_lists(top: DataFrame, mapping: DataFrame | None, metric: str, id_col: str) -> DataFrame:
    """The merged lists with the ids of the input and ``distance`` or ``similarity``."""
    dist = F.sqrt(F.greatest(F.col("score"), F.lit(0.0))) if metric == "euclidean" else -F.col("score")
    dname = "distance" if metric == "euclidean" else "similarity"
    res = top.select("id", "rank", "nid", dist.alias(dname))
    if mapping is not None:
        res = _back(res, mapping, {"id": "__id", "nid": "__nid"}).select(
            F.col("__id").alias("id"), "rank", F.col("__nid").alias("nid"), dname)
    return res.select(F.col("id").alias(id_col), "rank", F.col("nid").alias("neighbor_id"), dname)


# ---- pivot-pruned exact kNN -------------------------------------------------------

MAX_PIVOTS = 4096
COPIES = 2 * BLOCKS  # copies of a row, on average, beyond which fewer and larger cells are taken


def _assign_cells(pivots: np.ndarray):
    """Nearest pivot and the distance to it, per row."""
    pp = (pivots * pivots).sum(1)

    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf["v"].to_numpy()).astype(float)
            cell = np.empty(len(x), dtype=np.int64)
            dp = np.empty(len(x))
            for r0 in range(0, len(x), CHUNK_ROWS):      # rows x pivots distances per chunk
                xc = x[r0:r0 + CHUNK_ROWS]
                d2 = (xc * xc).sum(1)[:, None] - 2.0 * (xc @ pivots.T) + pp[None, :]
                own = np.argmin(d2, axis=1)  # any pivot does; the distance to it must be exact
                cell[r0:r0 + len(xc)] = own
                dp[r0:r0 + len(xc)] = np.sqrt(((xc - pivots[own]) ** 2).sum(1))
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "v": pdf["v"], "cell": cell.astype(np.int32),
                                "dp": dp})
    return run


def candidate_cells(pivots: np.ndarray, counts: np.ndarray, radius: np.ndarray, k: int,
                    slack: float = 1e-9) -> list[np.ndarray]:
    """For every cell a, the cells b that may hold one of the k nearest neighbors of a member of a.

    Upper bound on a member's k-th neighbor distance: every point of cell b lies within
    ``r_a + d(p_a, p_b) + r_b`` of any member of a, so walking cells by that bound
    until k + 1 points are covered bounds the k-th distance (theta_a).  Cell b is a
    candidate when the lower bound ``d(p_a, p_b) - r_a - r_b`` does not exceed theta_a.
    Exactness does not depend on the pivots; only the amount of pruning does.
    """
    live = counts > 0
    out = []
    for a in range(len(pivots)):
        if not live[a]:
            out.append(np.empty(0, dtype=np.int64))
            continue
        dpp = np.sqrt(((pivots - pivots[a]) ** 2).sum(1))
        reach = radius[a] + dpp + radius             # every point of b is within this of any x in a
        reach = np.where(live, reach, np.inf)
        order = np.argsort(reach, kind="stable")
        covered = np.cumsum(counts[order])
        enough = np.searchsorted(covered, k + 1)     # self is one of the covered points
        theta = reach[order[enough]] if enough < len(order) else np.inf
        lower = dpp - radius[a] - radius
        tol = slack * (1.0 + abs(theta)) if np.isfinite(theta) else 0.0
        out.append(np.nonzero(live & (lower <= theta + tol))[0])
    return out


def _cell_pairs(cands: list[np.ndarray], counts: np.ndarray, subs: np.ndarray) -> tuple[np.ndarray, float]:
    """Which cells meet (either lists the other as a candidate: a pair serves both), and the copies of a row on average."""
    meet = np.zeros((len(cands), len(cands)), dtype=bool)
    for a, bs in enumerate(cands):
        meet[a, bs] = True
    meet |= meet.T
    return meet, float(counts @ (meet @ subs)) / max(1.0, float(counts.sum()))


def knn_pivot(df: DataFrame, k: int, id_col: str = "id", vec_col: str = "features",
              metric: str = "euclidean", block_rows: int = 4096, n_pivots: int | None = None,
              seed: int = 42) -> DataFrame:
    """K1, exact, with pivot pruning: the same result as ``knn_exact``.

    1. ``n_pivots`` rows in seeded md5 order are pivots (<= MAX_PIVOTS, shipped to tasks);
       every row joins the cell of its nearest pivot.
    2. Per cell: row count and radius (one small aggregation, <= n_pivots rows).
    3. ``candidate_cells`` keeps only cell pairs whose distance lower bound can beat the
       cell's proven k-th neighbor bound (triangle inequality; cosine runs as euclidean
       on unit vectors, which orders neighbors identically).
    4. Cells are split into blocks of <= block_rows rows (a hot cell becomes many
       bounded groups); each unordered pair of blocks whose cells meet is one grouped task, as in ``knn_exact``.

    Where so little is pruned that a row would be copied into more than ``COPIES`` pairs on average (dozens of
    unclustered dimensions), steps 1 to 4 start again with ``BLOCKS`` pivots and blocks to match: all pairs of
    blocks may then meet, with at most about ``COPIES`` copies of a row up to ``BLOCKS * MAX_BLOCK_ROWS`` rows.
    """
    num, mapping = numeric_ids(df.select(id_col, vec_col), id_col)
    base = num.select(F.col("_nid").alias("id"), as_doubles(vec_col).alias("v"))
    if metric == "cosine":
        base = base.withColumn("v", l2_normalize("v"))
    n = base.count()
    coarse = block_count(n, block_rows)
    tries = [(n_pivots or math.ceil(n / block_rows), max(block_rows, math.ceil(n / MAX_PIVOTS))), (coarse, math.ceil(n / coarse))]
    for last, (wanted, rows) in enumerate(tries):
        P = int(min(MAX_PIVOTS, max(1, wanted)))
        piv_rows = hash_sample(base, "id", P, seed).select("v").collect()
        pivots = np.array([r["v"] for r in piv_rows], dtype=float)
        P = len(pivots)
        cells = cut_lineage(base.mapInPandas(_assign_cells(pivots), "id long, v array<double>, cell int, dp double"))
        counts = np.zeros(P, dtype=np.int64)
        radius = np.zeros(P)
        for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("dp").alias("r")).collect():
            counts[r["cell"]] = r["n"]
            radius[r["cell"]] = r["r"]
        cands = candidate_cells(pivots, counts.astype(float), radius, k)
        subs = np.ceil(counts / max(1, rows)).astype(np.int64)
        meet, copies = _cell_pairs(cands, counts, subs)
        if last or copies <= COPIES:
            break
    offs = np.concatenate([[0], np.cumsum(subs)]).astype(np.int64)
    spark = df.sparkSession
    blocks = spark.createDataFrame([(c, int(offs[c]), int(subs[c])) for c in range(P) if subs[c]], "cell int, off int, subs int")
    keyed = cells.join(F.broadcast(blocks), "cell").select(
        "id", "v", (F.col("off") + F.pmod(F.xxhash64("id"), F.col("subs"))).cast("int").alias("blk"))
    cell_of = np.repeat(np.arange(P), subs)
    pairs = [(x, *sorted((x, int(y)))) for x in range(len(cell_of)) for y in np.flatnonzero(meet[cell_of[x]][cell_of])]
    met = F.broadcast(spark.createDataFrame(pairs, "blk int, pa int, pb int"))  # COPIES a block or so
    part = _block_lists(keyed, lambda rows: rows.join(met, "blk"), k, metric)
    return _named_lists(topk_merge(part, ["id"], k, packed=n), mapping, metric, id_col)


# ---- query samples -----------------------------------------------------------------

def _codes(*ids: np.ndarray) -> list[np.ndarray]:
    """Integers in the order of the ids (of any orderable type), the same for equal ids."""
    if all(i.dtype != object for i in ids):
        return list(ids)
    _, code = np.unique(np.concatenate([i.ravel() for i in ids]), return_inverse=True)
    cuts = np.cumsum([i.size for i in ids])[:-1]
    return [c.reshape(i.shape) for c, i in zip(np.split(code, cuts), ids)]


def _merge_topk(best, new, k):
    """Keep the k best (score, id) per query row of two candidate sets."""
    if best is None:
        return new
    s = np.concatenate([best[0], new[0]], axis=1)
    i = np.concatenate([best[1], new[1]], axis=1)
    order = np.lexsort((_codes(i)[0], s), axis=-1)[:, :k]
    return np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)


def _emit(best, qid, kind):
    if best is None:  # object columns: empty ones of any other type may not become strings
        return pd.DataFrame(columns=["qid", "nid", "score", "kind"], dtype=object)
    s, i = best
    keep = np.isfinite(s)
    q = np.repeat(qid, s.shape[1]).reshape(s.shape)
    return pd.DataFrame({"qid": q[keep], "nid": i[keep], "score": s[keep], "kind": kind})


QUERY_CHUNK = 1024  # queries scored at once against an Arrow batch (chunk x batch doubles)


class _Queries:
    """Running top-k of some queries over blocks of the corpus, scored in chunks of QUERY_CHUNK queries."""

    def __init__(self, ids: np.ndarray, vec: np.ndarray, codes: np.ndarray | None, k: int, metric: str, only: str | None = None):
        self.ids, self.vec, self.codes, self.k, self.metric = ids, vec, codes, k, metric
        self.starts = list(range(0, len(ids), QUERY_CHUNK))
        kinds = [only] if only else ["all"] if codes is None else ["all", "cand"]
        self.best = {kind: [None] * len(self.starts) for kind in kinds}

    def add(self, cid: np.ndarray, c: np.ndarray, codes: np.ndarray | None) -> None:
        own, other = _codes(self.ids, cid)
        for at, q0 in enumerate(self.starts):
            part = slice(q0, q0 + QUERY_CHUNK)
            score = _scores(self.vec[part], c, self.metric)
            kinds = {"all": score}
            if self.codes is not None:  # J9: a shared token at any level
                share = np.zeros(score.shape, dtype=bool)
                for level in range(self.codes.shape[1]):
                    share |= self.codes[part, level][:, None] == codes[:, level][None, :]
                kinds["cand"] = np.where(share, score, np.inf)
            for kind in self.best:
                own_score = kinds[kind]
                r, col, s, rank = _nearest(self.vec[part], c, own[part], other, self.k, self.metric, score=own_score)
                m = min(self.k, len(cid))
                dense_s, dense_i = np.full((len(score), m), np.inf), np.full((len(score), m), cid[0], dtype=cid.dtype)
                dense_s[r, rank - 1], dense_i[r, rank - 1] = s, cid[col]
                self.best[kind][at] = _merge_topk(self.best[kind][at], (dense_s, dense_i), self.k)

    def rows(self) -> pd.DataFrame:
        out = [_emit(best, self.ids[q0:q0 + QUERY_CHUNK], kind) for kind, parts in self.best.items()
               for q0, best in zip(self.starts, parts) if best is not None]
        return pd.concat(out, ignore_index=True) if out else _emit(None, None, None)


def _columns(pdf: pd.DataFrame, with_codes: bool):
    ids = pdf["id"].to_numpy()
    return ids if ids.dtype.kind in "iu" else ids.astype(object), np.stack(pdf["v"].to_numpy()).astype(float), (
        np.stack(pdf["codes"].to_numpy()).astype(np.int64) if with_codes else None)


def _query_topk(qid, qvec, qcodes, k: int, metric: str):
    """Per partition: a running top-k per query over all its batches, emitted once."""
    def run(batches):
        queries = _Queries(qid, qvec, qcodes, k, metric)
        for pdf in batches:
            if len(pdf):
                queries.add(*_columns(pdf, qcodes is not None))
        yield queries.rows()
    return run


def _block_topk(k: int, metric: str, with_codes: bool, block_rows: int):
    """One (query block, corpus block): the queries' top-k among the block's corpus rows."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, c = pdf[pdf["query"]], pdf[~pdf["query"]]
        if len(q) == 0 or len(c) == 0:
            return _emit(None, None, None)
        queries = _Queries(*_columns(q, with_codes), k, metric)
        for lo in range(0, len(c), block_rows):
            queries.add(*_columns(c.iloc[lo:lo + block_rows], with_codes))
        return queries.rows()
    return run


MERGED_IDS = 4096  # ids whose packed lists are merged in one group


def topk_merge(df: DataFrame, keys: list[str], k: int, fanout: int = 256, lists: int | None = None,
               packed: int | None = None) -> DataFrame:
    """Two-level top-k by (score, nid) per key: partial lists are first merged within
    ``fanout`` groups of source partitions, so no final group exceeds fanout * k rows.
    Keys known to have no more than ``lists`` <= ``fanout`` partial lists are merged at once.
    ``packed``: the number of ids where ``df`` has a row a list (``PACKED``); groups of about MERGED_IDS ids are merged."""
    if packed is not None:
        group = F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(packed / MERGED_IDS)))).alias("g")
        return df.groupBy(group).applyInPandas(_merge_packed(k), "id long, rank int, nid long, score double")
    if lists is not None and lists <= fanout:
        w = Window.partitionBy(*keys).orderBy("score", "nid")
        return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    g = F.pmod(F.spark_partition_id(), F.lit(fanout))
    w1 = Window.partitionBy(*keys, "_g").orderBy("score", "nid")
    first = (df.withColumn("_g", g).withColumn("_r", F.row_number().over(w1))
             .filter(F.col("_r") <= k).drop("_r", "_g"))
    w2 = Window.partitionBy(*keys).orderBy("score", "nid")
    return first.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k)


def query_topk(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "id",
               vec_col: str = "features", metric: str = "cosine", codes_col: str | None = None,
               normalize: bool = True, block_rows: int = 8192, few: int | None = None) -> DataFrame:
    """K2 (and the scoring half of K4): top-k corpus rows for each query row, for any number of queries.

    Up to ``few`` (``FEW_QUERIES``) queries, counted, are shipped to the tasks and the corpus is scanned once.  More are dealt into
    blocks (``block_count``: no more than ``BLOCKS`` until they are large), as is the corpus; each pair of blocks is one
    grouped task, so a query is copied once per corpus block and a corpus row once per query block, and nothing reaches the driver.  Output ``qid,
    kind, rank, nid, score`` where ``kind`` is ``all`` or (with ``codes_col``) ``cand``: only
    rows sharing a token with the query at some level.  Ties go to the lower id, in the order of the id's own type.
    """
    vec = l2_normalize(as_doubles(vec_col)) if normalize and metric == "cosine" else as_doubles(vec_col)
    cols = [F.col(id_col).alias("id"), vec.alias("v")] + ([F.col(codes_col).alias("codes")] if codes_col else [])
    kind = corpus.schema[id_col].dataType.simpleString()
    corpus, queries = corpus.select(*cols), queries.select(*cols)
    schema = f"qid {kind}, nid {kind}, score double, kind string"
    few, lists = FEW_QUERIES if few is None else few, None
    if few and queries.limit(few + 1).count() <= few:
        rows = queries.toPandas()
        if not len(rows):
            return corpus.sparkSession.createDataFrame([], f"qid {kind}, kind string, rank int, nid {kind}, score double")
        part = corpus.mapInPandas(_query_topk(*_columns(rows, codes_col is not None), k, metric), schema)
    else:
        n_q, n_c = (block_count(x.count(), block_rows) for x in (queries, corpus))

        def dealt(df: DataFrame, is_query: bool) -> DataFrame:
            own, other = ("qb", "cb") if is_query else ("cb", "qb")
            n_own, n_other = (n_q, n_c) if is_query else (n_c, n_q)
            return df.select("*", F.lit(is_query).alias("query"), F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int").alias(own),
                             F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))
        both = dealt(queries, True).unionByName(dealt(corpus, False))
        part = both.groupBy("qb", "cb").applyInPandas(_block_topk(k, metric, codes_col is not None, block_rows), schema)
        lists = n_c
    top = topk_merge(part, ["qid", "kind"], k, lists=lists)
    sc = -F.col("score") if metric == "cosine" else F.col("score")
    return top.select("qid", "kind", "rank", "nid", sc.alias("score"))


def token_candidates(codes: DataFrame, queries: DataFrame, id_col: str = "id",
                     codes_col: str = "codes") -> DataFrame:
    """``(qid, id)`` rows sharing a token with the query at ANY level, self excluded.

    Up to ``FEW_QUERIES`` queries (counted) the query side is broadcast and the corpus side
    streamed once, so a token that holds a third of all rows is no hot spot; beyond that the
    sides meet in a shuffle join, whose hot tokens adaptive execution splits.
    """
    few = queries.limit(FEW_QUERIES + 1).count() <= FEW_QUERIES
    q = queries.select(F.col(id_col).alias("qid"),
                       F.posexplode(codes_col).alias("level", "token"))
    c = codes.select(F.col(id_col).alias("id"), F.posexplode(codes_col).alias("level", "token"))
    pairs = c.join(F.broadcast(q) if few else q, ["level", "token"]).filter(F.col("qid") != F.col("id"))
    return pairs.select("qid", "id").distinct()


def index_recall(df: DataFrame, k: int = 10, n_queries: int = 50, seed: int = 42,
                 id_col: str = "id", vec_col: str = "features", codes_col: str = "codes",
                 detail: bool = False) -> DataFrame:
    """K4: mean over sampled queries of |exact top-k ∩ top-k among token candidates| / k.

    Cosine on L2-normalized rows; a query without candidates scores 0 (and
    with fewer than k other rows the overlap is still divided by k, D12).
    """
    spark = df.sparkSession
    # the bounded sample is fetched once and reused (no second evaluation of the sample plan)
    qrows = hash_sample(df, id_col, n_queries, seed).select(id_col, vec_col, codes_col).collect()
    schema = df.select(id_col, vec_col, codes_col).schema
    queries = spark.createDataFrame(qrows, schema)
    top = query_topk(df, queries, k, id_col, vec_col, "cosine", codes_col)
    # a neighbor in both lists appears under both kinds: one aggregation over the
    # top-k rows (splitting them into two joined branches would scan the corpus twice)
    both = top.groupBy("qid", "nid").agg(F.count_distinct("kind").alias("kinds")).filter(F.col("kinds") == 2)
    hits = both.groupBy("qid").agg(F.count("*").alias("hits"))
    from pyspark.sql.types import StructField, StructType
    qids = spark.createDataFrame([(r[id_col],) for r in qrows],
                                 StructType([StructField("qid", schema[id_col].dataType)]))
    per_q = (qids.join(hits, "qid", "left")
             .select("qid", (F.coalesce(F.col("hits"), F.lit(0)) / F.lit(float(k))).alias("recall")))
    if detail:
        return per_q
    return per_q.agg(F.avg("recall").alias("recall"), F.count("*").alias("n_queries"))
