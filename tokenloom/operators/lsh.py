"""Approximate nearest neighbors (K1) by p-stable projections with multi-probe.

1. Each of several tables hashes a row by a sequence of ``floor((a . x + b) / width)`` with Gaussian ``a``: near rows
   agree in many of them.  ``width`` is a multiple of the typical distance to the k-th neighbor, from a
   bounded sample of queries that are also answered exactly.
2. A row starts in the bucket of its first hash.  Buckets with more than ``bucket_rows`` rows are split by the next hash,
   level by level; what is counted are prefixes, and only those of such buckets are kept.  So buckets are small in dense
   regions and wide in sparse ones.  Beyond ``DEPTH`` hashes rows are all but equal: such a bucket is dealt into parts of
   ``bucket_rows`` rows, each compared with itself and the next one.
3. As a query a row also probes the buckets across the nearest boundaries of its first hashes (``probes`` of them) and
   follows them down by its own further hashes.
4. Each bucket is a grouped task of bounded size: its corpus rows (at most ``bucket_rows``) meet its queries
   (in parts of 4 x ``bucket_rows``), scores are exact distances, k a query leave the task, and the lists of
   all buckets are merged.
5. The sampled queries are looked up first, in all tables, and the smallest number of tables that reaches the wanted
   recall on them is used for all rows.  This counts rows in the buckets that these queries visit and nothing
   else: two passes over the rows, no row is copied.  The recall measured is returned beside the rows.  Where
   even all tables miss it, the exact block join answers.

Rows that are compared grow with n x bucket_rows x tables x (1 + probes), not with the square of n.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_doubles
from ..session import cut_lineage
from .neighbors import _nearest, _rescored, _scores, knn_exact, numeric_ids, query_topk, topk_merge
from .sample import hash_sample

#: Hashes of a table, and how many of the first ones are probed across their boundaries.
DEPTH, PROBED = 24, 6
SAMPLE = 200  # queries answered exactly, at most


@dataclass
class Report:
    """What the search did: recall on the sampled queries, tables used (0: exact), pairs compared and of all pairs."""

    recall: float
    tables: int
    pairs: int
    all_pairs: int


def _sequences(x: np.ndarray, planes: np.ndarray, offsets: np.ndarray, width: float, probes: int) -> list[np.ndarray]:
    """In one table: the hash sequence of each row, and as further variants those of its probes."""
    at = (x @ planes + offsets) / width
    h = np.floor(at)
    inside = (at - h)[:, :PROBED]
    h = np.clip(h, -32_768, 32_767).astype(np.int16)
    gap = np.minimum(inside, 1 - inside)
    nearest = np.argsort(gap, axis=1)[:, :probes] if probes else np.empty((len(x), 0), int)
    rows, out = np.arange(len(x)), [h]
    for c in nearest.T:
        own = h.copy()
        own[rows, c] += np.where(inside[rows, c] < 0.5, -1, 1).astype(np.int16)
        out.append(own)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prefixes(h: np.ndarray, table: int) -> np.ndarray:
    """A number for each prefix of the hash sequences: rows x DEPTH."""
    out, key = np.empty(h.shape, np.int64), np.full(len(h), table + 1, np.uint64)
    for level in range(h.shape[1]):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + h[:, level].astype(np.uint16))
        out[:, level] = key.view(np.int64)
    return out


def _places(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``keys`` in the sorted ``known``, and which of them are there."""
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return at, (known[at] == keys if len(known) else np.zeros(len(keys), bool))


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    known, at = np.unique(np.concatenate(keys), return_inverse=True)
    return known, np.bincount(at, weights=np.concatenate(n), minlength=len(known)).astype(np.int64)


def _counted(planes: np.ndarray, offsets: np.ndarray, width: float, over: list, levels: range):
    """``level``, ``key``, ``n``: rows of a partition at the prefixes of these levels, below those that have too many (``over``)."""
    def run(batches):
        total = {level: ([np.empty(0, np.int64)], [np.empty(0)]) for level in levels}
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["v"].to_numpy()).astype(float)
            for t in range(len(planes)):
                keys = _prefixes(_sequences(x, planes[t], offsets[t], width, 0)[0], t)
                if levels[0]:
                    keys = keys[_places(over[levels[0] - 1][0], keys[:, levels[0] - 1])[1]]
                for level in levels:
                    known, n = np.unique(keys[:, level], return_counts=True)
                    total[level][0].append(known)
                    total[level][1].append(n)
            for level in levels:
                known, n = _summed(*total[level])
                total[level] = [known], [n]
        for level, (keys, n) in total.items():
            yield pd.DataFrame({"level": level, "key": keys[0], "n": n[0].astype(np.int64)})
    return run


LEVELS = 4  # counted in a pass over the rows


def _over(base: DataFrame, planes: np.ndarray, offsets: np.ndarray, width: float, bucket_rows: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By level the prefixes with more than ``bucket_rows`` rows, and their rows: n x tables / ``bucket_rows`` a level at most."""
    over: list = []
    while len(over) < DEPTH:
        levels = range(len(over), min(DEPTH, len(over) + LEVELS))
        part = base.select("v").mapInPandas(_counted(planes, offsets, width, over, levels), "level int, key long, n long")
        found = part.groupBy("level", "key").agg(F.sum("n").alias("n")).where(F.col("n") > bucket_rows).toPandas().sort_values("key")
        for level in levels:
            own = found[found["level"] == level]
            over.append((own["key"].to_numpy().astype(np.int64), own["n"].to_numpy().astype(np.int64)))
        if not len(over[-1][0]):
            break
    return over


def _dealt(planes: np.ndarray, offsets: np.ndarray, width: float, probes: int, over: list, bucket_rows: int):
    """``tab``, ``id``, ``corpus``, ``bucket``: each row, and its probes, in the bucket where the path ends."""
    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x, ids, deal = np.stack(pdf["v"].to_numpy()).astype(float), pdf["id"].to_numpy(), pdf["deal"].to_numpy()
            out = []
            for t in range(len(planes)):
                home = None
                for variant, h in enumerate(_sequences(x, planes[t], offsets[t], width, probes)):
                    keys, left = _prefixes(h, t), np.arange(len(x))
                    deep, parts = np.zeros(len(x), np.int64), np.ones(len(x), np.int64)
                    for level, (known, n) in enumerate(over):
                        at, there = _places(known, keys[left, level])
                        left = left[there]
                        deep[left] = level + 1
                        if level == DEPTH - 1:  # all but equal rows: parts, each with itself and the next
                            parts[left] = -(-n[at[there]] // bucket_rows)
                    bucket = keys[np.arange(len(x)), np.minimum(deep, DEPTH - 1)]
                    home = bucket if variant == 0 else home
                    # a probe that changes a hash below its leaf is the row itself again
                    some = np.flatnonzero((bucket != home) | (variant == 0))
                    part = np.mod(deal, parts)
                    for step in (0, 1):
                        rows = some if step == 0 else some[parts[some] > 1]
                        own = np.where(parts[rows] > 1, np.mod(part[rows] + step, parts[rows]) + 1, 0).astype(np.uint64)
                        key = np.where(own > 0, _mix(bucket[rows].view(np.uint64) + own).view(np.int64), bucket[rows])
                        out.append(pd.DataFrame({"tab": t, "id": ids[rows], "corpus": variant == 0 and step == 0, "bucket": key}))
            yield pd.concat(out, ignore_index=True)
    return run


def _leaves(base: DataFrame, planes: np.ndarray, offsets: np.ndarray, width: float, probes: int, bucket_rows: int, seed: int) -> DataFrame:
    """``tab``, ``bucket``, ``id``, ``corpus``: the buckets that each row visits, and whether it lies in them.

    The buckets that are split are counted first, LEVELS hashes a pass over the rows; then each row follows its paths by itself."""
    over = _over(base, planes, offsets, width, bucket_rows)
    dealt = base.withColumn("deal", F.xxhash64("id", F.lit(seed))).mapInPandas(
        _dealt(planes, offsets, width, probes, over, bucket_rows), "tab int, id long, corpus boolean, bucket long")
    return cut_lineage(dealt.groupBy("tab", "bucket", "id").agg(F.max("corpus").alias("corpus")))


def _grouped(leaves: DataFrame, bucket_rows: int) -> DataFrame:
    """Rows of the tasks (``bucket``, ``part``): ``id``, ``asks``, ``corpus``.  Queries of a bucket come in parts, its corpus rows go to each of them."""
    size = leaves.groupBy("bucket").agg(F.ceil(F.count_if("asks") / (4 * bucket_rows)).cast("int").alias("parts"), F.count_if("corpus").alias("n"))
    rows = leaves.join(size.where("parts > 0 AND n > 0"), "bucket")
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    asks = rows.where("asks").select("bucket", own.alias("part"), "tab", "id", F.lit(True).alias("asks"))
    held = rows.where("corpus").select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "tab", "id", F.lit(False).alias("asks"))
    return asks.unionByName(held)


def _bucket_topk(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, c = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        out = []
        if len(q) and len(c):
            cv, cid = np.stack(c["v"].to_numpy()).astype(float), c["id"].to_numpy()
            for lo in range(0, len(q), 1024):
                part = q.iloc[lo:lo + 1024]
                qv, qid = np.stack(part["v"].to_numpy()).astype(float), part["id"].to_numpy()
                r, col, s, _ = _nearest(qv, cv, qid, cid, k, "euclidean", score=_scores(qv, cv, "euclidean"))
                out.append(pd.DataFrame({"tab": pdf["tab"].iloc[0], "id": qid[r], "nid": cid[col], "score": s}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"tab": [], "id": [], "nid": [], "score": []})
    return run


def _found(leaves: DataFrame, base: DataFrame, k: int, bucket_rows: int) -> DataFrame:
    """``tab``, ``id``, ``nid``, ``score``: k neighbors of each query in each bucket that it visits."""
    rows = _grouped(leaves, bucket_rows).join(base, "id")
    return rows.groupBy("bucket", "part").applyInPandas(_bucket_topk(k), "tab int, id long, nid long, score double")


def _typical(base: DataFrame, k: int, seed: int) -> tuple[pd.DataFrame, float]:
    """Exact neighbors of the sampled queries (``qid``, ``nid``, ``score``), and the median distance of the k-th one."""
    queries = hash_sample(base, "id", SAMPLE, seed)
    exact = query_topk(base, queries, k, "id", "v", "euclidean").where("kind = 'all'").select("qid", "nid", "score").toPandas()
    far = np.sqrt(exact.groupby("qid")["score"].max().to_numpy()) if len(exact) else np.zeros(0)
    far = far[far > 0]
    return exact, float(np.median(far)) if len(far) else 1.0


class _Paths:
    """The hash sequences of the sampled queries and of their probes: in each table a tree whose nodes are the prefixes
    that some of them have.  At most SAMPLE x (1 + probes) x DEPTH nodes a table, whatever the number of rows."""

    def __init__(self, x: np.ndarray, planes: np.ndarray, offsets: np.ndarray, width: float, probes: int):
        self.planes, self.offsets, self.width = planes, offsets, width
        variants = [_sequences(x, planes[t], offsets[t], width, probes) for t in range(len(planes))]
        self.paths = np.stack([np.stack(v, axis=1) for v in variants])  # table, query, variant, hash
        self.keys, self.nodes = [], []  # by table and level: the sorted keys (parent node, hash), the node of each path
        for paths in self.paths:
            node, keys, nodes = np.zeros(paths.shape[:2], np.int64), [], []
            for level in range(DEPTH):
                known, node = np.unique(_key(node, paths[..., level]), return_inverse=True)
                node = node.reshape(paths.shape[:2])
                keys.append(known)
                nodes.append(node)
            self.keys.append(keys)
            self.nodes.append(nodes)

    def hashes(self, x: np.ndarray, table: int) -> np.ndarray:
        return _sequences(x, self.planes[table], self.offsets[table], self.width, 0)[0]

    def counts(self, batches):
        """``tab``, ``level``, ``node``, ``n``: corpus rows of a partition at the nodes."""
        total = [[np.zeros(len(k), np.int64) for k in keys] for keys in self.keys]
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["v"].to_numpy()).astype(float)
            for t, keys in enumerate(self.keys):
                h = self.hashes(x, t)
                node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
                for level, known in enumerate(keys):
                    key = _key(node, h[rows, level])
                    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    same = known[at] == key
                    node, rows = at[same], rows[same]
                    total[t][level] += np.bincount(node, minlength=len(known))
                    if not len(rows):
                        break
        for t, levels in enumerate(total):
            for level, n in enumerate(levels):
                some = np.flatnonzero(n)
                if len(some):
                    yield pd.DataFrame({"tab": t, "level": level, "node": some, "n": n[some]})

    def leaves(self, over: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """``over``: the nodes with more rows than a bucket takes.  Per table, query and variant: the hashes down to the
        bucket where the path ends, and its rows if it goes on beyond the last hash (else 0)."""
        deep, rest = np.zeros(self.paths.shape[:3], np.int64), np.zeros(self.paths.shape[:3], np.int64)
        for (t, level), part in over.groupby(["tab", "level"]):
            n = np.zeros(len(self.keys[t][level]), np.int64)
            n[part["node"].to_numpy()] = part["n"].to_numpy()
            deep[t] += n[self.nodes[t][level]] > 0
            if level == DEPTH - 1:
                rest[t] = n[self.nodes[t][level]]
        return np.minimum(deep + 1, DEPTH), rest


def _key(node: np.ndarray, h: np.ndarray) -> np.ndarray:
    return node * 65_536 + (h.astype(np.int64) + 32_768)


def _trial_hits(paths: _Paths, deep: np.ndarray, rest: np.ndarray, qid: np.ndarray, qv: np.ndarray, deal: np.ndarray,
                limit: np.ndarray, least: int, bucket_rows: int):
    """``id``, ``nid``, ``tab``: true neighbors (at most ``limit`` away) of the sampled queries and the first table in which
    they share a bucket; of each query and table no more than ``least``, as further ones do not count."""
    parts = np.maximum(-(-rest // bucket_rows), 1)

    def shared(x: np.ndarray, own: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Table by table whether row and query of a pair share a bucket."""
        out = np.empty((len(paths.keys), len(q)), bool)
        for t in range(len(out)):
            agree = (paths.hashes(x, t)[:, None] == paths.paths[t, q]).cumprod(axis=2).sum(axis=2)  # pair, variant
            ok = agree >= deep[t, q]
            n = parts[t, q]
            step = np.mod(own[:, None], n) - np.mod(deal[q][:, None], n)  # all but equal rows: parts, each with itself and the next
            out[t] = (ok & ((rest[t, q] == 0) | (step == 0) | (np.mod(step, n) == 1))).any(axis=1)
        return out

    def run(batches):
        found = pd.DataFrame({"id": [], "nid": [], "tab": []}, dtype=np.int64)
        for pdf in batches:
            for lo in range(0, len(pdf), 2048):
                part = pdf.iloc[lo:lo + 2048]
                x, nid, own = np.stack(part["v"].to_numpy()).astype(float), part["id"].to_numpy(), part["deal"].to_numpy()
                size = np.sqrt((qv * qv).sum(1)) + np.sqrt((x * x).sum(1).max())
                slack = (x.shape[1] + 8) * np.finfo(float).eps * size * size
                r, c = np.nonzero((_scores(qv, x, "euclidean") <= (limit + slack)[:, None]) & (qid[:, None] != nid[None]))
                near = _rescored(qv, x, r, c) <= limit[r]
                r, c = r[near], c[near]
                for at in range(0, len(r), 4096):
                    q, row = r[at:at + 4096], c[at:at + 4096]
                    hit = shared(x[row], own[row], q)
                    more = pd.DataFrame({"id": qid[q], "nid": nid[row], "tab": hit.argmax(axis=0)})[hit.any(axis=0)]
                    found = pd.concat([found, more]).groupby(["id", "nid"], as_index=False)["tab"].min()
                    found = found.groupby(["id", "tab"]).head(least)
        yield found[["id", "nid", "tab"]]
    return run


def _trial(base: DataFrame, exact: pd.DataFrame, planes: np.ndarray, offsets: np.ndarray, width: float, probes: int,
           least: int, bucket_rows: int, seed: int) -> pd.DataFrame:
    """``id``, ``tab``, ``hits``: how many true neighbors each sampled query finds first in which table.

    Only the queries are hashed into probes and only the buckets that they visit are looked at: two passes over the
    rows, without a shuffle of them."""
    dealt = base.withColumn("deal", F.xxhash64("id", F.lit(seed)))
    kth = exact.groupby("qid")["score"].max()
    asked = base.sparkSession.createDataFrame([(int(i),) for i in kth.index], "id long")  # at most SAMPLE rows
    queries = dealt.join(F.broadcast(asked), "id").toPandas()
    qv = np.stack(queries["v"].to_numpy()).astype(float)
    paths = _Paths(qv, planes, offsets, width, probes)
    over = (base.select("v").mapInPandas(paths.counts, "tab int, level int, node int, n long").groupBy("tab", "level", "node")
            .agg(F.sum("n").alias("n")).where(F.col("n") > bucket_rows).toPandas())
    limit = queries["id"].map(kth).to_numpy() * (1 + 1e-9) + 1e-300
    run = _trial_hits(paths, *paths.leaves(over), queries["id"].to_numpy(), qv, queries["deal"].to_numpy(), limit, least, bucket_rows)
    first = dealt.mapInPandas(run, "id long, nid long, tab int").groupBy("id", "nid").agg(F.min("tab").alias("tab"))
    return first.groupBy("id", "tab").agg(F.count("*").alias("hits")).toPandas()


def knn_lsh(df: DataFrame, k: int, id_col: str = "id", vec_col: str = "features", recall: float = 0.95, tables: int = 16,
            probes: int = 3, bucket_rows: int = 2048, width: float = 4.0, seed: int = 42) -> tuple[DataFrame, Report]:
    """K1, approximate: ``(id, rank, neighbor_id, distance)`` as ``knn_exact`` gives them, and the report.

    A row in sparse surroundings may find fewer than k neighbors.  ``recall`` is the wanted share of true neighbors (those at most as far as the k-th true one) on the sampled queries;
    ``width`` the hash width in median distances of the k-th neighbor."""
    num, mapping = numeric_ids(df.select(id_col, vec_col), id_col)
    base = cut_lineage(num.select(F.col("_nid").alias("id"), as_doubles(vec_col).alias("v")))
    n = base.count()
    if n <= bucket_rows:  # one bucket holds all
        return knn_exact(df, k, id_col, vec_col), Report(1.0, 0, n * (n - 1), n * (n - 1))
    dim = base.select(F.size("v")).first()[0]
    exact, far = _typical(base, k, seed)
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((tables, dim, DEPTH))
    offsets = rng.uniform(0, width * far, (tables, DEPTH))
    least = min(k, n - 1)
    use, reached = _tables_for(_trial(base, exact, planes, offsets, width * far, probes, least, bucket_rows, seed), exact, least, tables, recall)
    if reached < recall:
        return knn_exact(df, k, id_col, vec_col), Report(1.0, 0, n * (n - 1), n * (n - 1))
    chosen = _leaves(base, planes[:use], offsets[:use], width * far, probes, bucket_rows, seed).withColumn("asks", F.lit(True))
    work = chosen.groupBy("bucket").agg(F.count("*").alias("q"), F.count_if("corpus").alias("c")).agg(F.sum(F.col("q") * F.col("c"))).first()[0]
    rows = _found(chosen, base, k, bucket_rows).groupBy("id", "nid").agg(F.min("score").alias("score"))
    top = topk_merge(rows, ["id"], k).select("id", "rank", "nid", F.sqrt("score").alias("distance"))
    if mapping is not None:
        from .neighbors import _back
        top = _back(top, mapping, {"id": "__id", "nid": "__nid"}).select(F.col("__id").alias("id"), "rank", F.col("__nid").alias("nid"), "distance")
    return top.select(F.col("id").alias(id_col), "rank", F.col("nid").alias("neighbor_id"), "distance"), Report(reached, use, int(work), n * (n - 1))


def _tables_for(first: pd.DataFrame, exact: pd.DataFrame, least: int, tables: int, recall: float) -> tuple[int, float]:
    """The fewest first tables that reach the recall on the sampled queries, and that recall (of all tables if none does)."""
    asked, have = exact["qid"].unique(), 0.0
    for use in range(1, tables + 1):
        hits = first[first["tab"] < use].groupby("id")["hits"].sum().clip(upper=least)
        have = float(hits.reindex(asked, fill_value=0).sum()) / (least * len(asked))
        if have >= recall:
            return use, have
    return tables, have
