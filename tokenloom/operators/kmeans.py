"""K-means with all ``n_init`` restarts advanced in the same pass over the data.

MLlib fits one model per call, so ``n_init`` restarts cost ``n_init`` times the
passes.  Here every Lloyd iteration is ONE Spark job for all restarts: each Arrow
batch is assigned to its nearest center of every restart with one BLAS product
against the (restarts x K) centers, and each partition emits the per-center sums,
counts and costs.  A two-level sum brings at most 64 partial vectors of
``restarts x K x (d + 2)`` values to the driver.  The restart with the lowest
final cost wins (lowest restart index on ties).

Seeding is k-means|| over all rows, for all restarts in the same passes: each round adds
``2 x K`` rows per restart, drawn with probability proportional to their squared
distance from the candidates so far (an exponential race on a seeded hash of the row's
content, so equal rows count once and partitioning does not matter); one more pass
weights the candidates by the rows nearest to them, and weighted k-means++ on the
candidates picks K.  An empty cluster keeps its previous center.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import as_doubles
from .dictlearn import sum_partials

SEED_CHUNK = 512  # rows scored at once against one restart's candidates
ROW_CHUNK = 2048  # rows scored at once against all restart centers
MAX_CENTER_VALUES = 5_000_000  # restarts x K x d doubles shipped with each pass


def kmeans_pp(x: np.ndarray, k: int, rng: np.random.Generator, weight: np.ndarray | None = None) -> np.ndarray:
    """Weighted k-means++ on the candidates."""
    weight = np.ones(len(x)) if weight is None else weight
    centers = [x[rng.choice(len(x), p=weight / weight.sum())]]
    d2 = ((x - centers[0]) ** 2).sum(1)
    for _ in range(1, k):
        p = d2 * weight
        idx = rng.integers(len(x)) if p.sum() <= 0 else rng.choice(len(x), p=p / p.sum())
        centers.append(x[idx])
        d2 = np.minimum(d2, ((x - x[idx]) ** 2).sum(1))
    return np.array(centers)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _row_hash(x: np.ndarray) -> np.ndarray:
    """A hash of each row's content."""
    h = np.full(len(x), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for bits in np.ascontiguousarray(x + 0.0).view(np.uint64).T:
        h = _mix(h ^ bits) + np.uint64(0x9E3779B97F4A7C15)
    return h


#: Groups of partitions whose seed candidates are ranked together before all are.
SEED_GROUPS = 256


def _distances(x: np.ndarray, sets: list[np.ndarray]) -> list[np.ndarray]:
    """Squared distance of each row to each member of each set."""
    xx = (x * x).sum(1)[:, None]
    return [np.maximum(xx - 2.0 * (x @ c.T) + (c * c).sum(1)[None, :], 0.0) for c in sets]


def _race(sets: list[np.ndarray], m: int, restarts: int, salt: int, col: str):
    """Per partition and restart the ``m`` distinct rows that finish first: waiting time -log(u) / distance."""
    def run(batches):
        best = [{} for _ in range(restarts)]
        for pdf in batches:
            xb = np.stack(pdf[col].to_numpy()).astype(float) if len(pdf) else np.zeros((0, 1))
            for r0 in range(0, len(xb), SEED_CHUNK):
                x = xb[r0:r0 + SEED_CHUNK]
                h = _row_hash(x)
                near = _distances(x, sets) if sets else [None] * restarts
                for r in range(restarts):
                    u = ((_mix(h ^ _mix(np.uint64([salt * 1009 + r + 1]))) >> np.uint64(11)).astype(float) + 0.5) / 2.0 ** 53
                    w = np.ones(len(x)) if near[r] is None else near[r].min(axis=1)
                    wait = np.where(w > 0, -np.log(u) / np.where(w > 0, w, 1.0), np.inf)
                    for i in np.argsort(wait, kind="stable")[:m]:
                        if np.isfinite(wait[i]):
                            best[r][x[i].tobytes()] = (wait[i], x[i])
                    if len(best[r]) > 2 * m:
                        best[r] = dict(sorted(best[r].items(), key=lambda e: (e[1][0], e[0]))[:m])
        rows = [(r, float(w), v.tolist()) for r in range(restarts)
                for _, (w, v) in sorted(best[r].items(), key=lambda e: (e[1][0], e[0]))[:m]]
        yield pd.DataFrame(rows, columns=["r", "wait", "v"])
    return run


def _draw(data: DataFrame, sets: list[np.ndarray], m: int, restarts: int, salt: int, col: str) -> list[np.ndarray]:
    # two levels: the candidates of a group of partitions first, so no task ranks those of all partitions
    group = F.pmod(F.spark_partition_id(), F.lit(SEED_GROUPS)).alias("g")
    first = data.mapInPandas(_race(sets, m, restarts, salt, col), "r int, wait double, v array<double>").select("*", group).distinct()
    inner = F.row_number().over(Window.partitionBy("r", "g").orderBy("wait", "v"))
    first = first.withColumn("place", inner).filter(F.col("place") <= m).select("r", "wait", "v").distinct()
    place = F.row_number().over(Window.partitionBy("r").orderBy("wait", "v"))
    rows = first.withColumn("place", place).filter(F.col("place") <= m).collect()  # m rows a restart
    rows.sort(key=lambda row: (row["r"], row["place"]))
    return [np.array([row["v"] for row in rows if row["r"] == r], dtype=float) for r in range(restarts)]


def _nearest_counts(sets: list[np.ndarray], col: str):
    def run(batches):
        counts = [np.zeros(len(c)) for c in sets]
        for pdf in batches:
            xb = np.stack(pdf[col].to_numpy()).astype(float) if len(pdf) else np.zeros((0, 1))
            for r0 in range(0, len(xb), SEED_CHUNK):
                for n, d2 in zip(counts, _distances(xb[r0:r0 + SEED_CHUNK], sets)):
                    n += np.bincount(np.argmin(d2, axis=1), minlength=len(n))
        yield pd.DataFrame({"stats": [np.concatenate(counts)]})
    return run


def seed_centers(data: DataFrame, k: int, restarts: int, seed: int, col: str, rounds: int = 4) -> np.ndarray:
    """k-means||: (restarts, K, d) starting centers; fewer than ``k`` where there are fewer distinct rows."""
    sets = _draw(data, [], 1, restarts, seed, col)
    if not len(sets[0]):
        raise ValueError("empty input")
    for i in range(1, rounds + 1):
        new = _draw(data, sets, 2 * k, restarts, seed + 7919 * i, col)
        sets = [np.concatenate([a, b]) if len(b) else a for a, b in zip(sets, new)]
    counts = np.split(sum_partials(data.mapInPandas(_nearest_counts(sets, col), "stats array<double>")),
                      np.cumsum([len(c) for c in sets])[:-1])
    k = min(k, min(len(c) for c in sets))
    return np.stack([kmeans_pp(c, k, np.random.default_rng(seed + r), n) for r, (c, n) in enumerate(zip(sets, counts))])


def _partial(centers: np.ndarray, col: str):
    """centers: (R, K, d).  Emits [sums (R*K*d), counts (R*K), cost (R)] per partition."""
    R, K, d = centers.shape
    flat = centers.reshape(R * K, d)
    cc = (flat * flat).sum(1)

    def run(batches):
        sums = np.zeros((R, K, d))
        counts = np.zeros((R, K))
        cost = np.zeros(R)
        seen = False
        for pdf in batches:
            if len(pdf) == 0:
                continue
            seen = True
            xb = np.stack(pdf[col].to_numpy()).astype(float)
            for r0 in range(0, len(xb), ROW_CHUNK):      # rows x (R*K) distances per chunk
                x = xb[r0:r0 + ROW_CHUNK]
                _accumulate(x, flat, cc, R, K, sums, counts, cost)
        if seen:
            yield pd.DataFrame({"stats": [np.concatenate([sums.ravel(), counts.ravel(), cost])]})
    return run


def _accumulate(x, flat, cc, R, K, sums, counts, cost):
    """Assign a chunk of rows to the nearest center of every restart and add its statistics."""
    d2 = (x * x).sum(1)[:, None] - 2.0 * (x @ flat.T) + cc[None, :]
    d2 = np.maximum(d2, 0.0).reshape(len(x), R, K)
    lab = np.argmin(d2, axis=2)                          # (n, R), lowest center on ties
    cost += np.take_along_axis(d2, lab[:, :, None], axis=2)[:, :, 0].sum(0)
    onehot = np.zeros((K, len(x)))
    cols = np.arange(len(x))
    for r in range(R):
        onehot[:] = 0.0
        onehot[lab[:, r], cols] = 1.0
        sums[r] += onehot @ x                            # per-center sums with BLAS
        counts[r] += np.bincount(lab[:, r], minlength=K)


def _pass(data: DataFrame, centers: np.ndarray, col: str):
    R, K, d = centers.shape
    s = sum_partials(data.mapInPandas(_partial(centers, col), "stats array<double>"))
    if s is None:
        raise ValueError("empty input")
    sums = s[:R * K * d].reshape(R, K, d)
    counts = s[R * K * d:R * K * d + R * K].reshape(R, K)
    cost = s[-R:]
    return sums, counts, cost


def fit_kmeans(data: DataFrame, k: int, max_iter: int = 200, n_init: int = 1, seed: int = 42,
               col: str = "features", tol: float = 1e-4):
    """Returns ``(centers (k, d), cost, n_iter)`` of the best of ``n_init`` restarts.

    ``data`` should be stored (checkpointed or read from a table): it is read once per
    iteration.  Convergence: every restart's largest squared center shift is at most
    ``tol`` times the mean per-dimension variance of all rows (the usual relative
    tolerance), or ``max_iter`` is reached.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    vec = data.select(as_doubles(col).alias(col))
    centers = seed_centers(vec, k, max(1, n_init), seed, col)
    if centers.size > MAX_CENTER_VALUES:
        raise ValueError("restarts x centers too large to ship to tasks")
    spread = vec.select(Summarizer.variance(array_to_vector(col)).alias("v")).first()["v"].toArray()
    tol_abs = tol * float(spread.mean())
    n_iter = 0
    for n_iter in range(1, max_iter + 1):
        sums, counts, _ = _pass(vec, centers, col)
        new = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1)[:, :, None], centers)
        shift = ((new - centers) ** 2).sum(2).max()
        centers = new
        if shift <= tol_abs:
            break
    _, _, cost = _pass(vec, centers, col)
    best = int(np.argmin(cost))
    return centers[best], float(cost[best]), n_iter
