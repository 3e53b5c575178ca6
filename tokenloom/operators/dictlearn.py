"""Sparse dictionary coding: OMP encode (M8), coefficient tokens (M9),
dictionary fitting (M6 mini-batch, M7 full batch) and apply (M10).

Fitting follows the online dictionary learning of Mairal et al. (2009): a
step codes a batch against the current dictionary, adds to the sufficient
statistics ``A = sum c c^T`` (D x D) and ``B = sum x c^T`` (dim x D), and
updates the atoms by block coordinate descent.  Mini-batches (M6) run block-parallel:
each block of rows takes steps of ``batch_size`` rows on a copy of the atoms and
statistics, and the copies meet in a weighted mean after each pass.  The full-batch
fit (M7) is one step per pass over sums from all partitions.  Only model-sized
sums reach the driver; the data is never collected and its lineage does not
grow across passes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash32, seeded_key
from ..functions.vectors import as_doubles
from ..session import cut_lineage

EPS = float(np.finfo(float).eps)
MAX_DICT_VALUES = 2_000_000  # 16 MB of doubles; D=128 x d=221 is 28k


# ---- OMP (M8) -------------------------------------------------------------------

def omp_gram(P: np.ndarray, G: np.ndarray, n_nonzero: int) -> np.ndarray:
    """Batched orthogonal matching pursuit on the Gram matrix.

    ``P = X D^T`` (n x D correlations), ``G = D D^T``.  Each step picks the
    atom with the largest absolute residual correlation (lowest atom on
    ties), then refits all chosen atoms by least squares.  A row stops early
    when the best correlation squared is below machine epsilon or the new
    atom is linearly dependent on the chosen ones; unused slots stay zero.
    """
    n, D = P.shape
    coef = np.zeros((n, D))
    if n == 0:
        return coef
    active = np.full((n, n_nonzero), -1, dtype=np.int64)
    alive = np.ones(n, dtype=bool)
    corr = P.copy()
    rows = np.arange(n)
    for step in range(min(n_nonzero, D)):
        a = np.abs(corr)
        if step:
            a[rows[:, None], active[:, :step]] = -1.0
        j = np.argmax(a, axis=1)
        best = a[rows, j]
        ok = alive & (best * best >= EPS)
        if step:
            S = active[:, :step]
            Gss = G[S[:, :, None], S[:, None, :]]            # n x s x s
            g = G[S, j[:, None]]                              # n x s
            # Cholesky pivot of the enlarged active set: G_jj - g^T Gss^-1 g
            safe = np.where(ok[:, None, None], Gss, np.eye(step)[None])
            v = np.linalg.solve(safe, g[:, :, None])[:, :, 0]
            pivot = G[j, j] - (g * v).sum(1)
            ok &= pivot > EPS
        alive &= ok
        if not alive.any():
            break
        active[alive, step] = j[alive]
        s = step + 1
        S = np.where(active[:, :s] >= 0, active[:, :s], 0)
        Gss = G[S[:, :, None], S[:, None, :]]
        rhs = P[rows[:, None], S]
        idx = np.nonzero(alive)[0]
        sol = np.linalg.solve(Gss[idx], rhs[idx][:, :, None])[:, :, 0]
        coef[idx] = 0.0
        coef[idx[:, None], S[idx]] = sol
        corr = P - coef @ G
    return coef


def coefs_to_tokens(coef: Column | str, n_nonzero: int, n_atoms: int, pad: int = 0) -> Column:
    """M9: top ``n_nonzero`` nonzero coefficients by |coef| (lowest atom on ties);
    token = atom for coef >= 0, atom + n_atoms for coef < 0; padded with ``pad``."""
    c = F.col(coef) if isinstance(coef, str) else coef
    pairs = F.filter(F.transform(c, lambda v, i: F.struct(F.abs(v).alias("a"), i.alias("i"), v.alias("v"))),
                     lambda s: s["v"] != 0)
    ordered = F.array_sort(pairs, lambda l, r: F.when(l["a"] > r["a"], -1).when(l["a"] < r["a"], 1)
                           .when(l["i"] < r["i"], -1).when(l["i"] > r["i"], 1).otherwise(0))
    top = F.slice(ordered, 1, n_nonzero)
    toks = F.transform(top, lambda s: F.when(s["v"] >= 0, s["i"]).otherwise(s["i"] + n_atoms))
    return F.concat(toks, F.array_repeat(F.lit(pad), F.greatest(F.lit(n_nonzero) - F.size(toks), F.lit(0))))


def _encode(dictionary: np.ndarray, n_nonzero: int, col: str, out_cols: list[str]):
    G = dictionary @ dictionary.T

    def run(batches):
        for pdf in batches:
            out = pdf[out_cols].copy()
            if len(pdf) == 0:
                out["coef"] = pd.Series([], dtype=object)
                yield out
                continue
            x = np.stack(pdf[col].to_numpy()).astype(float)
            out["coef"] = list(omp_gram(x @ dictionary.T, G, n_nonzero))
            yield out
    return run


def omp_encode(df: DataFrame, dictionary: np.ndarray, n_nonzero: int, col: str = "features",
               out_cols: list[str] | None = None) -> DataFrame:
    """M8: dense OMP coefficients ``coef array<double>`` (length D) per row;
    ``out_cols`` (default all) are carried back out of the Arrow batch."""
    if dictionary.size > MAX_DICT_VALUES:
        raise ValueError("dictionary too large to ship to tasks")
    src = df.withColumn(col, as_doubles(col))
    out_cols = list(src.columns) if out_cols is None else list(out_cols)
    schema = T.StructType([src.schema[c] for c in out_cols] + [T.StructField("coef", T.ArrayType(T.DoubleType()))])
    src = src.select(*dict.fromkeys(out_cols + [col]))
    return src.mapInPandas(_encode(np.asarray(dictionary, float), n_nonzero, col, out_cols), schema)


def sparse_codes(df: DataFrame, dictionary: np.ndarray, n_nonzero: int, col: str = "features",
                 pad: int = 0, out_cols: list[str] | None = None) -> DataFrame:
    """M8 + M9: ``codes array<int>`` of signed atom tokens."""
    D = dictionary.shape[0]
    enc = omp_encode(df, dictionary, n_nonzero, col, out_cols)
    return enc.withColumn("codes", coefs_to_tokens("coef", n_nonzero, D, pad)).drop("coef")


# ---- lasso coding for the fit ----------------------------------------------------

def lasso_cd(P: np.ndarray, G: np.ndarray, alpha: float, sweeps: int = 20) -> np.ndarray:
    """Batched coordinate descent for min 0.5||x - cD||^2 + alpha ||c||_1."""
    n, D = P.shape
    c = np.zeros((n, D))
    diag = np.maximum(np.diag(G), EPS)
    for _ in range(sweeps):
        for j in range(D):
            rho = P[:, j] - c @ G[:, j] + c[:, j] * G[j, j]
            c[:, j] = np.sign(rho) * np.maximum(np.abs(rho) - alpha, 0.0) / diag[j]
    return c


def _partial_stats(dictionary: np.ndarray, algo: str, alpha: float, n_nonzero: int, col: str):
    D, dim = dictionary.shape
    G = dictionary @ dictionary.T

    def run(batches):
        A = np.zeros((D, D))
        B = np.zeros((dim, D))
        n = 0
        err = 0.0
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf[col].to_numpy()).astype(float)
            P = x @ dictionary.T
            c = lasso_cd(P, G, alpha) if algo == "cd" else omp_gram(P, G, n_nonzero)
            A += c.T @ c
            B += x.T @ c
            n += len(x)
            r = x - c @ dictionary
            err += float((r * r).sum()) + (2 * alpha * float(np.abs(c).sum()) if algo == "cd" else 0.0)
        if n:
            yield pd.DataFrame({"stats": [np.concatenate([A.ravel(), B.ravel(), [n, err]])]})
    return run


def sum_partials(df: DataFrame, col: str = "stats", fanout: int = 64) -> np.ndarray | None:
    """Element-wise sum of equally long arrays: partial vectors meet in ``fanout`` groups
    on the executors, and at most ``fanout`` model-sized rows reach the driver."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    grouped = (df.withColumn("_g", F.pmod(F.spark_partition_id(), F.lit(fanout)))
               .groupBy("_g").agg(Summarizer.sum(array_to_vector(col)).alias("s")))
    rows = sorted(grouped.collect(), key=lambda r: r["_g"])
    if not rows:
        return None
    return np.sum([r["s"].toArray() for r in rows], axis=0)


@dataclass
class DictionaryModel:
    atoms: np.ndarray         # D x dim, unit-norm rows
    n_nonzero: int
    history: list[float]      # mean error of each step, on the rows of the step
    rows_visited: int = 0
    epochs: int = 0

    @property
    def n_atoms(self) -> int:
        return self.atoms.shape[0]

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """``dictionary (atom, vec)`` and one-row ``config``."""
        d = spark.createDataFrame([(i, [float(v) for v in a]) for i, a in enumerate(self.atoms)],
                                  "atom int, vec array<double>")
        cfg = spark.createDataFrame([(self.n_nonzero, self.n_atoms)],
                                    "n_nonzero_coefs int, n_dict_components int")
        return {"dictionary": d, "config": cfg}

    def transform(self, df: DataFrame, col: str = "features", pad: int = 0,
                  out_cols: list[str] | None = None) -> DataFrame:
        return sparse_codes(df, self.atoms, self.n_nonzero, col, pad, out_cols)


def _normalize_rows(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms > 0, norms, 1.0)


def _update_atoms(atoms: np.ndarray, A: np.ndarray, B: np.ndarray, pool: np.ndarray, spare: int) -> int:
    """Block coordinate descent on the sums; an atom no row uses is re-seeded from the pool."""
    D = len(atoms)
    for j in range(D):
        if A[j, j] > 1e-10:
            u = atoms[j] + (B[:, j] - atoms.T @ A[:, j]) / A[j, j]
            atoms[j] = u / max(np.linalg.norm(u), 1.0)
        else:
            atoms[j] = pool[(D + spare) % len(pool)]
            spare += 1
    return spare


@dataclass
class _Progress:
    """What a step starts from: atoms, statistics, steps taken, and the state of the stop rules."""

    atoms: np.ndarray
    A: np.ndarray
    B: np.ndarray
    step: int = 0
    spare: int = 0
    smooth: float = math.nan
    best: float = math.inf
    stale: int = 0
    done: bool = False


def online_step(at: _Progress, x: np.ndarray, pool: np.ndarray, batch_size: int, n_total: int, algo: str, alpha: float,
                n_nonzero: int, tol: float, patience: int | None) -> float:
    """One step of online dictionary learning on the rows ``x``; returns their summed error."""
    P, G = x @ at.atoms.T, at.atoms @ at.atoms.T
    c = lasso_cd(P, G, alpha) if algo == "cd" else omp_gram(P, G, n_nonzero)
    r = x - c @ at.atoms
    err = float((r * r).sum()) + (2 * alpha * float(np.abs(c).sum()) if algo == "cd" else 0.0)
    at.step += 1
    # forgetting factor of the online algorithm (Mairal et al., 2010, sec. 3.4)
    theta = batch_size * at.step if at.step < batch_size else batch_size ** 2 + at.step - batch_size
    beta = (theta + 1 - batch_size) / (theta + 1)
    at.A, at.B = beta * at.A + c.T @ c, beta * at.B + x.T @ c
    before = at.atoms.copy()
    at.spare = _update_atoms(at.atoms, at.A, at.B, pool, at.spare)
    weight = min(1.0, 2.0 * len(x) / (n_total + 1))
    at.smooth = err / len(x) if math.isnan(at.smooth) else at.smooth * (1 - weight) + err / len(x) * weight
    at.stale = 0 if at.smooth < at.best else at.stale + 1
    at.best = min(at.best, at.smooth)
    at.done = (tol > 0 and np.linalg.norm(at.atoms - before) / len(at.atoms) <= tol) or bool(patience and at.stale >= patience)
    return err


def _block_pass(start: _Progress, pool: np.ndarray, batch_size: int, n_total: int, slots: int, col: str, rules: tuple):
    """One pass of a block (= partition): steps of exactly ``batch_size`` rows, whatever the Arrow batches; the last may be
    smaller.  Emits one row of fixed size: usage-weighted atoms, row-weighted statistics, and for each step
    its error and rows."""
    def run(batches):
        at = _Progress(start.atoms.copy(), start.A.copy(), start.B.copy(), start.step, start.spare, start.smooth, start.best, start.stale)
        held, size, rows, steps = [], 0, 0, 0
        err, seen = np.zeros(slots), np.zeros(slots)

        def take(x):
            nonlocal rows, steps
            err[steps], seen[steps] = online_step(at, x, pool, batch_size, n_total, *rules), len(x)
            rows, steps = rows + len(x), steps + 1
        for pdf in batches:
            if at.done:
                break
            if len(pdf):
                held.append(np.stack(pdf[col].to_numpy()).astype(float))
                size += len(pdf)
            if size >= batch_size:
                x = np.concatenate(held)
                for lo in range(0, size - batch_size + 1, batch_size):
                    if not at.done:
                        take(x[lo:lo + batch_size])
                held = [x[size // batch_size * batch_size:]]
                size = len(held[0])
        if size and not at.done:
            take(np.concatenate(held))
        if rows:
            use = np.diag(at.A)
            yield pd.DataFrame({"stats": [np.concatenate([
                (at.atoms * use[:, None]).ravel(), use, rows * at.A.ravel(), rows * at.B.ravel(), err, seen,
                [rows, steps, 1.0, float(at.done), rows * at.smooth, rows * at.best, rows * at.stale, at.spare]])]})
    return run


def _merged(s: np.ndarray, before: _Progress, pool: np.ndarray, slots: int) -> tuple[_Progress, list[float], int]:
    """The mean of the blocks' copies: atoms weighted by their use, statistics by rows.  One block stays as it is."""
    D, dim = before.atoms.shape
    cuts = np.cumsum([D * dim, D, D * D, dim * D, slots, slots])
    atoms, use, A, B, err, seen, (rows, steps, blocks, done, smooth, best, stale, spare) = np.split(s, cuts)
    at = _Progress(np.where(use[:, None] > 1e-10, atoms.reshape(D, dim) / np.maximum(use, 1e-300)[:, None], before.atoms),
                   A.reshape(D, D) / rows, B.reshape(dim, D) / rows, before.step + math.ceil(steps / blocks), int(spare / blocks),
                   smooth / rows, best / rows, int(stale / rows), done == blocks)
    if blocks > 1:
        at.spare = _update_atoms(at.atoms, at.A, at.B, pool, at.spare)
    return at, (err[seen > 0] / seen[seen > 0]).tolist(), int(rows)


#: Blocks of a pass at most: beyond MAX_BLOCKS * block_rows rows the blocks grow, never the batch.
MAX_BLOCKS = 4096


def fit_dictionary(df: DataFrame, n_atoms: int = 128, n_nonzero: int = 2, max_iter: int = 100,
                   batch_size: int | None = 256, alpha: float = 1.0, fit_algorithm: str = "cd",
                   seed: int = 42, col: str = "features", id_col: str | None = None,
                   tol: float = 1e-3, max_no_improvement: int | None = 10,
                   block_rows: int = 65_536) -> DictionaryModel:
    """M6 (mini-batches) or M7 (``batch_size=None``): ``max_iter`` passes over every row.

    M6 deals the rows once into blocks of about ``block_rows`` rows by a seeded md5 of the row key (``id_col``, else
    the vector) and orders each block by it.  A pass is one job: every block takes steps of ``batch_size`` rows,
    the same at every table size, on its own copy of the atoms and statistics; the copies are merged in a tree
    sum (64 model-sized rows reach the driver).  The first block of the first pass goes ahead, so that all
    others start from atoms that have seen data.  Up to ``block_rows`` rows it is the plain sequential algorithm.  Every
    row enters once per pass, and the result doesn't depend on the input's partitioning.  A block stops when a step
    changes its atoms by at most ``tol`` (Frobenius norm over the number of atoms), or when its smoothed
    error has not improved for ``max_no_improvement`` steps (0 or None: never); the fit stops with all blocks.

    The starting atoms are the first ``n_atoms`` rows in seeded md5 order (normalized);
    an atom that no row uses is re-seeded from a further row of that order.
    Codes in the fit are lasso codes (coordinate descent, ``alpha``) or OMP codes.
    """
    if fit_algorithm not in ("cd", "omp"):
        raise ValueError("fit_algorithm must be 'cd' or 'omp'")
    # every pass re-reads the data: cut its lineage once (shared checkpoint folder)
    data = cut_lineage(df.select(*([id_col] if id_col else []), as_doubles(col).alias(col)))
    order_key = seeded_key(seed, F.col(id_col)) if id_col else seeded_key(seed, F.to_json(F.col(col)))
    pool_rows = (data.withColumn("_h", hash32(order_key)).orderBy("_h", F.md5(order_key))
                 .limit(2 * n_atoms).select(col).collect())
    pool = _normalize_rows(np.array([r[0] for r in pool_rows], dtype=float))
    if len(pool) == 0:
        raise ValueError("empty input")
    atoms = pool[np.arange(n_atoms) % len(pool)].copy()
    if len(pool) < n_atoms:  # fewer rows than atoms: perturb the repeats deterministically
        rng = np.random.default_rng(seed)
        atoms[len(pool):] += 1e-3 * rng.standard_normal(atoms[len(pool):].shape)
        atoms = _normalize_rows(atoms)
    fit = _fit_online if batch_size else _fit_full
    return fit(data, atoms, pool, order_key, n_nonzero, max_iter, batch_size, alpha, fit_algorithm, col, tol, max_no_improvement, block_rows)


def _fit_online(data: DataFrame, atoms, pool, order_key, n_nonzero, max_iter, batch_size, alpha, algo, col, tol, patience, block_rows):
    n_total = data.count()
    n_blocks = min(MAX_BLOCKS, max(1, math.ceil(n_total / block_rows)))
    block = F.pmod(F.xxhash64(F.md5(order_key)), F.lit(n_blocks)).cast("int")
    dealt = data.select(col, block.alias("_block"), hash32(order_key).alias("_h"), F.md5(order_key).alias("_m"))
    dealt = cut_lineage(dealt.repartitionById(n_blocks, "_block").sortWithinPartitions("_h", "_m", col).select("_block", col))
    largest = dealt.groupBy("_block").count().agg(F.max("count")).first()[0]
    slots = math.ceil(largest / batch_size)
    D, dim = atoms.shape
    at = _Progress(atoms, np.zeros((D, D)), np.zeros((dim, D)))
    rules = (algo, alpha, n_nonzero, tol, patience)
    history: list[float] = []
    visited = epoch = 0

    def run(rows: DataFrame, start: _Progress) -> np.ndarray | None:
        return sum_partials(rows.select(col).mapInPandas(_block_pass(start, pool, batch_size, n_total, slots, col, rules), "stats array<double>"))
    for epoch in range(1, max_iter + 1):
        if epoch == 1 and n_blocks > 1:
            parts = [run(dealt.filter(F.col("_block") == 0), at)]
            lead = at if parts[0] is None else _merged(parts[0], at, pool, slots)[0]
            parts.append(run(dealt.filter(F.col("_block") > 0), lead))
            s = sum(p for p in parts if p is not None)
        else:
            s = run(dealt, at)
        at, errors, rows = _merged(s, at, pool, slots)
        history += errors
        visited += rows
        if at.done:
            break
    return DictionaryModel(_normalize_rows(at.atoms), n_nonzero, history, visited, epoch)


def _fit_full(data: DataFrame, atoms, pool, order_key, n_nonzero, max_iter, batch_size, alpha, algo, col, tol, patience, block_rows):
    D, dim = atoms.shape
    history: list[float] = []
    spare = visited = stale = epoch = 0
    smooth, best = None, None
    for epoch in range(1, max_iter + 1):
        s = sum_partials(data.mapInPandas(_partial_stats(atoms, algo, alpha, n_nonzero, col), "stats array<double>"))
        A, B = s[:D * D].reshape(D, D), s[D * D:D * D + dim * D].reshape(dim, D)
        visited += int(s[-2])
        history.append(s[-1] / max(s[-2], 1.0))
        before = atoms.copy()
        spare = _update_atoms(atoms, A, B, pool, spare)
        smooth = history[-1]
        stale = 0 if best is None or smooth < best else stale + 1
        best = smooth if best is None else min(best, smooth)
        if (tol > 0 and np.linalg.norm(atoms - before) / D <= tol) or (patience and stale >= patience):
            break
    return DictionaryModel(_normalize_rows(atoms), n_nonzero, history, visited, epoch)


def load_dictionary(tables: dict[str, DataFrame]) -> DictionaryModel:
    """M10 load: dictionary and config tables -> model (model-sized collect)."""
    rows = tables["dictionary"].orderBy("atom").collect()
    cfg = tables["config"].collect()
    if not rows or not cfg:
        raise FileNotFoundError("dictionary model tables are empty")
    atoms = np.array([r["vec"] for r in rows], dtype=float)
    return DictionaryModel(atoms, int(cfg[0]["n_nonzero_coefs"]), [])
