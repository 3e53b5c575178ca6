"""Occupancy (A10) and recall (K4) of many quantizer settings in one pass over the rows.

``Coder`` objects turn a block of vectors into codes with plain numpy.  One Arrow pass codes each batch with every
setting, counts the distinct codes of the batch, and keeps, for the same sampled queries, the exact top-k
(once, it doesn't depend on the setting) and each setting's top-k among the rows that share a token.  Its
rows are stored once in the shared checkpoint folder and feed one grouped aggregation (rows per code and
setting) and one top-k merge keyed by setting and query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_doubles, l2_normalize
from ..session import cut_lineage
from .dictlearn import MAX_DICT_VALUES, omp_gram
from .neighbors import _Queries, topk_merge
from .rvq import nearest
from .sample import hash_sample


@dataclass
class RvqCoder:
    """M5 with the given levels of centers."""

    levels: list[np.ndarray]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out, r = np.zeros((len(x), len(self.levels)), dtype=np.int32), x
        for lv, centers in enumerate(self.levels):
            out[:, lv] = nearest(r, centers)
            r = r - centers[out[:, lv]]
        return out


@dataclass
class OmpCoder:
    """M8 and M9 with the given atoms: signed tokens, largest coefficients first (ties: lowest atom), then ``pad``."""

    atoms: np.ndarray
    n_nonzero: int
    pad: int = 0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        coef = omp_gram(x @ self.atoms.T, self.atoms @ self.atoms.T, self.n_nonzero)
        top = np.argsort(-np.abs(coef), axis=1, kind="stable")[:, :self.n_nonzero]
        value = np.take_along_axis(coef, top, axis=1)
        tokens = np.where(value >= 0, top, top + len(self.atoms))
        out = np.full((len(x), self.n_nonzero), self.pad, dtype=np.int32)
        out[:, :top.shape[1]] = np.where(value != 0, tokens, self.pad)
        return out


def _pass(coders: dict[int, object], k: int, qid: np.ndarray, qvec: np.ndarray, qraw: np.ndarray):
    asked = {no: coder(qraw) for no, coder in coders.items()}

    def run(batches):
        exact = _Queries(qid, qvec, None, k, "cosine")
        shared = {no: _Queries(qid, qvec, codes, k, "cosine", only="cand") for no, codes in asked.items()}
        for pdf in batches:
            if not len(pdf):
                continue
            ids = pdf["id"].to_numpy()
            ids = ids if ids.dtype.kind in "iu" else ids.astype(object)
            raw, unit = (np.stack(pdf[c].to_numpy()).astype(float) for c in ("v", "u"))
            exact.add(ids, unit, None)
            for no, coder in coders.items():
                codes = coder(raw)
                shared[no].add(ids, unit, codes.astype(np.int64))
                own, n = np.unique(codes, axis=0, return_counts=True)
                yield pd.DataFrame({"config": no, "codes": list(own), "n": n.astype(np.int64), "qid": None, "nid": None, "score": None})
        for no, queries in [(-1, exact), *shared.items()]:
            top = queries.rows()
            yield pd.DataFrame({"config": no, "codes": None, "n": None, "qid": top["qid"], "nid": top["nid"], "score": top["score"]})
    return run


def evaluate_codings(data: DataFrame, coders: dict[int, object], id_col: str = "id", col: str = "features", n_queries: int = 50,
                     k: int = 10, seed: int = 42) -> DataFrame:
    """``(config, unique_ids, mean_per_id, singleton_pct, recall)`` of each coder, by its number; the rows are read once,
    however many coders there are (and once more, two columns of them, for the query sample)."""
    if sum(sum(c.size for c in x.levels) if isinstance(x, RvqCoder) else x.atoms.size for x in coders.values()) > 4 * MAX_DICT_VALUES:
        raise ValueError("models too large to ship to tasks together; evaluate them in parts")
    kind = data.schema[id_col].dataType.simpleString()
    rows = data.select(F.col(id_col).alias("id"), as_doubles(col).alias("v")).withColumn("u", l2_normalize("v"))
    asked = hash_sample(data.select(F.col(id_col).alias("id"), as_doubles(col).alias("v")), "id", n_queries, seed)
    asked = asked.withColumn("u", l2_normalize("v")).toPandas()
    if not len(asked):
        raise ValueError("empty input")
    qid = asked["id"].to_numpy()
    qid = qid if qid.dtype.kind in "iu" else qid.astype(object)
    qraw, qvec = (np.stack(asked[c].to_numpy()).astype(float) for c in ("v", "u"))
    schema = f"config int, codes array<int>, n long, qid {kind}, nid {kind}, score double"
    found = cut_lineage(rows.mapInPandas(_pass(coders, k, qid, qvec, qraw), schema))
    per_id = found.where("codes IS NOT NULL").groupBy("config", "codes").agg(F.sum("n").alias("n"))
    occupancy = per_id.groupBy("config").agg(F.count("*").alias("unique_ids"), F.avg("n").alias("mean_per_id"),
                                             F.avg((F.col("n") == 1).cast("double")).alias("singleton_pct"))
    top = topk_merge(found.where("codes IS NULL").select("config", "qid", "nid", "score"), ["config", "qid"], k)
    top = cut_lineage(top.select("config", "qid", "nid"))  # at most k rows for each query and coder
    hits = top.where("config >= 0").join(top.where("config = -1").select("qid", "nid"), ["qid", "nid"]).groupBy("config").agg(
        F.count("*").alias("hits"))
    recall = F.coalesce(F.col("hits"), F.lit(0)) / F.lit(float(k * len(asked)))
    return occupancy.join(hits, "config", "left").select("config", "unique_ids", "mean_per_id", "singleton_pct", recall.alias("recall"))
