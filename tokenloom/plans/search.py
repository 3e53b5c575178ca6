"""Grid searches over quantizer settings (M14 RVQ, M15 dictionary).

The driver loops over the fits only.  RVQ levels are nested, so the deepest L is
fitted once per (K, n_init) and shallower L reuse its first levels; dictionary
fits do not depend on C, so one fit serves every C.  All configurations are
then coded and measured in one pass over the rows (``operators.evaluate``),
and no codes are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import rvq
from ..operators.dictlearn import fit_dictionary
from ..operators.evaluate import OmpCoder, RvqCoder, evaluate_codings
from ..session import cut_lineage

RESULT_SCHEMA = ("config_no int, L int, K int, n_init int, unique_ids long, mean_per_id double, "
                 "singleton_pct double, recall double, score double")
DICT_SCHEMA = ("config_no int, C int, D int, batch_size int, unique_ids long, mean_per_id double, "
               "singleton_pct double, recall double, score double")


def search_score(recall: Column, singleton: Column, mean_per_id: Column, ideal: float = 3.0) -> Column:
    """Score = Recall - SingletonPct - 0.1 * |MeanPerID - ideal|."""
    return recall - singleton - F.abs(mean_per_id - F.lit(ideal)) * 0.1


def _finish(spark, settings: dict[int, tuple], measured: DataFrame, schema: str, ideal: float) -> DataFrame:
    """One row per configuration: its settings, its metrics and the score."""
    found = {r["config"]: r for r in measured.collect()}
    rows = [(no, *own, int(found[no]["unique_ids"]), float(found[no]["mean_per_id"]), float(found[no]["singleton_pct"]),
             float(found[no]["recall"]), 0.0) for no, own in settings.items()]
    res = spark.createDataFrame(rows, schema)
    return res.withColumn("score", search_score(F.col("recall"), F.col("singleton_pct"), F.col("mean_per_id"), ideal))


def best_config(results: DataFrame) -> DataFrame:
    """T4: the first configuration with the maximum score."""
    return results.orderBy(F.desc("score"), F.asc("config_no")).limit(1)


def search_rvq(df: DataFrame, id_col: str = "id", col: str = "features",
               n_levels_list=(2, 3), n_clusters_list=(32, 64, 128), n_init_values=(16,),
               max_iter: int = 200, ideal: float = 3.0, n_queries: int = 50, k_eval: int = 10,
               seed: int = 42):
    """Returns ``(results, best_codebook)``; loop order K, then L, then n_init."""
    spark = df.sparkSession
    data = cut_lineage(df.select(id_col, col))  # every configuration re-reads it
    settings, books, no = {}, {}, 0
    for K in n_clusters_list:
        fits = {}
        for n_init in n_init_values:
            book, _, _ = rvq.fit_rvq(data, max(n_levels_list), K, max_iter, n_init, seed, col)
            fits[n_init] = rvq.codebook_arrays(book)
        for L in n_levels_list:
            for n_init in n_init_values:
                settings[no], books[no] = (L, K, n_init), fits[n_init][:L]
                no += 1
    measured = evaluate_codings(data, {n: RvqCoder(levels) for n, levels in books.items()}, id_col, col, n_queries, k_eval, seed)
    res = _finish(spark, settings, measured, RESULT_SCHEMA, ideal)
    best_no = best_config(res).collect()[0]["config_no"]
    levels = books[best_no]
    book = spark.createDataFrame(
        [(lv, t, [float(x) for x in c]) for lv, cs in enumerate(levels) for t, c in enumerate(cs)],
        "level int, token int, center array<double>")
    return res, book


def search_dictionary(df: DataFrame, id_col: str = "id", col: str = "features",
                      n_nonzero_list=(2, 3), n_atoms_list=(32, 64, 128), batch_sizes=(256,),
                      max_iter: int = 100, ideal: float = 3.0, n_queries: int = 50, k_eval: int = 10,
                      seed: int = 42):
    """Returns ``(results, best_model)``; loop order D, then C, then batch size."""
    spark = df.sparkSession
    data = cut_lineage(df.select(id_col, col))
    settings, models, no = {}, {}, 0
    for D in n_atoms_list:
        fits = {b: fit_dictionary(data, D, 2, max_iter, b, seed=seed, col=col, id_col=id_col)
                for b in batch_sizes}
        for C in n_nonzero_list:
            for b in batch_sizes:
                settings[no], models[no] = (C, D, b), (fits[b], C)
                no += 1
    coders = {n: OmpCoder(model.atoms, C) for n, (model, C) in models.items()}
    res = _finish(spark, settings, evaluate_codings(data, coders, id_col, col, n_queries, k_eval, seed), DICT_SCHEMA, ideal)
    best_no = best_config(res).collect()[0]["config_no"]
    model, C = models[best_no]
    model.n_nonzero = C
    return res, model
