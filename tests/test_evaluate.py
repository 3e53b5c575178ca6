"""Many settings measured in one pass: the same figures as one setting at a time."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.functions.ids import codes_to_id
from tokenloom.operators import evaluate, idstats, neighbors, rvq
from tokenloom.operators.dictlearn import sparse_codes


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(70)
    x = rng.normal(size=(6, 5))[rng.integers(0, 6, 240)] + 0.4 * rng.normal(size=(240, 5))
    return spark.createDataFrame([(f"t{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)], "id string, features array<double>").repartition(5), x


def coders(rng):
    atoms = rng.normal(size=(7, 5))
    atoms /= np.linalg.norm(atoms, axis=1, keepdims=True)
    levels = [rng.normal(size=(4, 5)), 0.5 * rng.normal(size=(4, 5))]
    return {0: evaluate.RvqCoder(levels[:1]), 1: evaluate.RvqCoder(levels), 4: evaluate.OmpCoder(atoms, 1), 5: evaluate.OmpCoder(atoms, 3)}


def test_one_pass_equals_one_setting_at_a_time(spark, rows):
    df, x = rows
    settings = coders(np.random.default_rng(71))
    got = {r.config: r for r in evaluate.evaluate_codings(df, settings, n_queries=20, k=5, seed=3).collect()}
    assert set(got) == set(settings)
    for no, coder in settings.items():
        coded = (rvq.apply_codebooks(df, coder.levels) if isinstance(coder, evaluate.RvqCoder)
                 else sparse_codes(df, coder.atoms, coder.n_nonzero))
        codes = {r.id: list(r.codes) for r in coded.collect()}
        assert [codes[f"t{i:03d}"] for i in range(240)] == coder(x).tolist()
        occ = idstats.occupancy(coded.withColumn("semantic_id", codes_to_id("codes"))).first()
        assert got[no].unique_ids == occ.unique_ids and got[no].mean_per_id == pytest.approx(occ.mean_per_id)
        assert got[no].singleton_pct == pytest.approx(occ.singleton_pct)
        recall = neighbors.index_recall(coded, 5, 20, 3).first().recall
        assert got[no].recall == pytest.approx(recall)


def test_scans_do_not_grow_with_the_settings(spark, rows, tmp_path, monkeypatch):
    """The rows of the table that the tasks read: as many for eight settings as for one."""
    df, _ = rows
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b
    seen = []
    for n in (1, 8):
        before = read.value
        own = coders(np.random.default_rng(72))[1]
        evaluate.evaluate_codings(df.mapInArrow(counted, df.schema), {i: own for i in range(n)}, n_queries=10).collect()
        seen.append(read.value - before)
    assert seen[0] == seen[1] <= 3 * 240


def test_grid_of_codebooks(spark, rows):
    from tokenloom.plans.search import best_config, search_dictionary, search_rvq
    df, _ = rows
    res, book = search_rvq(df, n_levels_list=[1, 2], n_clusters_list=[3, 5], n_init_values=[1], max_iter=10)
    found = res.orderBy("config_no").collect()
    assert [(r.L, r.K) for r in found] == [(1, 3), (2, 3), (1, 5), (2, 5)]
    best = best_config(res).first()
    assert book.select("level").distinct().count() == best.L and book.groupBy("level").count().agg(F.max("count")).first()[0] == best.K
    for r in found:
        assert r.score == pytest.approx(r.recall - r.singleton_pct - 0.1 * abs(r.mean_per_id - 3))
    res, model = search_dictionary(df, n_nonzero_list=[1, 2], n_atoms_list=[4], max_iter=3)
    assert res.count() == 2 and model.n_nonzero == best_config(res).first().C
