import numpy as np

from tokenloom.operators import rvq
from tokenloom.sources import store


def make(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)],
                                 "id long, features array<double>")


def test_apply_reproduces_fit_and_residual_shrinks(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, size=(40, 3)) for c in ([0, 0, 0], [5, 5, 0], [0, 5, 5])])
    df = make(spark, x)
    book, codes, info = rvq.fit_rvq(df, n_levels=3, n_clusters=4, max_iter=20)
    fit_codes = {r["id"]: list(r["codes"]) for r in codes.collect()}
    store.save_model(spark, str(tmp_path), "rvq", {"codebook": book})
    loaded = store.load_model(spark, str(tmp_path), "rvq", ["codebook"])["codebook"]
    applied = {r["id"]: list(r["codes"]) for r in rvq.apply_rvq(df, loaded).collect()}
    assert applied == fit_codes
    levels = rvq.codebook_arrays(book)
    errs = []
    r = x.copy()
    for lv in levels:
        t = rvq.nearest(r, lv)
        r = r - lv[t]
        errs.append(float((r * r).sum()))
    assert all(b <= a + 1e-9 for a, b in zip(errs, errs[1:]))


def test_nearest_ties_lowest_index():
    c = np.array([[1.0, 0.0], [1.0, 0.0], [-1.0, 0.0]])
    assert list(rvq.nearest(np.array([[1.0, 0.0], [0.0, 0.0]]), c)) == [0, 0]


def test_missing_model_raises(spark, tmp_path):
    import pytest
    with pytest.raises(FileNotFoundError):
        store.load_model(spark, str(tmp_path), "nothing", ["codebook"])


def test_multi_restart_kmeans(spark):
    from tokenloom.operators.kmeans import fit_kmeans
    rng = np.random.default_rng(18)
    true = np.array([[0, 0], [6, 0], [0, 6], [6, 6]], dtype=float)
    x = np.concatenate([rng.normal(c, 0.2, size=(100, 2)) for c in true])
    df = make(spark, x).repartition(4)
    centers, cost, n_iter = fit_kmeans(df, 4, 50, n_init=5, seed=1)
    got = sorted(map(tuple, np.round(centers)))
    assert got == sorted(map(tuple, true)) and n_iter < 50
    # cost equals the inertia of the returned centers
    d2 = ((x[:, None, :] - centers[None]) ** 2).sum(-1).min(1).sum()
    assert abs(cost - d2) < 1e-6 * max(1.0, d2)
    # RVQ with restarts in one pass reproduces its codes through apply
    book, codes, info = rvq.fit_rvq(df, n_levels=2, n_clusters=4, max_iter=20, n_init=3)
    fit_codes = {r["id"]: list(r["codes"]) for r in codes.collect()}
    applied = {r["id"]: list(r["codes"]) for r in rvq.apply_rvq(df, book).collect()}
    assert applied == fit_codes and info["train_cost"][1] < info["train_cost"][0]


def test_seeds_with_many_copies(spark):
    """Two thousand copies of one vector do not crowd out the other rows as seeds."""
    from tokenloom.operators.kmeans import seed_centers
    rng = np.random.default_rng(8)
    x = np.vstack([np.tile(rng.normal(size=(1, 4)), (2000, 1)), rng.normal(size=(500, 4)) + 10 * rng.integers(0, 8, (500, 1))])
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "features array<double>").repartition(5)
    seeds = seed_centers(df, 8, 3, 1, "features")
    assert seeds.shape == (3, 8, 4)
    assert all(len(np.unique(s, axis=0)) == 8 for s in seeds) and not np.allclose(seeds[0], seeds[1])
    again = seed_centers(df.repartition(2), 8, 3, 1, "features")
    assert np.allclose(seeds, again)
