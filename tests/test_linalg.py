import numpy as np

from tokenloom.operators import linalg


def make(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)],
                                 "id long, features array<double>")


def test_standardize_population_std(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 5))
    x[:, 2] = 3.0  # constant column: divide by 1
    z, sc = linalg.standardize(make(spark, x))
    got = np.array([r["features"] for r in z.orderBy("id").collect()])
    std = x.std(axis=0)
    exp = (x - x.mean(axis=0)) / np.where(std == 0, 1.0, std)
    assert np.allclose(got, exp)
    assert np.allclose(got[:, 2], 0.0)


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 6)) @ rng.normal(size=(6, 6))
    z, _ = linalg.standardize(make(spark, x))
    zz = np.array([r["features"] for r in z.orderBy("id").collect()])
    model = linalg.fit_pca(z, k=3)
    scores = np.array([r["pca"] for r in model.transform(z).orderBy("id").collect()])
    cov = np.cov(zz, rowvar=False)
    w, v = np.linalg.eigh(cov)
    order = np.argsort(w)[::-1]
    ref = (zz - zz.mean(0)) @ v[:, order[:3]]
    assert np.allclose(np.abs(scores), np.abs(ref), atol=1e-8)
    ratios = w[order] / w.sum()
    assert np.allclose(model.ratio, ratios[:3])
    # sign rule: the largest-magnitude loading of each component is positive
    comp = model.components
    assert all(comp[np.argmax(np.abs(comp[:, j])), j] > 0 for j in range(3))
    # ratio selection: smallest k whose cumulative ratio exceeds r
    r = float(np.cumsum(ratios)[2]) - 1e-9
    assert linalg.fit_pca(z, ratio=r).k == 3


def test_gram_long(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 4))
    g = {(r["i"], r["j"]): r["value"] for r in linalg.gram_long(make(spark, x).repartition(3)).collect()}
    ref = x.T @ x / len(x)
    assert all(np.isclose(g[(i, j)], ref[i, j]) for i in range(4) for j in range(4))
