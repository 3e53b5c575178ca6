import numpy as np
from pyspark.sql import functions as F

from tokenloom.functions.ids import codes_to_id
from tokenloom.operators.dictlearn import coefs_to_tokens, fit_dictionary, lasso_cd, omp_gram

EPS = np.finfo(float).eps


def plain_omp(x, D, C):
    G = D @ D.T
    S, coef, r = [], np.zeros(len(D)), x.copy()
    for _ in range(C):
        a = np.abs(D @ r)
        a[S] = -1
        j = int(np.argmax(a))
        if a[j] ** 2 < EPS:
            break
        if S:
            g = G[S, j]
            if G[j, j] - g @ np.linalg.solve(G[np.ix_(S, S)], g) <= EPS:
                break
        S.append(j)
        coef = np.zeros(len(D))
        coef[S] = np.linalg.lstsq(D[S].T, x, rcond=None)[0]
        r = x - coef @ D
    return coef


def test_batched_omp_matches_plain():
    rng = np.random.default_rng(5)
    D = rng.normal(size=(12, 6))
    D /= np.linalg.norm(D, axis=1, keepdims=True)
    X = rng.normal(size=(100, 6))
    X[:12] = 2.5 * D          # rows equal to an atom stop after one atom
    X[12] = 0.0               # zero row: no atom
    for C in (1, 2, 3):
        got = omp_gram(X @ D.T, D @ D.T, C)
        ref = np.array([plain_omp(x, D, C) for x in X])
        assert np.allclose(got, ref, atol=1e-10)
    got = omp_gram(X @ D.T, D @ D.T, 2)
    assert (np.count_nonzero(got[:12], axis=1) == 1).all() and np.count_nonzero(got[12]) == 0


def test_token_rules(spark):
    rows = [([0.0, -2.0, 1.0, 0.0],),   # negative -> atom + D
            ([0.0, 0.0, 0.5, 0.0],),    # fewer nonzeros than C -> padding 0
            ([1.0, 0.0, 0.0, -1.0],),   # equal magnitudes -> lowest atom first
            ([0.0, 0.0, 0.0, 0.0],)]
    df = spark.createDataFrame(rows, "coef array<double>")
    got = [list(r[0]) for r in df.select(coefs_to_tokens("coef", 2, 4)).collect()]
    assert got == [[5, 2], [2, 0], [0, 7], [0, 0]]
    ids = spark.createDataFrame([([1234, 5],)], "codes array<int>").select(codes_to_id("codes")).collect()
    assert ids[0][0] == "<1234><005>"


def test_fit_dictionary_reduces_error(spark):
    rng = np.random.default_rng(6)
    atoms = rng.normal(size=(5, 8))
    codes = rng.normal(size=(300, 5)) * (rng.random((300, 5)) < 0.3)
    x = codes @ atoms + 0.01 * rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")
    model = fit_dictionary(df, n_atoms=5, n_nonzero=2, max_iter=8, batch_size=None, alpha=0.1,
                           id_col="id")
    assert np.allclose(np.linalg.norm(model.atoms, axis=1), 1.0)
    assert model.history[-1] < model.history[0]
    out = model.transform(df)
    assert out.count() == 300 and out.filter(F.size("codes") != 2).count() == 0
    mb = fit_dictionary(df, n_atoms=5, n_nonzero=2, max_iter=4, batch_size=64, alpha=0.1, id_col="id")
    assert mb.atoms.shape == (5, 8)


def test_every_row_once_per_pass(spark):
    """Blocks hold every row exactly once, whatever the batch and the number of blocks; steps have the batch's size."""
    rng = np.random.default_rng(22)
    x = rng.normal(size=(400, 6))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")
    for batch, rows, steps in ((50, 10**6, 8), (64, 10**6, 7), (None, 10**6, 1), (1000, 10**6, 1), (25, 100, None), (1000, 40, None)):
        model = fit_dictionary(df, n_atoms=4, n_nonzero=2, max_iter=3, batch_size=batch, alpha=0.1, id_col="id",
                               tol=0.0, max_no_improvement=None, block_rows=rows)
        assert (model.rows_visited, model.epochs) == (1200, 3)
        assert steps is None or len(model.history) == 3 * steps
        assert np.allclose(np.linalg.norm(model.atoms, axis=1), 1.0)


def plain_lasso(x, D, alpha):
    c = np.zeros(len(D))
    for _ in range(20):
        for j in range(len(D)):
            r = x - c @ D + c[j] * D[j]
            c[j] = np.sign(r @ D[j]) * max(abs(r @ D[j]) - alpha, 0.0) / (D[j] @ D[j])
    return c


def plain_online(rows, atoms, batch, passes, alpha):
    """The algorithm row by row: forgetting sums, then block coordinate descent over the atoms after each batch."""
    D, A, B, step = atoms.copy(), 0.0, 0.0, 0
    for _ in range(passes):
        for lo in range(0, len(rows), batch):
            part = rows[lo:lo + batch]
            c = np.array([plain_lasso(x, D, alpha) for x in part])
            step += 1
            theta = batch * step if step < batch else batch ** 2 + step - batch
            beta = (theta + 1 - batch) / (theta + 1)
            A, B = beta * A + c.T @ c, beta * B + part.T @ c
            for j in range(len(D)):
                if A[j, j] > 1e-10:
                    u = D[j] + (B[:, j] - D.T @ A[:, j]) / A[j, j]
                    D[j] = u / max(np.linalg.norm(u), 1.0)
    return D / np.linalg.norm(D, axis=1, keepdims=True)


def md5_order(ids, seed=42):
    import hashlib
    return np.argsort([hashlib.md5(f"{seed}:{i}".encode()).hexdigest() for i in ids])


def test_one_block_is_the_plain_algorithm(spark):
    rng = np.random.default_rng(30)
    x = rng.normal(size=(150, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")
    got = fit_dictionary(df.repartition(5), n_atoms=4, n_nonzero=2, max_iter=3, batch_size=32, alpha=0.1, id_col="id", tol=0.0,
                         max_no_improvement=None)
    rows = x[md5_order(range(150))]
    start = rows[:4] / np.linalg.norm(rows[:4], axis=1, keepdims=True)
    assert np.allclose(got.atoms, plain_online(rows, start, 32, 3, 0.1), atol=1e-8)


def test_blocks_reach_the_error_of_one_sequence(spark):
    """Blocks in parallel against 256-row batches in one sequence, on the given table."""
    from tokenloom.operators import linalg
    from tokenloom.plans.inputs import embeddings
    z, _ = linalg.standardize(embeddings(spark, "/root/testdata/sf0.1"))
    x = np.array([r.features for r in z.select("features").collect()])

    def error(block_rows):
        model = fit_dictionary(z, n_atoms=16, n_nonzero=2, max_iter=8, batch_size=256, id_col="vec_id", tol=0.0, max_no_improvement=None,
                               block_rows=block_rows)
        c = lasso_cd(x @ model.atoms.T, model.atoms @ model.atoms.T, 1.0)
        omp = omp_gram(x @ model.atoms.T, model.atoms @ model.atoms.T, 2)
        return 0.5 * ((x - c @ model.atoms) ** 2).sum() + np.abs(c).sum(), ((x - omp @ model.atoms) ** 2).sum()
    whole, parts = error(10**6), error(300)
    print(whole, parts)
    assert parts[0] <= 1.02 * whole[0] and parts[1] <= 1.02 * whole[1]


def test_stop_rules(spark):
    rng = np.random.default_rng(23)
    x = rng.normal(size=(200, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")
    fit = lambda **kw: fit_dictionary(df, n_atoms=3, max_iter=40, batch_size=50, alpha=0.1, id_col="id", **kw)
    assert fit(tol=10.0).rows_visited < 200
    assert fit(tol=0.0, max_no_improvement=1).epochs < 40


def test_fit_independent_of_partitioning(spark):
    rng = np.random.default_rng(24)
    x = rng.normal(size=(300, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")
    a = fit_dictionary(df.repartition(2), n_atoms=4, n_nonzero=2, max_iter=4, batch_size=60, alpha=0.1, id_col="id")
    b = fit_dictionary(df.repartition(7), n_atoms=4, n_nonzero=2, max_iter=4, batch_size=60, alpha=0.1, id_col="id")
    assert np.allclose(a.atoms, b.atoms, atol=1e-9)
    c, d = (fit_dictionary(df.repartition(n), n_atoms=4, n_nonzero=2, max_iter=4, batch_size=20, alpha=0.1, id_col="id", block_rows=70) for n in (2, 7))
    assert np.allclose(c.atoms, d.atoms, atol=1e-9)
