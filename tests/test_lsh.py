"""Approximate neighbors: recall against brute force, work below all pairs, dense groups and equal rows."""
import numpy as np
import pytest

from tokenloom.operators import lsh, quality


def frame(spark, x, name=lambda i: i, kind="long"):
    return spark.createDataFrame([(name(i), [float(v) for v in r]) for i, r in enumerate(x)], f"id {kind}, features array<double>").repartition(6)


def true_recall(x, rows, k, ids=None):
    sq = (x * x).sum(1)
    kth = np.empty(len(x))
    for lo in range(0, len(x), 500):
        d = sq[lo:lo + 500, None] + sq[None] - 2 * x[lo:lo + 500] @ x.T
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        kth[lo:lo + 500] = np.sqrt(np.maximum(np.partition(d, k - 1, axis=1)[:, k - 1], 0))
    return sum(r.distance <= kth[ids[r.id] if ids else r.id] * (1 + 1e-6) + 1e-9 for r in rows) / (k * len(x))


def groups(rng, n, dim, centers, spread):
    return centers[rng.integers(0, len(centers), n)] + spread * rng.normal(size=(n, dim))


def test_recall_and_work(spark):
    """Clustered rows, a third of them in one dense group."""
    rng = np.random.default_rng(50)
    x = groups(rng, 6000, 16, rng.normal(size=(150, 16)) * 4, 0.6)
    x[:2000] = x[0] + 0.3 * rng.normal(size=(2000, 16))
    rows, report = lsh.knn_lsh(frame(spark, x), 10, recall=0.92, bucket_rows=150)
    got = rows.collect()
    assert true_recall(x, got, 10) >= 0.9 and report.recall >= 0.92 and 0 < report.tables <= 16
    assert report.pairs < 0.5 * report.all_pairs
    for r in got[:300]:
        assert r.distance == pytest.approx(np.linalg.norm(x[r.id] - x[r.neighbor_id]), abs=1e-9) and r.id != r.neighbor_id
    ranks = {}
    for r in got:
        ranks.setdefault(r.id, []).append((r.rank, r.distance, r.neighbor_id))
    assert all([k for k, _, _ in sorted(v)] == list(range(1, len(v) + 1)) and [d for _, d, _ in sorted(v)] == sorted(d for _, d, _ in v)
               and len({i for _, _, i in v}) == len(v) for v in ranks.values())


def test_work_grows_with_the_rows(spark):
    rng = np.random.default_rng(51)
    centers = rng.normal(size=(400, 8)) * 6
    small, large = (lsh.knn_lsh(frame(spark, groups(rng, n, 8, centers, 0.5)), 5, bucket_rows=100)[1] for n in (2000, 8000))
    assert large.pairs < 8 * small.pairs and large.pairs < 0.3 * large.all_pairs  # all pairs grow by 16


def test_equal_rows_and_string_ids(spark):
    rng = np.random.default_rng(52)
    x = rng.normal(size=(900, 4))
    x[:300] = x[0]  # more equal rows than a bucket takes
    rows, report = lsh.knn_lsh(frame(spark, x, lambda i: f"row{i:04d}", "string"), 5, bucket_rows=64)
    got = rows.collect()
    ids = {f"row{i:04d}": i for i in range(900)}
    assert true_recall(x, got, 5, ids) >= 0.9
    assert all(r.distance == 0 for r in got if ids[r.id] < 300)
    assert sum(ids[r.id] < 300 for r in got) == 1500


def test_small_tables_and_a_recall_out_of_reach(spark):
    rng = np.random.default_rng(53)
    x = rng.normal(size=(40, 3))
    rows, report = lsh.knn_lsh(frame(spark, x), 4)
    assert true_recall(x, rows.collect(), 4) == 1.0  # a bucket holds them all
    assert lsh.knn_lsh(frame(spark, x[:1]), 4)[0].count() == 0
    x = rng.normal(size=(500, 64))
    rows, report = lsh.knn_lsh(frame(spark, x), 4, recall=0.999, tables=1, probes=0, bucket_rows=20)
    assert report.tables == 0 and true_recall(x, rows.collect(), 4) == 1.0  # the exact join answered


def test_neighbor_purity_on_approximate_neighbors(spark):
    rng = np.random.default_rng(54)
    label = rng.integers(0, 5, 800)
    x = rng.normal(size=(5, 6))[label] * 4 + rng.normal(size=(800, 6))
    df = spark.createDataFrame([(i, [float(v) for v in r], f"c{c}") for i, (r, c) in enumerate(zip(x, label))], "id long, features array<double>, label string")
    exact = quality.neighbor_purity(df, 10, "id").first()
    near = quality.neighbor_purity(df, 10, "id", approximate=True).first()
    assert abs(exact.micro - near.micro) < 0.02 and abs(exact.macro - near.macro) < 0.02


def test_nothing_is_hashed_for_a_recall_out_of_reach(spark, monkeypatch):
    """Unclustered rows: the trial looks at the sampled queries only, and no row is hashed or dealt into buckets in vain."""
    monkeypatch.setattr(lsh, "_leaves", lambda *a: pytest.fail("all rows were dealt into buckets"))
    x = np.random.default_rng(55).normal(size=(600, 48))
    rows, report = lsh.knn_lsh(frame(spark, x), 4, recall=0.99, tables=2, bucket_rows=20)
    assert report.tables == 0 and true_recall(x, rows.collect(), 4) == 1.0


def test_trial_finds_what_the_buckets_hold(spark):
    """The hits of the trial against the buckets of all rows, with equal rows beyond the last hash."""
    rng = np.random.default_rng(56)
    x = groups(rng, 700, 6, rng.normal(size=(12, 6)) * 3, 0.5)
    x[:200] = x[0]
    df, k, tables, probes, size, seed = frame(spark, x).withColumnRenamed("features", "v"), 6, 5, 2, 32, 42
    exact, far = lsh._typical(df, k, seed)
    planes, offsets = rng.standard_normal((tables, 6, lsh.DEPTH)), rng.uniform(0, 2 * far, (tables, lsh.DEPTH))
    got = lsh._trial(df, exact, planes, offsets, 2 * far, probes, k, size, seed)
    got = {(r.id, r.tab): r.hits for r in got.itertuples()}
    visits, holds = {}, {}
    for r in lsh._leaves(df, planes, offsets, 2 * far, probes, size, seed).collect():
        visits.setdefault((r.tab, r.id), set()).add(r.bucket)
        if r.corpus:
            holds.setdefault(r.bucket, set()).add(r.id)
    dealt = 0
    for q, kth in exact.groupby("qid")["score"].max().items():
        near = {int(i) for i in np.flatnonzero(((x - x[q]) ** 2).sum(1) <= kth * (1 + 1e-9) + 1e-300)} - {q}
        seen, hits, want = set(), 0, 0
        for t in range(tables):
            seen |= near & set().union(*(holds.get(b, set()) for b in visits[t, q]))
            hits += got.get((q, t), 0)
            assert min(hits, k) == min(len(seen), k)
        dealt += q < 200
    assert dealt > 10
