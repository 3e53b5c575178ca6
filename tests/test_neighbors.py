import numpy as np
from pyspark.sql import functions as F

from tokenloom.operators import neighbors, quality
from tokenloom.operators.sample import hash_sample


def make(spark, x, labels=None):
    rows = [(i, [float(v) for v in r], int(labels[i]) if labels is not None else 0) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, features array<double>, label int")


def brute_knn(x, k):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    out = {}
    for i in range(len(x)):
        order = sorted(range(len(x)), key=lambda j: (d[i, j], j))[:k]
        out[i] = order
    return out


def test_knn_blocks_match_brute_force(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 4, size=(60, 3)).astype(float)   # many exact ties and duplicates
    df = make(spark, x)
    ref = brute_knn(x, 5)
    for blocks, chunk in ((1, 2048), (3, 7), (7, 4)):
        got = {}
        for r in neighbors.knn_exact(df, 5, "id", "features", n_blocks=blocks, chunk_rows=chunk).collect():
            got.setdefault(r["id"], {})[r["rank"]] = r["neighbor_id"]
        assert {i: [got[i][k] for k in range(1, 6)] for i in got} == ref


def test_query_topk_and_recall(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 4))
    df = make(spark, x).withColumn("codes", F.array(F.lit(1), F.lit(2)))
    # every row shares a token with every query: recall is exactly 1
    r = neighbors.index_recall(df, 5, 10, 42, "id", "features", "codes").collect()[0]
    assert r["recall"] == 1.0 and r["n_queries"] == 10
    # nothing shared: candidates empty, recall 0
    solo = make(spark, x).withColumn("codes", F.array(F.col("id").cast("int")))
    assert neighbors.index_recall(solo, 5, 10, 42, "id", "features", "codes").collect()[0]["recall"] == 0.0
    qs = hash_sample(df, "id", 3, 42)
    top = neighbors.query_topk(df, qs, 4, "id", "features", "cosine").filter("kind = 'all'").collect()
    xn = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
    for q in {r["qid"] for r in top}:
        sims = xn @ xn[q]
        sims[q] = -np.inf
        exp = sorted(range(len(x)), key=lambda j: (-sims[j], j))[:4]
        got = [r["nid"] for r in sorted((r for r in top if r["qid"] == q), key=lambda r: r["rank"])]
        assert got == exp


def test_token_candidates(spark):
    rows = [(0, [1, 2]), (1, [1, 3]), (2, [4, 2]), (3, [5, 6])]
    df = spark.createDataFrame(rows, "id long, codes array<int>")
    q = df.filter("id = 0")
    got = sorted((r["qid"], r["id"]) for r in neighbors.token_candidates(df, q).collect())
    assert got == [(0, 1), (0, 2)]


def test_purity(spark):
    df = spark.createDataFrame([(0, "a", "x"), (1, "a", "x"), (2, "b", "x"), (3, "b", "y"), (4, "c", "")],
                               "id int, cluster string, label string")
    r = quality.cluster_purity(df, "cluster", "label").collect()[0]
    assert (r["micro"], r["macro"]) == (0.75, 0.75)        # equal cluster sizes: micro = macro
    empty = quality.cluster_purity(df.filter("label = ''"), "cluster", "label").collect()[0]
    assert (empty["micro"], empty["macro"]) == (0.0, 0.0)


def test_neighbor_purity_brute(spark):
    rng = np.random.default_rng(9)
    labels = rng.integers(0, 3, size=50)
    x = rng.normal(size=(50, 3)) + labels[:, None]
    df = make(spark, x, labels)
    k = 5
    ref = brute_knn(x, k)
    s = np.array([np.bincount(labels[ref[i]]).max() / k for i in range(50)])
    macro = np.mean([s[labels == c].mean() for c in np.unique(labels)])
    r = quality.neighbor_purity(df, k, "id", "features", "label").collect()[0]
    assert abs(r["micro"] - s.mean()) < 1e-9 and abs(r["macro"] - macro) < 1e-9
    small = quality.neighbor_purity(df.limit(5), k, "id", "features", "label").collect()[0]
    assert (small["micro"], small["macro"]) == (0.0, 0.0)


def test_pivot_strategy_exact(spark):
    rng = np.random.default_rng(15)
    sets = [rng.integers(0, 3, size=(90, 3)).astype(float),                      # duplicates and ties
            np.concatenate([rng.normal(c, 0.05, size=(30, 4)) for c in rng.normal(0, 5, size=(4, 4))]),
            rng.normal(size=(80, 6))]
    for x in sets:
        df = make(spark, x)
        ref = brute_knn(x, 4)
        for piv in (1, 5):
            got = {}
            for r in neighbors.knn_pivot(df, 4, "id", "features", n_pivots=piv, block_rows=16).collect():
                got.setdefault(r["id"], {})[r["rank"]] = r["neighbor_id"]
            assert {i: [got[i][j] for j in range(1, 5)] for i in got} == ref


def test_candidate_cells_prune_clusters():
    rng = np.random.default_rng(16)
    x = np.concatenate([rng.normal(c, 0.1, size=(50, 2)) for c in ([0, 0], [50, 0], [0, 50], [50, 50])])
    piv = x[[0, 50, 100, 150]]
    cell = ((x[:, None, :] - piv[None]) ** 2).sum(-1).argmin(1)
    dp = np.sqrt(((x - piv[cell]) ** 2).sum(1))
    counts = np.bincount(cell, minlength=4).astype(float)
    radius = np.array([dp[cell == c].max() for c in range(4)])
    cands = neighbors.candidate_cells(piv, counts, radius, 5)
    assert [list(c) for c in cands] == [[0], [1], [2], [3]]   # far-apart clusters: only the own cell


def test_knn_with_empty_blocks(spark):
    """Many more blocks than rows: most blocks are empty and must contribute nothing."""
    rng = np.random.default_rng(19)
    x = rng.normal(size=(12, 3))
    df = make(spark, x)
    ref = brute_knn(x, 3)
    got = {}
    for r in neighbors.knn_exact(df, 3, "id", "features", n_blocks=40).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbor_id"]
    assert {i: [got[i][j] for j in range(1, 4)] for i in got} == ref


def test_knn_string_ids(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(f"track_{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)],
                               "track_id string, features array<double>")
    ref = brute_knn(x, 4)
    for strategy in ("blocks", "pivot"):
        got = {}
        for r in neighbors.knn_exact(df, 4, "track_id", "features", n_blocks=3 if strategy == "blocks" else None,
                                     block_rows=16, strategy=strategy).collect():
            got.setdefault(r["track_id"], {})[r["rank"]] = r["neighbor_id"]
        assert {int(i[6:]): [int(got[i][j][6:]) for j in range(1, 5)] for i in got} == ref
    qs = df.filter("track_id < 'track_005'")
    top = neighbors.query_topk(df, qs, 3, "track_id", "features", "euclidean").filter("kind = 'all'").collect()
    assert {r["qid"] for r in top} == {f"track_{i:03d}" for i in range(5)} and all(
        isinstance(r["nid"], str) for r in top)


def test_query_chunks(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "QUERY_CHUNK", 3)
    rng = np.random.default_rng(25)
    x = rng.normal(size=(50, 4))
    df = make(spark, x).withColumn("codes", F.array(F.lit(1)))
    qs = df.filter("id < 10")
    top = neighbors.query_topk(df, qs, 4, "id", "features", "euclidean", "codes").collect()
    d = ((x[:10, None, :] - x[None, :, :]) ** 2).sum(-1)
    for q in range(10):
        d[q, q] = np.inf
        exp = sorted(range(50), key=lambda j: (d[q, j], j))[:4]
        for kind in ("all", "cand"):
            got = [r["nid"] for r in sorted((r for r in top if r["qid"] == q and r["kind"] == kind),
                                            key=lambda r: r["rank"])]
            assert got == exp


def test_string_ids_break_ties_by_id(spark):
    """Equal distances: the lowest id wins, for strings as for integers."""
    points = {"d": 0.0, "a": 1.0, "b": 1.0, "c": -1.0, "e": -1.0}
    df = spark.createDataFrame([(k, [v, 0.0]) for k, v in points.items()], "id string, features array<double>")
    got = {(r["id"], r["rank"]): r["neighbor_id"] for r in neighbors.knn_exact(df, 3, "id", "features").collect()}
    assert [got["d", r] for r in (1, 2, 3)] == ["a", "b", "c"]
    assert [got["e", r] for r in (1, 2)] == ["c", "d"]


def test_knn_far_from_the_origin(spark):
    """Data around 1e7 gives the neighbor lists of the exact differences."""
    rng = np.random.default_rng(12)
    x = 1e7 + rng.normal(size=(150, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    want = np.argsort(d2, axis=1)[:, :4]
    for kw in ({"block_rows": 40}, {"block_rows": 1000}, {"strategy": "pivot", "block_rows": 40}):
        got = {(r["id"], r["rank"]): r["neighbor_id"] for r in neighbors.knn_exact(df, 4, "id", "features", **kw).collect()}
        assert all(got[i, k + 1] == want[i, k] for i in range(150) for k in range(4))


def test_more_queries_than_a_part(spark, monkeypatch):
    from tokenloom.operators import neighbors as N
    rng = np.random.default_rng(13)
    df = spark.createDataFrame([(i, [float(v) for v in r], [int(i % 3), int(i % 5)]) for i, r in enumerate(rng.normal(size=(60, 4)))],
                               "id long, features array<double>, codes array<int>")
    one = sorted(map(tuple, N.query_topk(df, df, 3, "id", "features", "cosine", "codes").collect()))
    pairs = sorted(map(tuple, N.token_candidates(df, df).collect()))
    monkeypatch.setattr(N, "FEW_QUERIES", 20)
    assert sorted(map(tuple, N.query_topk(df, df, 3, "id", "features", "cosine", "codes").collect())) == one
    assert sorted(map(tuple, N.token_candidates(df, df).collect())) == pairs


def test_every_row_a_query_in_blocks(spark, monkeypatch):
    """The block join against brute force: string ids that break ties, self excluded, candidates by any shared token."""
    monkeypatch.setattr(neighbors, "FEW_QUERIES", 0)
    rng = np.random.default_rng(40)
    x = rng.integers(-2, 3, size=(90, 3)).astype(float) + 0.5          # many equal cosines
    codes = rng.integers(0, 4, size=(90, 2))
    names = [f"n{k:02d}" for k in rng.permutation(90)]
    df = spark.createDataFrame([(n, [float(v) for v in r], [int(c) for c in cs]) for n, r, cs in zip(names, x, codes)],
                               "name string, features array<double>, codes array<int>")
    for metric in ("euclidean", "cosine"):
        got = {}
        for r in neighbors.query_topk(df, df.filter("name < 'n70'"), 6, "name", "features", metric, "codes", block_rows=17).collect():
            got.setdefault((r["kind"], r["qid"]), {})[r["rank"]] = (r["nid"], r["score"])
        unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
        s = ((x[:, None] - x[None]) ** 2).sum(-1) if metric == "euclidean" else -np.round(unit @ unit.T, 9)
        for i, n in enumerate(names):
            if n >= "n70":
                continue
            for kind in ("all", "cand"):
                ok = [j for j in range(90) if j != i and (kind == "all" or (codes[i] == codes[j]).any())]
                want = sorted(ok, key=lambda j: (s[i, j], names[j]))[:6]
                own = got[kind, n]
                assert [round(abs(own[k + 1][1]), 6) for k in range(6)] == [round(abs(s[i, j]), 6) for j in want]
                if metric == "euclidean":
                    assert [own[k + 1][0] for k in range(6)] == [names[j] for j in want]


def test_knn_of_groups_far_apart(spark):
    """Groups of unit spread, millions apart: the matrix product's digits cancel, the lists must not change."""
    rng = np.random.default_rng(41)
    for far in (1e6, 1e7, 1e8):
        x = np.concatenate([rng.normal(size=(60, 8)) + s * far for s in (-1, 0, 1)])
        ref = brute_knn(x, 5)
        for kw in ({"n_blocks": 1}, {"n_blocks": 3, "chunk_rows": 16}, {"strategy": "pivot", "block_rows": 40}):
            got = {}
            for r in neighbors.knn_exact(make(spark, x), 5, "id", "features", **kw).collect():
                got.setdefault(r["id"], {})[r["rank"]] = r["neighbor_id"]
            assert {i: [got[i][j] for j in range(1, 6)] for i in got} == ref, (far, kw)


def test_query_topk_with_empty_partitions(spark, tmp_path):
    """Partitions without rows (splits of a file, say) add nothing, whatever the id type, and do not fail."""
    rng = np.random.default_rng(51)
    x = rng.normal(size=(12, 3))
    for kind, name in (("long", lambda i: i), ("string", lambda i: f"n{i:02d}")):
        df = spark.createDataFrame([(name(i), [float(v) for v in r], [i % 2]) for i, r in enumerate(x)],
                                   f"id {kind}, features array<double>, codes array<int>")
        some = df.repartition(30, "id")
        assert some.groupBy(F.spark_partition_id()).count().count() < 30
        for codes in (None, "codes"):
            one, more = (sorted(map(tuple, neighbors.query_topk(d, df, 3, "id", "features", "euclidean", codes).collect()))
                         for d in (df.coalesce(1), some))
            assert more == one and len([r for r in one if r[1] == "all"]) == 36


def test_lists_a_row_do_not_grow_with_the_table(spark, monkeypatch):
    """Small blocks asked of a larger table: a row still meets no more than BLOCKS blocks, with the same neighbors."""
    rng = np.random.default_rng(52)
    merge, parts = neighbors.topk_merge, []
    monkeypatch.setattr(neighbors, "topk_merge", lambda df, *a, **kw: parts.append(df) or merge(df, *a, **kw))
    for n in (200, 400):
        x = rng.normal(size=(n, 6))
        df, ref = make(spark, x), brute_knn(x, 2)
        for run in (lambda: neighbors.knn_exact(df, 2, block_rows=4), lambda: neighbors.knn_exact(df, 2, block_rows=4, strategy="pivot"),
                    lambda: neighbors.query_topk(df, df, 2, metric="euclidean", few=0, block_rows=4).select(
                        F.col("qid").alias("id"), "rank", F.col("nid").alias("neighbor_id"))):
            got = {(r["id"], r["rank"]): r["neighbor_id"] for r in run().collect()}
            assert all(got[i, k + 1] == ref[i][k] for i in range(n) for k in range(2))
            assert parts.pop().count() <= n * 2 * 32


def test_tiles_are_bounded(monkeypatch):
    """A pair of large blocks holds tiles of distances, never a chunk of one side against all of the other."""
    import pandas as pd
    rng = np.random.default_rng(53)
    x, sizes, scores = rng.normal(size=(300, 3)), [], neighbors._scores
    monkeypatch.setattr(neighbors, "_scores", lambda q, c, m: sizes.append(len(q) * len(c)) or scores(q, c, m))
    rows = pd.DataFrame({"id": np.arange(300), "v": list(x), "blk": [0] * 100 + [1] * 200, "pa": 0, "pb": 1})
    found = neighbors._pair_topk(3, "euclidean", 16)(rows)
    assert max(sizes) <= 16 * 16 and len(found) == 300 * 3


def test_candidates_of_a_pair_are_few(monkeypatch):
    """Tiles in single precision pick the candidates: few pairs are rescored where rows differ, fewer yet where the own
    block has bounded the lists, and rows of any magnitude get the lists of the exact differences."""
    import pandas as pd
    import pytest
    rng = np.random.default_rng(54)
    x, rescored, plain = rng.normal(size=(600, 24)), [], neighbors._rescored
    monkeypatch.setattr(neighbors, "_rescored", lambda q, c, r, col: rescored.append(len(r)) or plain(q, c, r, col))
    monkeypatch.setattr(neighbors, "_nearest", lambda *a, **kw: pytest.fail("a tile was ranked in double precision"))
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    rows = pd.DataFrame({"id": np.arange(600), "v": list(x), "blk": [0] * 300 + [1] * 300, "pa": 0, "pb": 1})
    own = np.sort(np.concatenate([d[:300, :300], d[300:, 300:]]), axis=1)[:, 4]
    for scale in (1.0, 1e30, 1e-30):
        for cut in (None, own * scale * scale):
            rescored.clear()
            part = rows.assign(v=list(x * scale)) if cut is None else rows.assign(v=list(x * scale), cut=cut * (1 + 1e-12))
            found = neighbors._pair_topk(5, "euclidean", 100)(part)
            assert sum(rescored) <= (20 if cut is None else 8) * 600
            for i in range(600):
                far = slice(300, 600) if i < 300 else slice(0, 300)
                want = far.start + np.argsort(d[i, far])[:5]
                if cut is not None:
                    want = [j for j in want if d[i, j] <= own[i] * (1 + 1e-12)]
                assert list(found[found["id"] == i].sort_values("score")["nid"]) == list(want)


def test_a_block_with_itself_computes_a_distance_once(monkeypatch):
    import pandas as pd
    x, tiles, scores = np.random.default_rng(55).normal(size=(160, 4)), [], neighbors._scores
    monkeypatch.setattr(neighbors, "_scores", lambda q, c, m: tiles.append(1) or scores(q, c, m))
    for metric, of in (("euclidean", x), ("cosine", x / np.linalg.norm(x, axis=1, keepdims=True))):
        tiles.clear()
        found = neighbors._pair_topk(3, metric, 16)(pd.DataFrame({"id": np.arange(160), "v": list(of), "blk": 0, "pa": 0, "pb": 0}))
        assert sum(tiles) == 55  # of 10 x 10
        ref = brute_knn(of, 3)
        assert all(list(found[found["id"] == i].sort_values("score")["nid"]) == ref[i] for i in range(160))
