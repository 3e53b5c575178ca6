"""The stored candidate index against all pairs, with a token that a third of all rows share."""
import numpy as np
from pyspark.sql import functions as F

from tokenloom.operators import neighbors, postings


def coded(spark, n, seed, name=lambda i: i, kind="long"):
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, 40, size=(n, 3))
    codes[rng.random(n) < 0.34, 1] = 7                      # a hot token
    return spark.createDataFrame([(name(i), [int(c) for c in r]) for i, r in enumerate(codes)], f"id {kind}, codes array<int>"), codes


def test_index_of_a_hot_token(spark, tmp_path):
    df, codes = coded(spark, 1500, 60)
    path = str(tmp_path / "index")
    postings.write_index(df, path, segment_rows=50, buckets=8)
    stored = spark.read.parquet(f"{path}/postings")
    hot = stored.where("level = 1 AND token = 7")
    assert hot.count() >= 8 and hot.agg(F.max(F.size("rows"))).first()[0] < 120
    assert stored.select(F.sum(F.size("rows"))).first()[0] == 4500
    queries = df.where("id % 50 = 0")
    found = postings.candidates(spark, path, queries)
    got = found.collect()
    want = {(q, i) for q in range(0, 1500, 50) for i in range(1500) if i != q and (codes[q] == codes[i]).any()}
    assert len(got) == len(want) and {(r.qid, r.id) for r in got} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "SortMergeJoin" not in plan  # folders pruned, segments not shuffled
    bounds = {r.qid: r for r in postings.candidate_bounds(spark, path, queries).collect()}
    for q in range(0, 1500, 50):
        n = sum(1 for i in range(1500) if (codes[q] == codes[i]).any())
        assert bounds[q].at_least <= n <= bounds[q].at_most


def test_as_the_lookup_without_an_index(spark, tmp_path):
    df, _ = coded(spark, 300, 61, lambda i: f"r{i:03d}", "string")
    df = df.unionByName(spark.createDataFrame([("none", None), ("empty", []), ("hole", [None, 7, None])], "id string, codes array<int>"))
    path = str(tmp_path / "index")
    postings.write_index(df, path)
    queries = df.where("id < 'r020' OR id IN ('none', 'empty', 'hole')")
    want = sorted(map(tuple, neighbors.token_candidates(df, queries).collect()))
    assert sorted(map(tuple, postings.candidates(spark, path, queries).collect())) == want
    far = spark.createDataFrame([("x", [99, 99, 99])], "id string, codes array<int>")
    assert postings.candidates(spark, path, far).count() == 0
    assert postings.candidate_bounds(spark, path, far).collect()[0].at_most == 0
