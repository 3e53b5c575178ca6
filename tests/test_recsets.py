from pyspark.sql import functions as F

from tokenloom.operators import recsets


def test_copies_rule(spark):
    df = spark.createDataFrame([(c,) for c in (1, 5, 15, 16, 17)], "c int")
    got = [r[0] for r in df.select(recsets.copies(F.col("c"), 16, 6)).collect()]
    assert got == [6, 4, 2, 1, 1]


def test_upsample_counts(spark):
    rows = [(i, "<001>" if i < 1 else "<002>" if i < 6 else "<003>") for i in range(40)]
    df = spark.createDataFrame(rows, "track_id int, semantic_id string")
    up = recsets.upsample(df, "semantic_id", 16, 6)
    got = {r["semantic_id"]: r["n"] for r in up.groupBy("semantic_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"<001>": 6, "<002>": 5 * 4, "<003>": 34}


def test_prompts(spark):
    rows = [(1, "sad", "rock", "piano"), (2, "", "rock", ""), (3, None, "", "drums"), (4, "", "", ""),
            (5, "calm", "jazz", "")]
    df = spark.createDataFrame(rows, "k int, mood string, genre string, instrument string")
    out = {r["k"]: r["p"] for r in df.select("k", recsets.prompt3(key=F.col("k").cast("string")).alias("p")).collect()}
    assert "sad rock with piano" in out[1]
    assert "rock" in out[2] and "with" not in out[2].replace("with rock", "")
    assert "with drums" in out[3]
    assert out[4] is None
    assert any(c.join(["calm", "jazz"]) in out[5] for c in recsets.CONNECTORS)
    p2 = df.select("k", recsets.prompt2(key=F.col("k").cast("string"), random_template=False).alias("p")).collect()
    assert {r["k"]: r["p"] for r in p2} == {1: "rock with piano", 2: None, 3: None, 4: None, 5: None}


def test_split_exact_and_disjoint(spark):
    df = spark.range(0, 1003).withColumnRenamed("id", "k")
    s = recsets.split_exact(df, F.col("k"), 42, n_buckets=8)
    counts = {r["split"]: r["n"] for r in s.groupBy("split").agg(F.count("*").alias("n")).collect()}
    n_train, n_val, n_test = recsets.split_sizes(1003)
    assert counts == {"train": n_train, "val": n_val, "test": n_test}
    assert (n_train, n_val, n_test) == (802, 100, 101)
    ranks = [r["rank"] for r in s.select("rank").collect()]
    assert sorted(ranks) == list(range(1, 1004))
    grouped = recsets.split_by_group(df.withColumn("g", F.col("k") % 50), "g")
    per = grouped.groupBy("g").agg(F.count_distinct("split").alias("d"))
    assert per.filter("d > 1").count() == 0


def test_hits_at_k(spark):
    cand = spark.createDataFrame([(1, 1, "<00 1>"), (1, 2, "<002>"), (2, 3, "<003>"), (2, 4, "<009>"),
                                  (3, 1, "<007>")], "query_id int, rank int, candidate string")
    truth = spark.createDataFrame([(1, "<001>"), (2, "<009>"), (3, "<001>"), (4, "<001>")],
                                  "query_id int, target string")
    r = recsets.hits_at_k(cand, truth, 3).collect()[0]
    # query 2's target is at rank 4 = k+1: a miss; query 4 has no candidates: a miss
    assert (r["n_queries"], r["n_hits"], r["hits_at_k"]) == (4, 1, 0.25)
    assert recsets.hits_at_k(cand, truth, 4).collect()[0]["n_hits"] == 2
