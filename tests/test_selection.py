"""Exact quartiles and group splits at sizes and shapes that sketches and single windows get wrong."""
import math
import random

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import discriminate as D
from tokenloom.operators import recsets


def want(values):
    own = sorted(v for v in values if v is not None and not math.isnan(v))
    return tuple(own[max(1, math.ceil(q * len(own))) - 1] if own else None for q in (0.25, 0.5, 0.75))


def test_quartiles_of_any_values(spark):
    rng = random.Random(80)
    inf = float("inf")
    groups = {
        "one": [4.5], "two": [1.0, 2.0], "equal": [7.25] * 40, "none": [None, None], "nan": [float("nan"), 1.0, 3.0, 2.0, None],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(500)],
        "huge": [1.7e308, -1.7e308, 1.0, 0.0, 5e307], "tiny": [5e-324 * k for k in range(30)], "ends": [-inf, inf, inf, 0.5, -0.5, 3.0, -inf],
        "steps": [float(rng.randrange(3)) for _ in range(300)], "heavy": [math.exp(rng.gauss(0, 8)) for _ in range(700)],
        None: [rng.gauss(0, 1) for _ in range(101)], "near": [1.0 + k * 2.0 ** -52 for k in range(9)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    rng.shuffle(rows)
    got = {r.g: r for r in D.value_quantiles(spark.createDataFrame(rows, "g string, value double"), ["g"]).collect()}
    for g, vs in groups.items():
        assert (got[g].q25, got[g].median, got[g].q75) == want(vs), g
        assert got[g].n == len(vs)
    assert D.value_quantiles(spark.createDataFrame([], "g string, value double"), ["g"]).count() == 0


def test_quartiles_of_a_million_values(spark):
    """A million distinct values, and a million with one value that half of them share: ranks beyond a sketch's accuracy."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit("distinct").alias("g"), (F.pmod(F.col("id") * 7919, F.lit(n)) / 3).alias("value"))
    rows = rows.unionByName(spark.range(n).select(F.lit("half").alias("g"), F.when(F.col("id") % 2 == 0, 5.0).otherwise(F.col("id") / 1e5).alias("value")))
    got = {r.g: r for r in D.value_quantiles(rows, ["g"]).collect()}
    assert (got["distinct"].q25, got["distinct"].median, got["distinct"].q75) == tuple((n * q // 4 - 1) / 3 for q in (1, 2, 3))
    assert (got["half"].q25, got["half"].median, got["half"].q75) == want([5.0 if k % 2 == 0 else k / 1e5 for k in range(n)])


def test_density_adds_up(spark):
    rng = random.Random(81)
    rows = [("a", rng.gauss(0, 2)) for _ in range(400)] + [("b", 3.0)] * 5 + [("c", None), ("d", float("inf")), ("d", 1.0), ("d", 2.0)]
    got = D.value_density(spark.createDataFrame(rows, "g string, value double"), ["g"], bins=10).collect()
    a = [r for r in got if r.g == "a"]
    assert sum(r.n for r in a) == 400 and abs(sum(r.density * (r.right - r.left) for r in a) - 1) < 1e-9
    assert all(0 <= r.bin < 10 for r in got) and [(r.n, r.density) for r in got if r.g == "b"] == [(5, None)]
    assert sum(r.n for r in got if r.g == "d") == 2 and not [r for r in got if r.g == "c"]


@pytest.mark.parametrize("hot", [0, 400])
def test_group_split(spark, hot):
    """No group in two parts; sizes off by at most half of the groups at their borders, also beside a group of a third of all rows."""
    rng = random.Random(82)
    rows = [(g, k) for g in range(200) for k in range(rng.choice([1, 1, 2, 6, 9]))] + [(9999, k) for k in range(hot)] + [(None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "g long, k long").repartition(7)
    got = recsets.split_by_group(df, "g", n_buckets=8)
    assert sorted((r.g or -1, r.k) for r in got.collect()) == sorted((g or -1, k) for g, k in rows)
    per = got.groupBy("g").agg(F.count_distinct("split").alias("d"), F.count("*").alias("n"), F.first("split").alias("split")).collect()
    assert all(r.d == 1 for r in per)
    sizes = {s: sum(r.n for r in per if r.split == s) for s in ("train", "val", "test")}
    n_train, n_val, n_test = recsets.split_sizes(len(rows))
    largest = max(r.n for r in per)
    assert abs(sizes["train"] - n_train) <= largest / 2 + 0.5 and abs(sizes["train"] + sizes["val"] - n_train - n_val) <= largest / 2 + 0.5
    again = recsets.split_by_group(df.repartition(3), "g", n_buckets=64)
    assert sorted(map(str, again.select("g", "k", "split").collect())) == sorted(map(str, got.select("g", "k", "split").collect()))
