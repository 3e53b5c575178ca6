"""No operator brings row-sized data to the driver."""

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.ids import codes_to_id
from tokenloom.operators import discriminate, idstats, linalg, neighbors, quality, recsets, rvq
from tokenloom.operators.dictlearn import fit_dictionary


@pytest.fixture()
def collected(monkeypatch):
    try:  # the concrete DataFrame class of a classic (non-Connect) session
        from pyspark.sql.classic.dataframe import DataFrame as Concrete
    except ImportError:  # older layouts
        Concrete = DataFrame
    sizes = []
    orig = Concrete.collect

    def spy(self):
        rows = orig(self)
        sizes.append(len(rows))
        return rows
    monkeypatch.setattr(Concrete, "collect", spy)
    return sizes


def test_collects_are_model_sized(spark, collected):
    n, d = 6000, 6
    rng = np.random.default_rng(17)
    x = rng.normal(size=(n, d)) + rng.integers(0, 4, size=(n, 1))
    df = spark.createDataFrame([(i, [float(v) for v in r], str(i % 5), "g" + str(i % 3)) for i, r in enumerate(x)],
                               "id long, features array<double>, label string, genre string").repartition(8)
    z, _ = linalg.standardize(df)
    pca = linalg.fit_pca(z, ratio=0.9)
    scores = pca.transform(z).select("id", "label", "genre", F.col("pca").alias("features"))
    book, codes, _ = rvq.fit_rvq(scores, 2, 4, 5, 1)
    ids = codes.withColumn("semantic_id", codes_to_id("codes"))
    idstats.occupancy_detail(ids).collect()
    fit_dictionary(scores, 4, 2, 2, 500, id_col="id")
    neighbors.index_recall(ids, 5, 20, 42, "id", "features", "codes").collect()
    quality.quality_report(ids, ["label", "genre"], "semantic_id", "id", "features", 5, block_rows=1500).collect()
    discriminate.discrimination(df, df.select(F.col("id").alias("track_id"), "genre").withColumnRenamed(
        "track_id", "id"), [f"f{i}" for i in range(d)], ["genre"], "id", "features", top_n=3).collect()
    recsets.split_exact(df, F.col("id")).filter("rank < 0").collect()
    assert collected and max(collected) < 500, sorted(collected)[-5:]
