from pyspark.sql import functions as F

from conftest import SF_SMALL
from tokenloom.plans.inputs import embeddings
from tokenloom.plans.registry import fixture_codebook
from tokenloom.operators.rvq import apply_codebooks
from tokenloom.streaming.apply import stream_codes


def test_stream_equals_batch(spark):
    e = embeddings(spark, SF_SMALL)
    levels = fixture_codebook(e)
    batch = {r["vec_id"]: list(r["codes"]) for r in apply_codebooks(e, levels).collect()}
    streamed = {r["vec_id"]: list(r["codes"]) for r in stream_codes(spark, SF_SMALL, levels).collect()}
    assert streamed == batch


def test_stream_of_a_table_of_part_files(spark, tmp_path):
    """A table that is a folder of part files is streamed whole, like one that is a single file."""
    e = embeddings(spark, SF_SMALL)
    spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    (tmp_path / "embeddings.parquet.old").mkdir()
    levels = fixture_codebook(e)
    batch = {r["vec_id"]: list(r["codes"]) for r in apply_codebooks(e, levels).collect()}
    rows = stream_codes(spark, str(tmp_path), levels).collect()
    assert len(rows) == len(batch) and {r["vec_id"]: list(r["codes"]) for r in rows} == batch


def test_stream_dictionary_equals_batch(spark, tmp_path):
    import numpy as np
    from tokenloom.operators.dictlearn import sparse_codes
    from tokenloom.streaming.apply import stream_dictionary_ids
    e = embeddings(spark, SF_SMALL)
    rng = np.random.default_rng(14)
    atoms = rng.normal(size=(6, 64))
    atoms /= np.linalg.norm(atoms, axis=1, keepdims=True)
    batch = {r["vec_id"]: list(r["codes"]) for r in sparse_codes(e, atoms, 2).collect()}
    src = spark.readStream.schema(spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").schema) \
        .option("pathGlobFilter", "embeddings.parquet").parquet(SF_SMALL)
    stream = src.select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    coded = stream_dictionary_ids(stream, atoms, 2).select("vec_id", "codes")
    q = (coded.writeStream.format("memory").queryName("dict_stream_test").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = {r["vec_id"]: list(r["codes"]) for r in spark.table("dict_stream_test").collect()}
    assert got == batch


def test_streaming_tag_files(spark, tmp_path):
    """S1-S3 are stateless row parsing: the same function reads a stream of tag files."""
    from tokenloom.sources.tags import parse_tag_lines
    header = "TRACK_ID\tPATH\tTAGS"
    src = tmp_path / "incoming"
    src.mkdir()
    (src / "a.tsv").write_text(f"{header}\nt1\tp1\tgenre---rock\nt2\tp2\tgenre---pop\tgenre---jazz\n")
    (src / "b.tsv").write_text(f"{header}\nt3\tp3\n")
    lines = spark.readStream.format("text").load(str(src))
    parsed = parse_tag_lines(lines, header, "genre")
    q = (parsed.writeStream.format("memory").queryName("tag_stream_test").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = sorted((r["track_id"], r["genre"]) for r in spark.table("tag_stream_test").collect())
    assert got == [("t1", "rock"), ("t3", "")]


def test_stream_track_ids_equal_batch(spark, tmp_path):
    """New documents arriving as files get the same IDs as the batch path with the same models."""
    import json
    import numpy as np
    from tokenloom.functions.catalog import preset
    from tokenloom.functions.ids import codes_to_id
    from tokenloom.functions.vectors import nan_to_zero
    from tokenloom.operators import linalg
    from tokenloom.operators.rvq import apply_codebooks, fit_rvq, codebook_arrays
    from tokenloom.functions import json_leaf as J
    from tokenloom.streaming.apply import stream_track_ids
    rng = np.random.default_rng(23)
    fs = preset("selected")
    docs = []
    for i in range(60):
        docs.append({"path": f"a/{i}.json", "doc": {
            "lowlevel": {"gfcc": {"mean": list(rng.normal(i % 3, 1, 13))},
                         "spectral_flux": {"mean": float(rng.normal())}, "dissonance": {"mean": float(rng.normal())},
                         "average_loudness": float(rng.uniform())},
            "rhythm": {"danceability": float(rng.uniform())}}})
    folder = tmp_path / "incoming"
    folder.mkdir()
    for part in range(3):
        (folder / f"part-{part}.json").write_text("\n".join(json.dumps(d) for d in docs[part::3]) + "\n")
    tags = spark.createDataFrame([(f"t{i}", f"a/{i}.mp3") for i in range(60)], "track_id string, path string")
    batch_docs = spark.createDataFrame([(d["path"], json.dumps(d["doc"])) for d in docs], "rel_path string, text string")
    feats = (batch_docs.join(tags.withColumn("rel_path", F.replace("path", F.lit(".mp3"), F.lit(".json"))), "rel_path")
             .select("track_id", nan_to_zero(fs.vector(J.parse("text"))).alias("features")))
    z, scaler = linalg.standardize(feats)
    pca = linalg.fit_pca(z, k=3)
    scores = pca.transform(z).select("track_id", F.col("pca").alias("features"))
    book, _, _ = fit_rvq(scores, 2, 3, 10, 1)
    levels = codebook_arrays(book)
    expect = {r["track_id"]: r["semantic_id"] for r in apply_codebooks(scores, levels).select(
        "track_id", codes_to_id("codes").alias("semantic_id")).collect()}
    q = (stream_track_ids(spark, str(folder), tags, fs, scaler, pca, levels)
         .writeStream.format("memory").queryName("track_id_stream").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = {r["track_id"]: r["semantic_id"] for r in spark.table("track_id_stream").collect()}
    assert got == expect
