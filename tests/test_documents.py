import json
import math

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import json_leaf as J
from tokenloom.functions.catalog import preset
from tokenloom.plans.programs import build_feature_table, drop_empty_records
from tokenloom.sources.documents import document_coverage, read_documents


def test_preset_widths():
    assert preset("base").width == 70
    assert preset("full_run").width == 84
    assert preset("comprehensive").width == 221
    assert preset("selected").width == 26
    assert preset("all").width == 84 + 80 + 4


def full_doc():
    return {
        "lowlevel": {"mfcc": {"mean": list(range(13)),
                              "cov": [[4.0 if i == j else 0.0 for j in range(13)] for i in range(13)]},
                     "spectral_centroid": {"mean": 1200.0},
                     "spectral_contrast_coeffs": {"mean": [0.1] * 6},
                     "average_loudness": [0.7, 0.1],
                     "spectral_rms": {"mean": 0.2, "var": 0.01}},
        "rhythm": {"bpm": 120.0, "onset_rate": 3.5,
                   "beats_loudness": {"mean": 0.3, "var": 9.0},
                   "bpm_histogram_first_peak_bpm": {"median": 118.0, "mean": 119.0},
                   "bpm_histogram_second_peak_bpm": [60.0],
                   "danceability": None},
        "tonal": {"hpcp": {"mean": [0.5] * 36}, "key_key": "c", "key_scale": "minor", "key_strength": 0.8},
    }


@pytest.fixture()
def doc_tree(tmp_path):
    root = tmp_path / "docs"
    (root / "a").mkdir(parents=True)
    (root / "a" / "1.json").write_text(json.dumps(full_doc()))
    (root / "a" / "2.json").write_text("{not json")
    d3 = full_doc()
    del d3["tonal"]
    (root / "a" / "3.json").write_text(json.dumps(d3))
    return str(root)


def test_feature_table(spark, doc_tree):
    tags = spark.createDataFrame([("t1", "a/1.mp3", "rock"), ("t2", "a/2.mp3", "pop"), ("t3", "a/3.mp3", "jazz"),
                                  ("t4", "a/4.mp3", "folk")], "track_id string, path string, genre string")
    fs = preset("full_run")
    results = {}
    for strategy in ("extract_first", "shuffle"):
        rows = drop_empty_records(build_feature_table(spark, tags, doc_tree, fs, strategy)).collect()
        results[strategy] = sorted((r["track_id"], r["json_full"], tuple(r["features"])) for r in rows)
    assert results["extract_first"] == results["shuffle"]
    out = {r["track_id"]: r for r in drop_empty_records(build_feature_table(spark, tags, doc_tree, fs)).collect()}
    assert set(out) == {"t1", "t3"}            # malformed and absent documents give no record
    names = fs.names
    f1 = dict(zip(names, out["t1"]["features"]))
    assert f1["mfcc_mean_3"] == 3.0 and f1["mfcc_std_0"] == 2.0
    assert f1["spec_centroid_mean_0"] == 1200.0 and f1["tempo_bpm"] == 120.0
    assert f1["beat_loudness_std"] == 3.0 and f1["onset_rate"] == 3.5
    # c minor -> relative major d#: circle-of-fifths position 9
    assert f1["key_vector_x"] == pytest.approx(0.8 * math.cos(2 * math.pi * 9 / 12))
    assert f1["key_vector_y"] == pytest.approx(0.8 * math.sin(2 * math.pi * 9 / 12))
    assert f1["key_vector_z"] == pytest.approx(-0.4)
    assert f1["spec_valley_mean_0"] is None     # missing leaf -> null, not a failure
    f3 = dict(zip(names, out["t3"]["features"]))
    assert f3["key_vector_x"] is None and f3["hpcp_mean_0"] is None
    cov = document_coverage(tags, read_documents(spark, doc_tree)).collect()[0]
    assert (cov["n_rows"], cov["n_found"]) == (4, 3)


def test_leaf_shapes(spark):
    docs = ['{"r":{"x":5}}', '{"r":{"x":[7,8]}}', '{"r":{"x":[]}}', '{"r":{"x":{"median":2,"mean":3}}}',
            '{"r":{"x":{"mean":3}}}', '{"r":{"x":null}}', '{"r":{}}', '{bad']
    df = spark.createDataFrame([(d,) for d in docs], "t string").select(J.parse("t").alias("d"))
    rows = df.select(J.scalar(F.col("d"), "r.x").alias("s"), J.scalar_or_first(F.col("d"), "r.x").alias("f"),
                     J.peak_value(F.col("d"), "r.x").alias("p")).collect()
    assert [r["s"] for r in rows] == [5.0, None, None, None, None, None, None, None]
    assert [r["f"] for r in rows] == [5.0, 7.0, None, None, None, None, None, None]
    assert [r["p"] for r in rows] == [5.0, 7.0, None, 2.0, 3.0, None, None, None]


def test_key_vector_cases(spark):
    rows = [("C", "major", 1.0), ("c", "minor", 1.0), ("Bb", "major", 1.0), ("e", "weird", 2.0), (None, "major", 1.0)]
    df = spark.createDataFrame(rows, "k string, s string, st double")
    out = df.select(*J.key_vector(F.col("k"), F.col("s"), F.col("st"))).collect()
    assert tuple(out[0]) == pytest.approx((1.0, 0.0, 0.5))
    assert tuple(out[1]) == pytest.approx((math.cos(1.5 * math.pi), math.sin(1.5 * math.pi), -0.5))
    assert tuple(out[2]) == (None, None, None)
    # e major is 4 fifths up: any non-major scale text gives z = -0.5
    assert tuple(out[3]) == pytest.approx((2 * math.cos(4 * math.pi / 6), 2 * math.sin(4 * math.pi / 6), -1.0))
    assert tuple(out[4]) == (None, None, None)


def test_selected_set_picks(spark):
    doc = {"lowlevel": {"gfcc": {"mean": list(range(13))}, "spectral_contrast_valleys": {"mean": [9, 8, 7, 6, 5, 4]}}}
    df = spark.createDataFrame([(json.dumps(doc),)], "t string").select(J.parse("t").alias("d"))
    fs = preset("selected")
    got = dict(zip(fs.names, df.select(fs.vector(F.col("d"))).collect()[0][0]))
    assert [got[f"gfcc_mean_{i}"] for i in (0, 1, 3, 5, 7, 11)] == [0, 1, 3, 5, 7, 11]
    assert [got[f"spec_valley_mean_{i}"] for i in (0, 3, 4, 5)] == [9, 6, 5, 4]


def test_comprehensive_leaves(spark):
    doc = {"lowlevel": {"spectral_flux": {"mean": 1.0, "var": 2.0}, "silence_rate_20dB": {"mean": 0.1},
                        "dynamic_complexity": 4.0, "zerocrossingrate": {"mean": 0.05}},
           "rhythm": {"beats_loudness": {"mean": 0.3, "var": 0.04}, "beats_count": [10, 11]},
           "tonal": {"tuning_frequency": [440.0], "chords_changes_rate": 0.2}}
    df = spark.createDataFrame([(json.dumps(doc),)], "t string").select(J.parse("t").alias("d"))
    fs = preset("comprehensive")
    got = dict(zip(fs.names, df.select(fs.vector(F.col("d"))).collect()[0][0]))
    assert got["spec_flux_mean"] == 1.0 and got["spec_flux_var"] == 2.0
    assert got["silence_rate_20dB"] == 0.1 and got["dynamic_complexity"] == 4.0
    assert got["beat_loudness_var"] == 0.04 and got["beats_count"] == 10.0
    assert got["tuning_frequency"] == 440.0 and got["chords_changes_rate"] == 0.2
    assert got["zerocrossingrate_mean"] == 0.05 and got["gfcc_mean_0"] is None


def test_strict_reader_and_missing_counts(spark):
    from tokenloom.plans.programs import assert_complete, missing_leaf_counts
    from tokenloom.operators.sample import preview
    df = spark.createDataFrame([('{"a":{"b":1}}',), ('{"a":{}}',)], "t string").select(J.parse("t").alias("d"))
    with pytest.raises(Exception):
        df.select(J.strict_scalar(F.col("d"), "a.b")).collect()
    feats = spark.createDataFrame([([1.0, None],), ([2.0, float("nan")],), ([3.0, 4.0],)], "features array<double>")
    got = {r["feature"]: r["n_missing"] for r in missing_leaf_counts(feats, ["x", "y"]).collect()}
    assert got == {"x": 0, "y": 2}
    with pytest.raises(ValueError, match="'y'"):
        assert_complete(feats, ["x", "y"])
    assert preview(feats, 2).count() == 2


def test_jsonl_documents(spark, tmp_path):
    from tokenloom.sources.documents import read_documents_jsonl
    p = tmp_path / "dump"
    p.mkdir()
    (p / "part-0.txt").write_text(
        json.dumps({"path": "a/1.json", "doc": full_doc()}) + "\n" + "{broken\n"
        + json.dumps({"path": "a/3.json", "doc": {"rhythm": {"bpm": 99.0}}}) + "\n")
    docs = read_documents_jsonl(spark, str(p))
    assert sorted(r["rel_path"] for r in docs.collect()) == ["a/1.json", "a/3.json"]
    tags = spark.createDataFrame([("t1", "a/1.mp3", "rock"), ("t3", "a/3.mp3", "pop"), ("t9", "a/9.mp3", "x")],
                                 "track_id string, path string, genre string")
    fs = preset("full_run")
    rows = {r["track_id"]: dict(zip(fs.names, r["features"])) for r in drop_empty_records(
        build_feature_table(spark, tags, str(p), fs, doc_format="jsonl")).collect()}
    assert set(rows) == {"t1", "t3"} and rows["t3"]["tempo_bpm"] == 99.0 and rows["t1"]["mfcc_std_0"] == 2.0


def test_array_leaf_ravel(spark):
    docs = ['{"t":{"h":{"mean":[[1,2],[3,4]]}}}', '{"t":{"h":{"mean":7}}}', '{"t":{"h":{"mean":[5,6]}}}',
            '{"t":{"h":{}}}']
    df = spark.createDataFrame([(d,) for d in docs], "t string").select(J.parse("t").alias("d"))
    got = [r[0] for r in df.select(J.array_leaf(F.col("d"), "t.h.mean")).collect()]
    assert got == [[1.0, 2.0, 3.0, 4.0], [7.0], [5.0, 6.0], None]


def test_document_names_below_the_exact_root(spark, tmp_path):
    """Nested folders that repeat the root's name, spaces, plus signs and percent signs."""
    from tokenloom.sources.documents import read_documents
    root = tmp_path / "a"
    names = ["media/a/x.json", "with space/z.json", "plus+sign/50%25.json", "a.json", "ümlaut/é.json"]
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text("{}")
    assert sorted(r["rel_path"] for r in read_documents(spark, f"{root}/").collect()) == sorted(names)


def test_elements_beyond_the_declared_width(spark):
    """They are left out of the features, counted per leaf, and refused in strict mode."""
    import json

    import pytest
    from pyspark.sql import functions as F

    from tokenloom.functions.catalog import preset
    from tokenloom.functions.json_leaf import parse
    from tokenloom.plans.programs import assert_widths, extra_leaf_counts
    fs = preset("full_run")
    docs = [{"lowlevel": {"mfcc": {"mean": [1.0] * n, "cov": [[1.0] * 13] * m}}} for n, m in ((13, 13), (15, 13), (20, 14), (0, 0))] + [{}]
    frame = spark.createDataFrame([(json.dumps(x),) for x in docs], "t string").select(parse("t").alias("doc"))
    got = {r.leaf: (r.n_documents, r.n_extra) for r in extra_leaf_counts(frame, fs).collect()}
    assert got["lowlevel.mfcc.mean"] == (2, 9) and got["lowlevel.mfcc.cov"] == (1, 1)
    assert all(v == (0, 0) for k, v in got.items() if "mfcc" not in k) and len(got) > 4
    assert frame.select(F.size(fs.vector(F.col("doc"))).alias("n")).distinct().collect()[0].n == fs.width
    with pytest.raises(ValueError, match="lowlevel.mfcc.cov"):
        assert_widths(frame, fs)
    assert_widths(frame.limit(1), fs)
