import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.functions.catalog import pack_wide, preset
from tokenloom.plans import programs as P
from tokenloom.sources import store

GENRES = ["rock", "pop", "jazz", "folk"]
MOODS = ["happy", "sad", "calm"]
INSTR = ["piano", "guitar", "drums"]


def make_doc(rng, g):
    base = g * 3.0
    return {
        "lowlevel": {
            "mfcc": {"mean": list(rng.normal(base, 1, 13)), "cov": np.diag(rng.uniform(1, 4, 13)).tolist()},
            "melbands": {"mean": list(rng.normal(base, 1, 40)), "var": list(rng.uniform(1, 2, 40))},
            "gfcc": {"mean": list(rng.normal(base, 1, 13)), "cov": np.diag(rng.uniform(1, 4, 13)).tolist()},
            "spectral_centroid": {"mean": float(rng.normal(1000 + 100 * g, 10))},
            "spectral_contrast_coeffs": {"mean": list(rng.normal(0, 1, 6))},
            "spectral_contrast_valleys": {"mean": list(rng.normal(0, 1, 6))},
            "barkbands_skewness": {"mean": float(rng.normal())}, "barkbands_kurtosis": {"mean": float(rng.normal())},
            "spectral_flux": {"mean": float(rng.normal(g, 1))}, "spectral_spread": {"mean": float(rng.normal())},
            "spectral_skewness": {"mean": float(rng.normal())}, "spectral_kurtosis": {"mean": float(rng.normal())},
            "spectral_rms": {"mean": float(rng.normal())}, "erbbands_spread": {"mean": float(rng.normal())},
            "erbbands_flatness_db": {"mean": float(rng.normal())}, "erbbands_crest": {"mean": float(rng.normal())},
            "dissonance": {"mean": float(rng.normal())}, "average_loudness": float(rng.uniform()),
            "spectral_complexity": {"mean": 1.0, "var": float(rng.uniform())},
            "spectral_entropy": {"mean": float(rng.normal())},
            "spectral_energyband_high": {"mean": 1.0}, "spectral_energyband_low": {"mean": 2.0},
            "spectral_energyband_middle_high": {"mean": 3.0}, "spectral_energyband_middle_low": {"mean": 4.0},
        },
        "rhythm": {"bpm": float(rng.normal(120, 10)), "onset_rate": float(rng.uniform(1, 5)),
                   "danceability": float(rng.uniform()), "beats_loudness": {"mean": 0.5, "var": 0.04}},
        "tonal": {"hpcp": {"mean": list(rng.uniform(0, 1, 36))}, "key_key": ["c", "a", "f#"][g % 3],
                  "key_scale": ["major", "minor"][g % 2], "key_strength": 0.7,
                  "hpcp_entropy": {"mean": float(rng.normal())}, "tuning_equal_tempered_deviation": 0.1},
    }


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    docs = root / "docs"
    rng = np.random.default_rng(12)
    header = "TRACK_ID\tARTIST_ID\tALBUM_ID\tPATH\tDURATION\tTAGS"
    files = {c: [header] for c in ("genre", "mood", "instrument")}
    for i in range(90):
        g = i % 4
        path = f"{i % 10:02d}/{i}.mp3"
        (docs / f"{i % 10:02d}").mkdir(parents=True, exist_ok=True)
        (docs / path.replace(".mp3", ".json")).write_text(json.dumps(make_doc(rng, g)))
        files["genre"].append(f"track_{i}\ta\tb\t{path}\t1.0\tgenre---{GENRES[g]}")
        if i % 3:
            files["mood"].append(f"track_{i}\ta\tb\t{path}\t1.0\tmood/theme---{MOODS[i % 3]}")
        if i % 5:
            files["instrument"].append(f"track_{i}\ta\tb\t{path}\t1.0\tinstrument---{INSTR[i % 3]}")
    paths = {}
    for c, lines in files.items():
        p = root / f"{c}.tsv"
        p.write_text("\n".join(lines) + "\n")
        paths[c] = str(p)
    return {"tags": paths, "docs": str(docs), "root": root}


def test_run_full(spark, corpus):
    out = str(corpus["root"] / "out_full")
    res = P.run_full(spark, corpus["tags"], corpus["docs"], out, ratio=0.8, n_atoms=8, n_nonzero=2,
                     max_iter=3, batch_size=64)
    feats = res["features"]
    assert feats.count() == 90 - 90 // 15  # rows with >= 2 of 3 tag categories
    assert feats.select(F.size("features")).first()[0] == preset("full_run").width
    ids = res["ids"]
    assert ids.filter(F.col("semantic_id").rlike("^(<[0-9]{3}>){2}$")).count() == ids.count()
    pairs = res["pairs"]
    counts = {r["split"]: r["n"] for r in pairs.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sum(counts.values()) == pairs.count() and set(counts) == {"train", "val", "test"}
    # stored stages are reused on a second run (S10) and the model reloads
    stored = sorted(p.name for p in (corpus["root"] / "out_full" / "dataset_with_semantic_ids").iterdir())
    again = P.run_full(spark, corpus["tags"], corpus["docs"], out, ratio=0.8, n_atoms=8, n_nonzero=2,
                       max_iter=3, batch_size=64)
    assert again["features"].count() == feats.count()
    assert stored == sorted(p.name for p in (corpus["root"] / "out_full" / "dataset_with_semantic_ids").iterdir())
    reloaded = P.load_dictionary_ids(res["scores"], out, "dictionary")
    assert reloaded.count() == res["scores"].count()
    cov = res["document_coverage"].collect()[0]
    assert cov["coverage_pct"] == 100.0
    written = store.read_csv(spark, f"{out}/dataset_with_semantic_ids_csv")
    assert sorted(r.semantic_id for r in written.collect()) == sorted(r.semantic_id for r in ids.collect())
    together = P.run_full(spark, corpus["tags"], corpus["docs"], out, ratio=0.8, n_atoms=8, n_nonzero=2, max_iter=3, batch_size=64,
                          group_split=True)["pairs"]
    assert together.groupBy("track_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    tc = {r["category"]: r["n_tagged"] for r in res["tag_coverage"].collect()}
    assert tc == {"genre": 90, "mood": 60, "instrument": 72}
    assert {r["category"] for r in res["top_tags"].collect()} == {"genre", "mood", "instrument"}
    assert res["id_detail"].collect()[0]["unique_ids"] >= 1
    miss = {r["feature"]: r["n_missing"] for r in res["missing_leaves"].collect()}
    assert miss["mfcc_mean_0"] == 0 and miss["spec_valley_mean_0"] == 0 and len(miss) == preset("full_run").width
    # other parameters: the model and the IDs are made anew (D = 4: tokens below 8)
    small = P.run_full(spark, corpus["tags"], corpus["docs"], out, ratio=0.8, n_atoms=4, n_nonzero=2, max_iter=1,
                       batch_size=64)
    assert small["ids"].select(F.max(F.array_max("codes"))).first()[0] < 8
    assert spark.read.parquet(f"{out}/dictionary/dictionary").count() == 4


def test_run_two_tags(spark, corpus):
    res = P.run_two_tags(spark, corpus["tags"], corpus["docs"], str(corpus["root"] / "out_two"), max_iter=2,
                         batch_size=64)
    feats = res["features"]
    assert feats.count() == 90 - 90 // 5
    assert feats.select(F.size("features")).first()[0] == 26
    assert res["pairs"].filter(F.col("prompt").isNull()).count() == 0


def test_run_discrimination(spark, corpus):
    res = P.run_discrimination(spark, corpus["tags"], corpus["docs"], str(corpus["root"] / "out_disc"), top_n=3)
    d = res["discrimination"]
    top = d.filter("category = 'genre' AND rank = 1").collect()[0]
    assert top["significant"] and top["f_statistic"] > 10
    assert {r["category"] for r in res["summary"].collect()} == {"genre", "mood", "instrument"}
    assert res["contrast_valley"].select("pair").distinct().count() == 6
    # T5 and T9 of the top six features, and the result files
    pairs = res["pairs"].collect()
    values = res["pair_values"]
    assert {(r.category, r.pair, r.feature_x, r.feature_y) for r in values.select("category", "pair", "feature_x", "feature_y").distinct().collect()} == {
        (r.category, r.pair, r.feature_x, r.feature_y) for r in pairs}
    labeled = res["violin_values"].groupBy("category", "feature").count().collect()
    assert len(labeled) == 18
    quart = {(r.category, r.feature, r.label): r for r in res["violin_quantiles"].collect()}
    rows = res["violin_values"].filter("category = 'genre' AND label = 'rock'").collect()
    for feature in {r.feature for r in rows}:
        own = sorted(r.value for r in rows if r.feature == feature and r.value is not None)
        assert quart["genre", feature, "rock"].median == own[-(-len(own) // 2) - 1]
    assert res["violin_density"].count() >= len(quart)
    out = corpus["root"] / "out_disc"
    for c in ("genre", "mood", "instrument"):
        assert store.read_csv(spark, str(out / f"discrimination_{c}_csv")).count() == d.filter(F.col("category") == c).count()
    assert store.read_csv(spark, str(out / "discrimination_summary_csv")).count() == 3
    assert res["tonal"].filter("x IS NULL").count() == 0


def test_csv_round_trip_and_wide_pack(spark, tmp_path):
    df = spark.createDataFrame([("t1", "p1", "rock", "", [1.0, 2.0])],
                               "track_id string, path string, genre string, mood string, features array<double>")
    wide = store.widen(df, ["a", "b"])
    store.write_csv(wide, str(tmp_path / "w"))
    back = store.read_csv(spark, str(tmp_path / "w"))
    row = back.collect()[0]
    assert row["mood"] is None and row["a"] == "1.0"      # "" reads back as null (S7)
    packed, names = pack_wide(back)
    assert names == ["a", "b"] and packed.collect()[0]["features"] == [1.0, 2.0]
    built = store.materialize(spark, str(tmp_path / "m"), lambda: df)
    assert store.table_exists(spark, str(tmp_path / "m")) and built.count() == 1


def test_rvq_ids_persist_and_reload(spark, tmp_path):
    rng = np.random.default_rng(13)
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(i % 3, 0.1, 4)]) for i in range(60)],
                               "id long, features array<double>")
    ids, occ, _ = P.rvq_semantic_ids(df, str(tmp_path), "km", n_levels=2, n_clusters=3, max_iter=10, n_init=2)
    again = P.load_rvq_ids(df, str(tmp_path), "km")
    a = {r["id"]: r["semantic_id"] for r in ids.collect()}
    b = {r["id"]: r["semantic_id"] for r in again.collect()}
    assert a == b and occ.collect()[0]["unique_ids"] >= 3
    with pytest.raises(FileNotFoundError):
        P.load_rvq_ids(df, str(tmp_path), "missing")
    dids, docc, _ = P.dictionary_semantic_ids(df, str(tmp_path), "dl", n_nonzero=2, n_atoms=4, max_iter=2,
                                              batch_size=None, id_col="id")
    dagain = P.load_dictionary_ids(df, str(tmp_path), "dl")
    assert {r["id"]: r["semantic_id"] for r in dids.collect()} == {r["id"]: r["semantic_id"] for r in dagain.collect()}


@pytest.mark.parametrize("method", ["rvq", "dictionary"])
def test_run_semantic_ids(spark, tmp_path, method):
    rng = np.random.default_rng(20)
    lab = rng.integers(0, 3, size=120)
    df = spark.createDataFrame([(f"t{i}", [float(v) for v in rng.normal(lab[i] * 3, 0.5, 4)], ["a", "b", "c"][lab[i]])
                                for i in range(120)], "track_id string, features array<double>, genre string")
    grid = ({"n_levels_list": [2], "n_clusters_list": [3, 4], "n_init_values": [1], "max_iter": 5} if method == "rvq"
            else {"n_nonzero_list": [1, 2], "n_atoms_list": [4], "batch_sizes": [None], "max_iter": 2})
    res = P.run_semantic_ids(spark, df, str(tmp_path), method, tag_cols=["genre"], k=5, search=grid)
    assert res["search"].count() == 2 and res["ids"].count() == 120
    q = res["quality"].collect()[0]
    assert 0 <= q["cluster_micro"] <= 1 and q["neighbor_micro"] > 0.9


def test_stored_stage_follows_its_parameters(spark, tmp_path):
    from tokenloom.sources import store
    path = str(tmp_path / "t")
    calls = []

    def build(n):
        def run():
            calls.append(n)
            return spark.range(n)
        return run
    assert store.materialize(spark, path, build(3), made={"n": 3}).count() == 3
    assert store.materialize(spark, path, build(3), made={"n": 3}).count() == 3
    assert store.materialize(spark, path, build(5), made={"n": 5}).count() == 5
    assert calls == [3, 5] and store.is_current(spark, path, {"n": 5}) and not store.is_current(spark, path, {"n": 3})


def test_splits_written_and_read(spark, tmp_path):
    from tokenloom.sources import store
    rows = [(i, "a, \"b\"" if i % 2 else "c", ["train", "val", "test"][i % 3]) for i in range(9)]
    df = spark.createDataFrame(rows, "i long, text string, split string")
    store.write_splits(df, str(tmp_path / "s"))
    assert sorted(map(tuple, store.read_splits(spark, str(tmp_path / "s"), "i long, text string").collect())) == rows


def plant(root, rng):
    """A document without features, a malformed one, one with NaN text and missing leaves, a long line and a line without key."""
    docs = root / "docs2"
    header = "TRACK_ID\tARTIST_ID\tALBUM_ID\tPATH\tDURATION\tTAGS"
    texts = {f"00/{i}.json": json.dumps(make_doc(rng, i % 4)) for i in range(40)}
    texts["00/40.json"] = json.dumps({"metadata": {"x": 1}})
    texts["00/41.json"] = "{not json"
    part = make_doc(rng, 1)
    del part["lowlevel"]["mfcc"], part["rhythm"]["bpm"]
    texts["00/42.json"] = json.dumps(part)
    for name, text in texts.items():
        (docs / name).parent.mkdir(parents=True, exist_ok=True)
        (docs / name).write_text(text)
    paths = {}
    for c, tag in (("genre", "genre---rock"), ("mood", "mood/theme---sad"), ("instrument", "instrument---piano")):
        lines = [f"track_{i}\ta\tb\t00/{i}.mp3\t1.0\t{tag}" for i in range(45 if c != "mood" else 20)]
        lines += [f"track_99\ta\tb\t00/99.mp3\t1.0\t{tag}\t{tag}", "track_98"]
        p = root / f"{c}2.tsv"
        p.write_text("\n".join([header, *lines]) + "\n")
        paths[c] = str(p)
    jsonl = root / "docs2.jsonl"
    jsonl.write_text("\n".join("{broken" if t == "{not json" else json.dumps({"path": n, "doc": json.loads(t)}) for n, t in texts.items()) + "\n")
    return paths, str(docs), str(jsonl)


def test_counts_taken_by_the_writing_job(spark, tmp_path):
    paths, docs, jsonl = plant(tmp_path, np.random.default_rng(13))
    cats = ["genre", "mood", "instrument"]
    fs = preset("full_run")
    made = {"a": 1}

    def stage(out, root, fmt):
        return P._feature_stage(spark, str(tmp_path / out), paths, cats, 2, root, fs, made, False, fmt, None)
    for fmt, root, n_docs, n_bad in (("files", docs, 43, 1), ("jsonl", jsonl, 42, 0)):
        feats, observed = stage(f"features_{fmt}", root, fmt)
        got = {(r.stage, r.metric): r.value for r in observed.collect()}
        for c in cats:
            assert got[f"lines_{c}", "n_rows"] == (47 if c != "mood" else 22)
            assert (got[f"lines_{c}", "n_long"], got[f"lines_{c}", "n_short"], got[f"lines_{c}", "n_null_key"]) == (1, 1, 1)
        assert (got["merged", "n_rows"], got["merged", "n_kept"], got["merged", "n_mood"], got["merged", "kept_mood"]) == (45, 45, 20, 20)
        assert got["wanted", "n_rows"] == 45 and got["found", "n_rows"] == n_docs
        assert (got["documents", "n_rows"], got["documents", "n_malformed"]) == (n_docs, n_bad)
        assert got["found", "n_empty"] == 1 + n_bad and feats.count() == 41
        missing = feats.select(F.sum(F.size(F.filter("features", lambda v: v.isNull() | F.isnan(v))))).first()[0]
        assert got["found", "n_filled"] == missing > 0
        cover = P.observed_reports(observed, cats)
        row = cover["document_coverage"].first()
        assert (row.n_rows, row.n_found) == (45, n_docs) and row.coverage_pct == pytest.approx(100 * n_docs / 45)
        assert {r.category: r.n_tagged for r in cover["tag_coverage"].collect()} == {"genre": 45, "mood": 20, "instrument": 45}
        kept = cover["retention"].first()
        assert (kept.n_total, kept.n_kept, kept.pct_kept, kept.mood_tagged) == (45, 45, 100.0, 20)
        wide = store.read_csv(spark, str(tmp_path / f"features_{fmt}_csv"))
        assert wide.count() == 41 and set(fs.names) <= set(wide.columns)
        packed, names = pack_wide(wide)  # P16 over the stored CSV
        assert names == fs.names and packed.select(F.size("features")).first()[0] == fs.width
        # a second call reads the stored table and the stored counts
        again, seen = stage(f"features_{fmt}", root, fmt)
        assert {(r.stage, r.metric): r.value for r in seen.collect()} == got and again.count() == 41


def test_counts_need_no_scan_of_their_own(spark, tmp_path):
    paths, docs, _ = plant(tmp_path, np.random.default_rng(14))
    cats, fs, tracker = ["genre", "mood", "instrument"], preset("selected"), spark.sparkContext.statusTracker()
    counts = []
    for name, watch in (("plain", None), ("watched", store.Watch())):
        spark.sparkContext.setJobGroup(f"counts-{name}", name)
        tags = P.load_tags(spark, paths, header=None, watch=watch)
        tags = watch.on(tags, "merged", n=F.count(F.lit(1))) if watch else tags
        P.build_feature_table(spark, tags, docs, fs, watch=watch).write.parquet(str(tmp_path / name))
        counts.append(len(tracker.getJobIdsForGroup(f"counts-{name}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1] and len(watch.rows()) > 10


def test_shredded_documents(spark, tmp_path):
    """Typed leaves give every feature set what the documents give, and are all that is read."""
    _, docs, jsonl = plant(tmp_path, np.random.default_rng(15))
    for fmt, root in (("files", docs), ("jsonl", jsonl)):
        path = str(tmp_path / f"shredded_{fmt}")
        P.store_documents(spark, root, path, fmt)
        parsed = spark.read.parquet(path)
        tags = parsed.select(F.col("rel_path").alias("track_id"), F.replace("rel_path", F.lit(".json"), F.lit(".mp3")).alias("path"))
        for name in ("base", "full_run", "comprehensive", "selected", "all"):
            fs = preset(name)
            for strategy in ("extract_first", "shuffle"):
                one, two = (P.build_feature_table(spark, tags, r, fs, strategy, f) for r, f in ((root, fmt), (path, "shredded")))
                assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
        fs = preset("selected")
        some = spark.createDataFrame([("a", "00/1.mp3")], "track_id string, path string")
        scans = P.build_feature_table(spark, some, path, fs, doc_format="shredded")._jdf.queryExecution().sparkPlan().collectLeaves()
        read = [{x.split("#")[0] for x in scans.apply(i).output().mkString(",").split(",")} for i in range(scans.size())]
        assert any(own == {"rel_path", *fs.leaves()} for own in read), read  # its own leaves, not the document
        assert len(fs.leaves()) < 60 < len(parsed.columns)
    assert P.parsed_documents(spark, path, "shredded").count() == 42
    from tokenloom.sources.documents import document_names
    names = document_names(spark, path, "shredded")
    assert "ReadSchema: struct<rel_path:string>" in names._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        P.parsed_documents(spark, path, "xml")
