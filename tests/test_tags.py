import pytest

from tokenloom.functions.tags import grab_tag
from tokenloom.operators import tags as TG
from tokenloom.sources.tags import read_tag_tsv

HEADER = "TRACK_ID\tPATH\tARTIST_ID\tTAGS"


def write(tmp_path, name, lines):
    p = tmp_path / name
    p.write_text("\n".join(lines) + "\n")
    return str(p)


def test_grab_tag_cases(spark):
    rows = [("genre---rock",), ("genre---rock genre---pop",), ("instrument---piano",),
            ("genre---hip---hop",), (None,), ("  genre---jazz  mood/theme---sad",), ("",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(grab_tag("t", "genre---")).collect()]
    assert got == ["rock", "rock", "", "hip---hop", "", "jazz", ""]


def test_tsv_rules(spark, tmp_path):
    path = write(tmp_path, "genre.tsv", [
        HEADER,
        "t1\ta/1.mp3\tar1\tgenre---rock\tgenre---pop",   # long row first: skipped, no shift
        "t2\ta/2.mp3\tar2\tgenre---jazz",
        "t3\ta/3.mp3\tar3",                                # short row: kept, tag ""
        "t4\ta/4.mp3\tar4\tinstrument---piano",            # other prefix only
        "t5\ta/5.mp3\tar5\tgenre---electronic---house",    # tag containing ---
        "\ta/6.mp3\tar6\tgenre---folk",                   # empty key is kept as ''
    ])
    df = read_tag_tsv(spark, path, "genre")
    got = {r["track_id"]: (r["path"], r["genre"]) for r in df.collect()}
    assert "t1" not in got
    assert got["t2"] == ("a/2.mp3", "jazz")
    assert got["t3"] == ("a/3.mp3", "")
    assert got["t4"] == ("a/4.mp3", "")
    assert got["t5"] == ("a/5.mp3", "electronic---house")
    keep = {r["track_id"]: r["genre"] for r in read_tag_tsv(spark, path, "genre", multi_tag="keep").collect()}
    assert keep["t1"] == "rock"


def test_null_key_dropped(spark, tmp_path):
    path = write(tmp_path, "mood.tsv", [HEADER, "t1\ta/1.mp3\tx\tmood/theme---happy", "t2"])
    got = read_tag_tsv(spark, path, "mood").collect()
    assert [(r["track_id"], r["mood"]) for r in got] == [("t1", "happy")]


def test_outer_merge_and_profiles(spark, tmp_path):
    g = read_tag_tsv(spark, write(tmp_path, "g.tsv", [HEADER, "t1\tp1\tx\tgenre---rock",
                                                      "t2\tp2\tx\tgenre---pop"]), "genre")
    m = read_tag_tsv(spark, write(tmp_path, "m.tsv", [HEADER, "t1\tp1\tx\tmood/theme---sad",
                                                      "t3\tp3\tx\tmood/theme---calm"]), "mood")
    i = read_tag_tsv(spark, write(tmp_path, "i.tsv", [HEADER, "t1\tp1\tx\tinstrument---piano"]),
                     "instrument")
    merged = TG.merge_outer({"genre": g, "mood": m, "instrument": i})
    got = {r["track_id"]: (r["genre"], r["mood"], r["instrument"]) for r in merged.collect()}
    assert got == {"t1": ("rock", "sad", "piano"), "t2": ("pop", "", ""), "t3": ("", "calm", "")}
    assert TG.filter_min_tags(merged, 2).count() == 1
    assert TG.filter_min_tags(merged, 1).count() == 3
    assert TG.filter_any_tag(merged).count() == 3
    cc = {r["n_categories"]: r["n_rows"] for r in TG.category_counts(merged).collect()}
    assert cc == {3: 1, 1: 2}
    cov = {r["category"]: (r["n_rows"], r["n_tagged"], r["pct"]) for r in TG.tag_coverage(merged).collect()}
    assert cov["mood"] == (3, 2, pytest.approx(66.666667))
    inner = TG.merge_inner(g, m)
    assert [r["track_id"] for r in inner.collect()] == ["t1"]


def test_one_to_one_check(spark):
    a = spark.createDataFrame([("t1", "p1", 1.0), ("t1", "p1", 2.0)], "track_id string, path string, x double")
    b = spark.createDataFrame([("t1", "p1", "rock")], "track_id string, path string, genre string")
    with pytest.raises(TG.DuplicateKeyError):
        TG.join_one_to_one(a, b)
    ok = TG.join_one_to_one(a.limit(1), b)
    assert ok.count() == 1


def test_top_tags_and_single(spark):
    rows = [(1, "sad---happy"), (2, "happy"), (3, "happy---calm"), (4, "calm"), (5, "sad"),
            (6, "angry"), (7, "happy---happy"), (8, "")]
    df = spark.createDataFrame(rows, "track_id int, mood string")
    top = TG.top_tags(df, "mood", 2, always_include="angry").collect()
    assert [(r["tag"], r["n"], r["rank"]) for r in top] == [("happy", 5, 1), ("calm", 2, 2), ("angry", 1, 3)]
    names = [r["tag"] for r in top]
    single = {r["track_id"]: r["mood_single"] for r in TG.single_top_tag(df, "mood", names).collect()}
    # 3 holds two top labels, 7 repeats one label: both dropped
    assert single == {1: "happy", 2: "happy", 4: "calm", 6: "angry"}


def test_check_tag_distribution_and_attach(spark):
    df = spark.createDataFrame([("t1", "p1", "rock", "sad", ""), ("t2", "p2", "rock", "", "piano"),
                                ("t3", "p3", "pop", "sad", "piano")],
                               "track_id string, path string, genre string, mood string, instrument string")
    out = TG.check_tag_distribution(df, 1)
    assert {r["n_categories"]: r["n_rows"] for r in out["category_counts"].collect()} == {2: 2, 3: 1}
    assert {(r["category"], r["tag"]) for r in out["top_tags"].collect()} == {
        ("genre", "rock"), ("mood", "sad"), ("instrument", "piano")}
    with pytest.raises(TG.DuplicateKeyError):
        TG.check_tag_distribution(df.unionByName(df.limit(1)))
    ids = spark.createDataFrame([("t1", "<001>"), ("t3", "<002>")], "track_id string, semantic_id string")
    got = {r["track_id"]: r["semantic_id"] for r in TG.attach_ids(df, ids).collect()}
    assert got == {"t1": "<001>", "t2": None, "t3": "<002>"}


def test_scan_report(spark, tmp_path):
    from tokenloom.sources.tags import scan_report
    path = write(tmp_path, "r.tsv", [HEADER, "t1\ta/1.mp3\tx\tgenre---rock\tgenre---pop", "t2\ta/2.mp3\tx\tgenre---a",
                                     "t3\ta/3.mp3\tx", "t4"])
    r = scan_report(spark, path).collect()[0]
    assert (r["n_rows"], r["n_long"], r["n_short"], r["n_null_key"], r["n_kept"]) == (4, 1, 2, 1, 2)
    assert read_tag_tsv(spark, path, "genre").count() == r["n_kept"]


def test_outer_merge_keeps_repeated_keys(spark):
    """A key that a table repeats keeps every combination; the one-to-one check then raises."""
    g = spark.createDataFrame([("t1", "p1", "rock"), ("t1", "p1", "jazz"), ("t2", "p2", None)], "track_id string, path string, genre string")
    i = spark.createDataFrame([("t1", "p1", "piano"), ("t3", "p3", "harp")], "track_id string, path string, instrument string")
    out = TG.merge_outer({"genre": g, "instrument": i})
    assert sorted(map(tuple, out.collect())) == [("t1", "p1", "jazz", "piano"), ("t1", "p1", "rock", "piano"),
                                                 ("t2", "p2", "", ""), ("t3", "p3", "", "harp")]
    with pytest.raises(TG.DuplicateKeyError):
        TG.assert_unique(out, ["path"])
