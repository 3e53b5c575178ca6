import numpy as np
import pytest

from tokenloom.operators import discriminate as D


def test_f_tail_reference_points():
    assert D.f_sf(np.array([4.9646]), np.array([1.0]), np.array([10.0]))[0] == pytest.approx(0.05, abs=2e-5)
    assert D.f_sf(np.array([3.0984]), np.array([3.0]), np.array([20.0]))[0] == pytest.approx(0.05, abs=2e-5)
    assert D.f_sf(np.array([0.0]), np.array([2.0]), np.array([5.0]))[0] == pytest.approx(1.0)
    # F(2, 2) tail has the closed form 1 / (1 + f)
    assert D.f_sf(np.array([3.0]), np.array([2.0]), np.array([2.0]))[0] == pytest.approx(0.25)


def test_anova_against_numpy(spark):
    rng = np.random.default_rng(10)
    rows, groups = [], {}
    for g, mu in enumerate([0.0, 0.5, 2.0]):
        vals = rng.normal(mu, 1.0, size=10 + 5 * g)
        groups[g] = vals
        rows += [("f", str(g), float(v)) for v in vals]
    rows += [("one_group", "a", 1.0), ("one_group", "a", 2.0)]
    rows += [("flat", "a", 1.0), ("flat", "b", 1.0)]
    df = spark.createDataFrame(rows, "feature string, label string, value double")
    res = {r["feature"]: r for r in D.with_pvalues(D.anova(df, ["feature"])).collect()}
    assert "one_group" not in res                       # fewer than two groups: skipped
    allv = np.concatenate(list(groups.values()))
    ssb = sum(len(v) * (v.mean() - allv.mean()) ** 2 for v in groups.values())
    ssw = sum(((v - v.mean()) ** 2).sum() for v in groups.values())
    f = (ssb / 2) / (ssw / (len(allv) - 3))
    assert res["f"]["f_statistic"] == pytest.approx(f)
    assert res["f"]["eta_squared"] == pytest.approx(ssb / (ssb + ssw))
    assert res["flat"]["eta_squared"] == 0.0 and res["flat"]["f_statistic"] is None
    assert res["f"]["rank"] == 1 and res["f"]["significant"] == (res["f"]["p_value"] < 0.05)


def test_fill_missing(spark):
    df = spark.createDataFrame([([1.0, None, float("nan")],)], "features array<double>")
    filled, n = D.fill_missing(df)
    assert filled.collect()[0][0] == [1.0, 0.0, 0.0] and n.collect()[0][0] == 2


def test_discrimination_end_to_end(spark):
    rng = np.random.default_rng(11)
    n = 60
    lab = rng.integers(0, 3, size=n)
    feats = [(i, [float(lab[i] + rng.normal(0, 0.1)), float(rng.normal())]) for i in range(n)]
    f = spark.createDataFrame(feats, "track_id long, features array<double>")
    tags = spark.createDataFrame([(i, ["rock", "pop", "jazz"][lab[i]], "x---y" if i % 2 else "x") for i in range(n)],
                                 "track_id long, genre string, mood string")
    res = D.discrimination(f, tags, ["sep", "noise"], ["genre", "mood"], top_n=3, min_rows=10)
    got = {(r["category"], r["feature"]): r for r in res.collect()}
    assert got[("genre", "sep")]["rank"] == 1 and got[("genre", "sep")]["significant"]
    summ = {r["category"]: r for r in D.discrimination_summary(res).collect()}
    assert summ["genre"]["n_features"] == 2
    pairs = D.feature_pairs(res, ["category"], 2).filter("category = 'genre'").collect()
    assert (pairs[0]["feature_x"], pairs[0]["feature_y"]) == ("sep", "noise")


def test_plot_inputs(spark):
    names = ["spec_contrast_mean_0", "spec_valley_mean_0", "spec_contrast_mean_1", "key_vector_x",
             "key_vector_y", "key_vector_z"]
    assert D.contrast_valley_pairs(names) == [("spec_contrast_mean_0", "spec_valley_mean_0")]
    f = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 0.1, 0.2, 0.3]), (2, [4.0, 5.0, 6.0, 0.4, 0.5, 0.6])],
                              "track_id int, features array<double>")
    lab = spark.createDataFrame([(1, "rock"), (3, "pop")], "track_id int, label string")
    pv = D.pair_values(f, lab, names, D.contrast_valley_pairs(names)).collect()
    assert [(r["pair"], r["x"], r["y"], r["label"]) for r in pv] == [
        ("spec_contrast_mean_0|spec_valley_mean_0", 1.0, 2.0, "rock")]
    tv = D.tonal_vectors(f, lab, names).collect()
    assert [(r["x"], r["y"], r["z"]) for r in tv] == [(0.1, 0.2, 0.3)]


def test_label_without_values_is_no_group(spark):
    from tokenloom.operators.discriminate import anova
    rows = [("f", "a", 1.0), ("f", "a", 2.0), ("f", "b", 4.0), ("f", "b", 6.0), ("f", "c", None)]
    r = anova(spark.createDataFrame(rows, "feature string, label string, value double"), ["feature"]).first()
    assert (r["n"], r["n_groups"], r["df_between"], r["df_within"]) == (4, 2, 1, 2)
