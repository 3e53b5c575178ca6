"""Language mixtures: batched EM against one text at a time, held-out accuracy, mixed and awkward texts."""
import math
import random

import numpy as np

from tokenloom.llm import languages as L


def plain(ll, times, penalty, least=0.02, rounds=25):
    """One text, by the definition: EM in plain Python, then smaller sets as long as the penalised likelihood doesn't fall."""
    k = len(ll[0])

    def em(share):
        for _ in range(rounds):
            new = [0.0] * k
            for row, t in zip(ll, times):
                joint = [s * math.exp(x - max(row)) for s, x in zip(share, row)]
                for j in range(k):
                    new[j] += t * joint[j] / sum(joint) / sum(times)
            moved, share = max(abs(a - b) for a, b in zip(new, share)), new
            if moved < 1e-4:
                break
        return share, sum(t * (math.log(sum(s * math.exp(x - max(row)) for s, x in zip(share, row))) + max(row)) for row, t in zip(ll, times))

    def without(share, gone):
        share = [0.0 if j in gone else s for j, s in enumerate(share)]
        return [s / sum(share) for s in share]
    share, _ = em([1 / k] * k)
    share, like = em(without(share, {j for j in range(k) if share[j] < min(least, max(share))}))
    while sum(s > 0 for s in share) > 1:
        smallest = min(s for s in share if s > 0)
        tried, now = em(without(share, {max(j for j in range(k) if share[j] == smallest)}))
        if now + penalty * 0.5 * math.log1p(sum(times)) < like:
            break
        share, like = tried, now
    return share


def test_batched_em_equals_single_texts():
    rng = np.random.default_rng(3)
    sizes = [1, 5, 40, 3, 12]
    ll = rng.normal(-8, 3, (sum(sizes), 4))
    ll[6:40, 1] += 4
    times = rng.integers(1, 5, sum(sizes))
    text = np.repeat(np.arange(len(sizes)), sizes)
    got = L.mixtures(ll, text, times, len(sizes), 1.0)
    for t in range(len(sizes)):
        one = L.mixtures(ll[text == t], np.zeros(sizes[t], dtype=int), times[text == t], 1, 1.0)[0]
        want = plain(ll[text == t].tolist(), times[text == t].tolist(), 1.0)
        # EM stops when no text of the batch moves, so a text may take further steps in a batch
        assert np.abs(one - want).max() < 1e-9 and np.abs(got[t] - one).max() < 0.02 and ((got[t] > 0) == (one > 0)).all()


def corpus(n, seed):
    rng = random.Random(seed)
    parts = {"en": "the ing tion and er th wh ea sh".split(), "de": "sch ung der ein ch keit ä ß ver".split(), "cs": "ř ě ov ní pro ž ský po st".split()}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4)))
    text = lambda lang, k: " ".join(word(lang) for _ in range(k))
    rows = [(i, text(lang, rng.randint(3, 80)), lang) for i, lang in enumerate(rng.choices(["en", "de", "cs"], [8, 3, 1], k=n))]
    return rows, text


def test_held_out_accuracy_and_mixtures(spark):
    rows, text = corpus(600, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learn(docs)
    assert model.languages == ["cs", "de", "en"]
    got = L.identify(docs, model).collect()
    lang = {r[0]: r[2] for r in rows}
    tested = [r for r in got if r.held_out]
    assert len(tested) > 100 and sum(r.lang_pred == lang[r.doc_id] for r in tested) >= 0.99 * len(tested)
    mixed = [(0, text("en", 60) + "\n" + text("de", 30)), (1, text("cs", 50)), (2, text("de", 40) + " " + text("cs", 40) + " " + text("en", 40))]
    out = {r.doc_id: r for r in L.identify(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect()}
    assert out[0].languages == ["en", "de"] and 0.55 < out[0].score < 0.75 and abs(sum(out[0].shares) - 1) < 1e-9
    assert out[1].languages == ["cs"] and out[1].score == 1.0
    assert sorted(out[2].languages) == ["cs", "de", "en"]


def test_a_bounded_sample_of_each_language(spark):
    rows, _ = corpus(900, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learn(docs, rows=30)
    got = L.identify(docs, model).collect()
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in got) >= 0.97 * len(got)
    # rows without an id, without a language or held out teach nothing
    odd = [(None, "x" * 30, "xx"), (7, "y y y", None)] + [(i, t, "zz" if i % 2 else "en") for i, t, _ in rows[:200] if i % 3 == 0]
    known = L.learn(spark.createDataFrame(odd, "doc_id long, text string, lang string")).languages
    assert known == ["en", "zz"]


def test_awkward_rows(spark, awkward, nothing):
    rows, _ = corpus(200, 4)
    model = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    out = L.identify(awkward, model).collect()
    assert len(out) == awkward.count()
    for r in out:
        assert 0 <= r.score <= 1
    unlettered = spark.createDataFrame([(0, None), (1, ""), (2, " 12 -- … 3"), (3, "é"), (4, "日本")], "doc_id int, text string")
    got = {r.doc_id: r for r in L.identify(unlettered, model).collect()}
    assert [got[k].lang_pred for k in range(3)] == ["und"] * 3 and got[0].score == 0.0 and got[2].languages == []
    assert got[3].lang_pred in model.languages and got[4].lang_pred in model.languages
    empty = L.learn(nothing)
    assert empty.languages == [] and L.identify(nothing, empty).count() == 0
    assert {r.lang_pred for r in L.identify(awkward, empty).collect()} == {"und"}
