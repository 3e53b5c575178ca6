"""Document operators against brute force, on awkward rows, and on empty tables."""
import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from tokenloom.llm import bpe, containment, licenses, pii, quality, secrets, setjoin, substrings, toxicity
from tokenloom.llm import hashing as H
from tokenloom.llm.common import components, shared_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---- hashing and components -----------------------------------------------------------

def test_word_hashes_follow_the_words():
    texts = ["a b", "b  a\tb", "", "ab", "A b a"]
    words, counts = H.hashed_words([t.encode() for t in texts], lower=True)
    assert counts.tolist() == [2, 3, 0, 1, 3]
    a, b = words[0], words[1]
    assert a != b and words.tolist() == [a, b, b, a, b, words[5], a, b, a]
    assert len(H.rolling(words, 2)) == 8 and H.rolling(words, 2)[0] == H.rolling(words, 2)[3]
    assert len(H.rolling(words[:1], 2)) == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (10, 11), (7, 7), (20, 19), (19, 18), (18, 17), (17, 16)] + [(100, k) for k in range(101, 160)]
    chain = [(k, k + 1) for k in range(1000, 1060)]
    got = dict(components(spark.createDataFrame(edges + chain, "a long, b long")).collect())
    want = {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, **{k: 16 for k in range(16, 21)}, **{k: 100 for k in range(100, 160)},
            **{k: 1000 for k in range(1000, 1061)}}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- license scan ------------------------------------------------------------------------

def test_licenses(spark, awkward, nothing):
    notice = licenses.NOTICES[2][1]
    changed = notice.replace("binary", "machine readable")
    texts = ["Released under the MIT License.", "cc-by-nc CC BY NC 4.0, cc by\nnc", f"x {notice} y", f"x {changed} y", notice[:40],
             "under the mit", "apache license, version 2.0 " * 3, "under the mıt license"]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k].base_labels for k in range(8)] == ["mit", "cc-by-nc", "", "", "", "", "apache-2", ""]
    assert [got[k].n_base for k in range(8)] == [1, 3, 0, 0, 0, 0, 3, 0]
    assert (got[1].first_word, got[1].last_word, got[1].n_words) == (0, 8, 11)
    assert got[2].labels == "bsd" and got[2].score == 1.0 and got[3].labels == "bsd" and 0.75 <= got[3].score < 1
    assert got[4].labels == "" and got[5].labels == "" and got[5].first_word is None
    assert licenses.scan_licenses(awkward).count() == awkward.count()
    assert licenses.scan_licenses(nothing).count() == 0


def test_licenses_of_any_length(spark):
    """A whole license text of hundreds of words, with words changed, dropped and missing."""
    rng = np.random.default_rng(12)
    own = [f"term{k}" for k in rng.integers(0, 400, 500)]
    notices = [*licenses.NOTICES, ("long", " ".join(own))]
    changed = [f"other{k}" if rng.random() < 0.03 else w for k, w in enumerate(own)]
    texts = [" ".join(["start", *own, "end"]), " ".join(changed), " ".join(own[:250]), " ".join(own[:480]), " ".join(reversed(own))]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), notices=notices).collect()}
    assert [got[k].labels for k in range(5)] == ["long", "long", "", "long", ""]
    grams = lambda words: {(q, " ".join(words[q:q + 3])) for q in range(len(words) - 2)}
    assert got[0].score == 1.0 and got[0].spans[0].start == 1 and got[0].spans[0].end == 501
    assert got[1].score == pytest.approx(len(grams(own) & grams(changed)) / 498, abs=0.02) and got[3].score == pytest.approx(478 / 498, abs=1e-9)
    with pytest.raises(ValueError):
        licenses.template_grams([("x", "word " * 70)], [])


# ---- personal data --------------------------------------------------------------------------

def brute_digits(d, key, kind, reverse=False):
    u, n = len(d) // 2, len(d)
    a, b, ra, rb = int(d[:u]), int(d[u:]), 10 ** u, 10 ** (n - u)
    for i in (reversed(range(8)) if reverse else range(8)):
        x = b if i % 2 == 0 else a
        f = int(hashlib.sha256(f"{key}|{kind}|{ra}|{rb}|{i}|{x}".encode()).hexdigest()[:15], 16)
        if i % 2 == 0:
            a = (a + (-f if reverse else f)) % ra
        else:
            b = (b + (-f if reverse else f)) % rb
    return f"{a:0{u}d}{b:0{n - u}d}"


def luhn(body):
    total = sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(body)))
    return body + str(-total % 10)


def test_pii(spark, awkward, nothing):
    card, phone = "4111111111111111", "+1 (017) 555-7713"
    texts = [f"a {card}, 4111 1111 1111 1111 4111111111111112", f"call {phone}!", "on 1980-02-30 or 1980-02-29", "ip 10.0.0.1 1.2.3.4.5 999.1.1.1",
             "DE89370400440532013000 DE88370400440532013000", "123-45-6789 000-12-3456", "Mail A.b@x.org a.b@X.ORG", "none 12 3.5"]
    out = pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    new = luhn(brute_digits(card[:15], "k", "card"))
    assert out[0].text == f"a {new}, {new[:4]} {new[4:8]} {new[8:12]} {new[12:]} 4111111111111112" and out[0].n_card == 2
    d = brute_digits("0175557713", "k", "phone")
    assert out[1].text == f"call +1 ({d[:3]}) {d[3:6]}-{d[6:]}!"
    assert out[2].text.startswith("on 1980-02-30 or ") and re.fullmatch(r".* \d{4}-\d\d-\d\d", out[2].text) and out[2].n_date == 1
    assert "10.0.0.1" not in out[3].text and out[3].text.endswith(" 1.2.3.4.5 999.1.1.1") and out[3].n_ip == 1
    assert out[4].n_iban == 1 and out[4].text.endswith("DE88370400440532013000")
    assert out[5].n_ssn == 1 and out[5].text.endswith("000-12-3456")
    mails = re.findall(r"user\w+@example.invalid", out[6].text)
    assert len(mails) == 2 and len(set(mails)) == 1
    assert out[7].text == texts[7] and out[7].n_private == 0
    frame = spark.createDataFrame([(r.doc_id, r.text) for r in out], "doc_id long, text string")
    back = [r.text for r in pii.pseudonymize(frame, "k", reverse=True).orderBy("doc_id").collect()]
    assert back[:6] == texts[:6]
    again = pii.pseudonymize(awkward, "k")
    assert set(awkward.columns) <= set(again.columns)
    assert Counter(r.text for r in again.collect()) == Counter(r.text for r in awkward.collect())
    assert pii.pseudonymize(nothing, "k").count() == 0


@pytest.mark.parametrize("form", ["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y"])
def test_every_day_of_a_century_comes_back(spark, form):
    import datetime
    days = [datetime.date(1950, 1, 1) + datetime.timedelta(k) for k in range(36_525)]
    if form == "%d/%m/%Y":
        days = [d for d in days if d.day > 12]  # others read month first
    texts = [d.strftime(form) for d in days]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    out = pii.pseudonymize(frame, "key")
    new = dict(out.select("doc_id", "text").collect())
    assert len(set(new.values())) == len(days) and sum(new[k] == t for k, t in enumerate(texts)) < 10
    assert out.where("n_date <> 1").count() == 0
    assert dict(pii.pseudonymize(out.select("doc_id", "text"), "key", reverse=True).select("doc_id", "text").collect()) == dict(enumerate(texts))


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def test_ibans_phones_and_cards_of_all_forms(spark):
    ibans = ["GB82WEST12345698765432", "NL91ABNA0417164300", "FR1420041010050500013M02606", "IT60X0542811101000000123456", "ES9121000418450200051332",
             "PL61109010140000071219812874", "HU42117730161111101800000000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]
    other = ["(017) 555-7713", "017-555-7713", "017.555.7713", "+49 170 555 7713", "3782 822463 10005", "378282246310005"]
    left = ["GB83WEST12345698765432", "0175557713", "1-017-555-7713", "017-5557713", "10.017.555.7713", "3782 822463 10006"]
    texts = [*ibans, *other, *left]
    frame = spark.createDataFrame([(k, f"a {t}, b") for k, t in enumerate(texts)], "doc_id long, text string")
    out = pii.pseudonymize(frame, "key").orderBy("doc_id").collect()
    for r, t in zip(out, texts):
        shape = re.sub("[A-Z]", "A", re.sub("[0-9]", "0", f"a {t}, b"))
        assert re.sub("[A-Z]", "A", re.sub("[0-9]", "0", r.text)) == shape
        assert (r.text == f"a {t}, b") == (t in left), t
    for r, t in zip(out, ibans):
        assert r.n_iban == 1 and r.text[2:4] == t[:2] and mod97(r.text[2:-3].replace(" ", "")) == 1
    assert out[0].text[2:-3] == out[8].text[2:-3].replace(" ", "")  # one account, written in two ways
    assert out[5].text[-9:-3] != "812874"
    assert [r.n_phone for r in out[9:13]] == [1] * 4 and [r.n_card for r in out[13:15]] == [1, 1]
    again = spark.createDataFrame([(r.doc_id, r.text) for r in out], "doc_id long, text string")
    assert [r.text for r in pii.pseudonymize(again, "key", reverse=True).orderBy("doc_id").collect()] == [f"a {t}, b" for t in texts]


def test_key_and_columns_of_any_name(spark):
    frame = spark.createDataFrame([(1, "4111111111111111", "x", "y", 7)], "doc_id long, text string, found string, secret string, n_card int")
    out = pii.pseudonymize(frame, "sesame-open")
    assert "sesame" not in out._jdf.queryExecution().toString()
    row = out.first()
    assert (row.found, row.secret, row.n_card) == ("x", "y", 1) and row.text != "4111111111111111"


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F
    d = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    out = [r[0] for r in d.select(pii.permuted_digits(F.col("d"), "k", "x", False)).collect()]
    assert len(set(out)) == 1000 and all(len(x) == 3 for x in out) and sum(x == y.d for x, y in zip(out, d.collect())) < 20


# ---- benchmark decontamination ------------------------------------------------------------------

def shingle_texts(t, width=5):
    w = WORD.findall((t or "").translate(LOW))
    return {" ".join(w[i:i + width]) for i in range(len(w) - width + 1)}


def test_containment(spark, awkward, nothing):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(k, text(int(n))) for k, n in enumerate([5, 7, 12, 20, 40, 90, 200, 3, 0])] + [(None, text(9)), (99, None)]
    docs = []
    for k in range(60):
        t = text(int(rng.integers(50, 3000))).split()
        item = items[k % 9][1].split()
        if k % 4 == 0 and len(item) > 20:
            item[len(item) // 2] = "changed"
        at = int(rng.integers(0, len(t)))
        docs.append((k, " ".join([*t[:at], *item, *t[at:]]).upper()))
    docs += [(100, None), (101, ""), (None, items[4][1]), (0, items[5][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for doc, t in docs:
        for item, u in items:
            if doc is not None and item is not None and (s := shingle_texts(u)):
                both = len(s & shingle_texts(t))
                if 100 * both >= 80 * len(s):
                    want[doc, item] = max(want.get((doc, item), 0), both)
    got = {(r.doc_id, r.item_id): r.n_shared for r in containment.contained_items(d, i).collect()}
    assert got == want and len(want) > 30
    assert {(r.doc_id, r.item_id) for r in containment.contained_items(d, i, broadcast_rows=0).collect()} == set(want)
    assert containment.contained_items(awkward, i).count() == 0
    assert containment.contained_items(nothing, i).count() == 0
    assert containment.contained_items(d, i.limit(0)).count() == 0


# ---- quality and toxicity --------------------------------------------------------------------------

def test_quality(spark, awkward, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.rank_quality(docs, labels)
    assert scored.count() == docs.count() and scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    judged = scored.join(labels, "doc_id").where("held_out")
    assert judged.where("predicted = quality").count() / judged.count() > 0.95
    model = quality.train(docs, labels)
    assert quality.score(awkward, model).count() == awkward.count()
    assert quality.score(nothing, model).count() == 0
    assert {r.score for r in quality.rank_quality(awkward, labels.limit(0)).collect()} == {0.5}
    assert np.allclose(quality.train(docs.repartition(5), labels)[0], model[0])


def test_quality_against_plain_scoring(spark):
    """The whole table's scores from the trained weights, feature by feature, and the weights as the loss's minimum."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    w, mean, dev, cut = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, (w, mean, dev, cut)).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for i, t in texts.items():
        z = np.clip((np.array(quality.features(t)) - mean) / dev, -8, 8)
        want = 1 / (1 + np.exp(-(z @ w - cut + np.log(0.3 / 0.7))))
        assert got[i].score == pytest.approx(want, abs=1e-9) and got[i].predicted == (want >= 0.3)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    rows = [(texts[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 5]
    z = np.clip((np.array([quality.features(t) for t, _ in rows]) - mean) / dev, -8, 8)
    good, bad = z[[q == 1 for _, q in rows]], z[[q == 0 for _, q in rows]]

    def loss(v):  # over all pairs; the fit draws some of them
        return np.logaddexp(0, -((good @ v)[:, None] - (bad @ v)[None, :])).mean() + 0.5e-3 * v @ v
    rng = np.random.default_rng(1)
    assert all(loss(w) < loss(w + 0.3 * d / np.linalg.norm(d)) for d in rng.standard_normal((50, len(w))))
    assert np.mean((z @ w < cut) == [q == 0 for _, q in rows]) > 0.97


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    """Means, deviations and the cut are those of all labelled rows, in one block or in several; so are the weights, about."""
    rng = np.random.default_rng(6)
    words = np.array(["some", "plain", "WORDS!", "12", "$$", "line\n", "other"])
    rows = [(i, " ".join(rng.choice(words, rng.integers(3, 40), p=(a := rng.dirichlet(np.ones(7))))), int(a[2] + a[4] < 0.3)) for i in range(900)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(3), spark.createDataFrame(
        [(i, q) for i, _, q in rows], "doc_id long, quality int")
    x, y = (np.array(v) for v in zip(*[(quality.features(t), q) for i, t, q in rows if zlib.crc32(str(i).encode()) % 5]))
    whole = quality.train(docs.drop("quality"), labels)
    monkeypatch.setattr(quality, "BLOCK_ROWS", 200)
    monkeypatch.setattr(quality, "LEAST_RARE", 150)
    parts = quality.train(docs.drop("quality"), labels)
    for w, mean, dev, cut in (whole, parts):
        assert np.allclose(mean, x.mean(axis=0)) and np.allclose(dev, np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1))
        z = np.clip((x - mean) / dev, -8, 8)
        assert cut == pytest.approx(np.quantile(z @ w, (y == 0).mean()))
    assert np.corrcoef(whole[0], parts[0])[0, 1] > 0.98
    z = np.clip((x - whole[1]) / whole[2], -8, 8)  # at the loss's minimum over all pairs its slope is 0
    good, bad = z[y == 1], z[y == 0]
    p = 1 / (1 + np.exp(-((good @ whole[0])[:, None] - (bad @ whole[0])[None, :])))
    slope = (good.T @ (1 - p).sum(axis=1) - bad.T @ (1 - p).sum(axis=0)) / p.size - 1e-3 * whole[0]
    assert np.abs(slope).max() < 1e-6


def test_quality_cut_of_many_values(spark):
    v = np.random.default_rng(7).normal(size=3000).round(2)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    for q in (0.0, 0.31, 0.5, 1.0):
        got, want = quality._order_value(df, q * 2999, most=20), np.quantile(v, q)
        assert abs(got - want) < 0.011  # equal values end the search at the value itself


def test_quality_features_count_every_word():
    """A long text whose period divides a stride, and one whose only signs stand between strides."""
    by_name = dict(zip(quality.FEATURES, quality.features("WORD! plain plain plain " * 20_000)))
    assert [by_name[k] for k in ("sign_words", "upper_words", "tail_signs")] == [0.25, 0.25, 0.25]
    by_name = dict(zip(quality.FEATURES, quality.features("plain " * 7_001 + "a#b " + "plain " * 998)))
    assert by_name["sign_words"] == 1 / 8_000


@pytest.mark.parametrize("seed", range(20))
def test_lexicon_hits_against_every_position(seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("ab"), rng.integers(1, 4)))
    terms = {f" {word()}{' ' if rng.random() < 0.5 else ''}": float(rng.integers(1, 9)) for _ in range(5)}
    phrases = {f" {word()} {word()} " for _ in range(3)} | {f" {word()} "}
    lexicon = toxicity.Lexicon(terms, tuple(phrases - terms.keys()))
    text = toxicity.fold(" ".join(word() for _ in range(60)))
    free = [(k, k + len(p)) for p in lexicon.exceptions for k in range(len(text)) if text.startswith(p, k)]
    want = [(k, k + len(t), w, t) for t, w in terms.items() for k in range(len(text)) if text.startswith(t, k)
            and not any(s <= k and k + len(t) <= e for s, e in free)]
    assert sorted(lexicon.hits(text)) == sorted(want)
    best = {k: max(w for j, _, w, _ in want if j == k) for k, *_ in want}
    assert toxicity.measures(lexicon, text) == (pytest.approx(np.log1p(sum(best.values()))), pytest.approx(np.log1p(60)))


def test_toxicity(spark, awkward, nothing):
    lexicon = toxicity.Lexicon({" idiot ": 5.0, " moro": 4.0}, (" no idiot ",))
    assert toxicity.fold("1d10t! MОRОN​$$$ 3.5") == " 1diot moron 3 5 "
    assert [t for *_, t in lexicon.hits(toxicity.fold("an id1ot, moronic idiots"))] == [" idiot ", " moro"]
    assert lexicon.hits(toxicity.fold("no idiot here")) == []
    many = toxicity.fold("no idiot idiot " * 30_000)  # each hit looks at one span
    began = time.time()
    assert len(lexicon.hits(many)) == 30_000 and time.time() - began < 5
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    learned = toxicity.learn(docs, labels)
    scored = toxicity.score(docs, learned)
    assert scored.count() == docs.count() and scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    judged = scored.join(labels, "doc_id").where("held_out")
    clean = judged.where("toxic = 0")
    assert clean.where("predicted = 1").count() <= 0.01 * clean.count()
    assert judged.where("toxic = 1 AND predicted = 1").count() >= 0.85 * judged.where("toxic = 1").count()
    assert toxicity.score(awkward, learned).count() == awkward.count()
    assert toxicity.score(nothing, learned).count() == 0
    none = toxicity.learn(docs, labels.limit(0))
    assert none.terms == {} and toxicity.score(awkward, none).count() == awkward.count()
    assert toxicity.score_rows(awkward, learned).columns.count("score") == 1


# ---- near duplicates ------------------------------------------------------------------------------

def brute_groups(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    low = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if (low[a], low[b]) != (m, m):
                low[a] = low[b] = m
                changed = True
    return {i: (len(s), low[i]) for i, s in sets.items()}


def near_copies(n, seed):
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 5000, 120)]
    out = []
    for k in range(n):
        own = list(base)
        for at in rng.integers(0, len(own), rng.integers(0, 5)):
            own[at] = f"x{rng.integers(0, 10**6)}"
        out.append((k * 3 + 1, " ".join(own)))
    return out


@pytest.mark.parametrize("levels", [21, 2])
def test_near_duplicates(spark, monkeypatch, levels):
    """Small nodes, deep trees, and the exact way for nodes that stay too large."""
    monkeypatch.setattr(setjoin, "LEVELS", levels)
    rows = near_copies(60, 1) + [(1000 + k, t) for k, (_, t) in enumerate(near_copies(20, 2))]
    rows += [(2000, None), (2001, ""), (2002, "short one"), (2003, "SHORT one"), (2004, "other")]
    got = setjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), leaf=8).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_in_a_templated_family(spark):
    """Pages of one template, unlinked at about 0.79, with planted pairs just above the threshold: a family far larger than a node."""
    fresh = iter(range(10**6))
    words = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    template, rows = words(156), []
    for k in range(200):
        page = words(20) + template
        rows += [(2 * k, " ".join(page)), (2 * k + 1, " ".join(words(13) + page[13:]))]
    got = setjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), leaf=20).collect()
    want = brute_groups(rows)
    assert len({low for _, low in want.values()}) == 200
    assert sum((r.n_shingles, r.component_id) == want[r.doc_id] for r in got) >= 399


@pytest.mark.parametrize("others", [10, 80])
def test_linked_pairs_looks_at_every_pair(others):
    """A pair above the threshold whose signatures agree far below it, in small and large groups."""
    rng = np.random.default_rng(2)
    draw = lambda n: np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
    a = draw(200)
    held = Counter(np.array([setjoin.signature(a[k:k + 1]) for k in range(200)]).argmin(axis=0).tolist())
    gone = [k for k, _ in held.most_common(15)]
    b = np.sort(np.concatenate([np.delete(a, gone), draw(15)]))
    assert (setjoin.signature(a) == setjoin.signature(b)).mean() < 0.85 - 4 * (0.85 * 0.15 / 64) ** 0.5
    sets = [draw(200) for _ in range(others)] + [a, b]
    assert list(setjoin.linked_pairs(sets, 85)) == [(others, others + 1)]


@pytest.mark.parametrize("similarity", [0.3, 0.5, 0.7, 0.8, 0.85, 0.95])
def test_trees_keep_the_recall(similarity):
    trees, depth = setjoin._shape(similarity, 0.999, 4)
    assert trees * depth <= setjoin.COORDS and 1 - (1 - similarity ** depth) ** trees >= 0.999


def test_near_duplicates_awkward(spark, awkward, nothing):
    got = setjoin.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    rows = {r.doc_id: r.text for r in awkward.collect() if r.doc_id is not None}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute_groups(rows.items())
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert setjoin.near_duplicates(nothing).count() == 0


def test_near_duplicates_under_repeated_ids(spark):
    """One id with several texts: each text is joined as its own, and unites nothing."""
    a, b = near_copies(12, 5), near_copies(12, 6)
    for first, second in ((a, b), (b, a)):
        rows = [(7, first[0][1]), (7, second[0][1]), (7, first[0][1])]
        rows += [(10 + k, t) for k, (_, t) in enumerate(first)] + [(40 + k, t) for k, (_, t) in enumerate(second)] + [(3, second[1][1])]
        want = brute_groups(enumerate(t for _, t in rows))
        low = {}
        for k, (i, _) in enumerate(rows):
            low[want[k][1]] = min(i, low.get(want[k][1], i))
        got = setjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), digest=True)
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == Counter(
            (i, want[k][0], low[want[k][1]]) for k, (i, _) in enumerate(rows))
        assert got.select("digest").distinct().count() == len({t for _, t in rows})
    with pytest.raises(ValueError):
        setjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=5)


# ---- secrets ------------------------------------------------------------------------------------------

def test_secrets(spark, awkward, nothing):
    assert secrets.find_secrets('API-KEY password = "abcdefgh" apikey:short') == [(8, 28, "assign")]
    assert secrets.find_secrets("ſecret=abcdefghij AKIA123 AKIA1234567890AB " + "0af" * 11) == [(26, 42, "access"), (43, 76, "hex")]
    kinds = {k for _, _, k in secrets.find_secrets("-----BEGIN RSA PRIVATE KEY----- ghp_" + "aB3" * 12 + " eyJhbGciOi1.eyJzdWIiOi1.c2lnbmF0dXJl")}
    assert {"pem", "prefix", "jwt"} <= kinds
    path = shared_path(spark, "ledger-test")
    first = awkward.where("doc_id < 6")
    secrets.scan_versions(first, path).count()
    before = secrets.ledger(spark, path).count()
    assert before == first.selectExpr("coalesce(text, '')").distinct().count()
    got = secrets.scan_versions(awkward, path)
    assert got.count() == awkward.count()
    assert secrets.ledger(spark, path).count() == awkward.selectExpr("coalesce(text, '')").distinct().count()
    secrets.scan_versions(awkward, path).count()  # nothing new
    assert secrets.ledger(spark, path).count() == awkward.selectExpr("coalesce(text, '')").distinct().count()
    secrets.scan_versions(first, path, rule_version="next").count()
    assert secrets.ledger(spark, path).where("rule_version = 'next'").count() == before
    assert secrets.scan_versions(nothing, shared_path(spark, "ledger-test")).count() == 0
    rows = secrets.digests(secrets.scan_versions(spark.createDataFrame([(1, "é token: abcdefgh1")], "doc_id long, text string"),
                                                 shared_path(spark, "ledger-test"))).collect()
    assert (rows[0].n_assign, rows[0].n_hex, rows[0].base_sha256, rows[0].spans) == (1, 0, sha("assign:2:18"), "assign:2:18")


def brute_secrets(t):
    """The base kinds by their definition, over the whole text."""
    assign = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    own = [(m.start(), 0, m.end(), "assign") for m in re.finditer(assign, t) if len(m.group(2)) >= 8]
    own += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
    own += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 32]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(own)]


def test_secrets_of_the_whole_table_in_two_runs(spark):
    """The ledger filled by a third of the rows first, then by all: the second run scans only what is new."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    path = shared_path(spark, "ledger-test")
    secrets.scan_versions(docs.where("doc_id % 3 = 0"), path).count()
    half = secrets.ledger(spark, path).count()
    got = {r.doc_id: r for r in secrets.digests(secrets.scan_versions(docs, path)).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert secrets.ledger(spark, path).count() == len(set(texts.values())) > half == len({t for i, t in texts.items() if i % 3 == 0})
    assert sum(len(brute_secrets(t)) for t in texts.values()) > 100
    for i, t in texts.items():
        base = brute_secrets(t)
        assert got[i].base_sha256 == sha(",".join(base))
        assert [got[i][f"n_{k}"] for k in secrets.BASE] == [sum(x.startswith(k) for x in base) for k in secrets.BASE]
        assert [x for x in got[i].spans.split(",") if x.split(":")[0] in secrets.BASE] == base


# ---- substring deduplication -------------------------------------------------------------------------------

def brute_substrings(rows, window):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k:k + window]), i)
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("window", [2, 5, 13])
def test_substrings(spark, window):
    rng = np.random.default_rng(window)
    rows = []
    passage = [f"p{k}" for k in range(40)]
    for i in range(80):
        w = [f"w{k}" for k in rng.integers(0, 40, rng.integers(0, 120))]
        if i % 3 == 0:
            at = rng.integers(0, len(w) + 1)
            w[at:at] = passage[rng.integers(0, 20):rng.integers(20, 40)]
        rows.append((int(rng.integers(0, 10**9)), " ".join(w)))
    got = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), window=window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == brute_substrings(rows, window)


def test_substrings_awkward(awkward, nothing):
    got = substrings.dedup_substrings(awkward).collect()
    assert len(got) == awkward.count()
    want = brute_substrings([(r.doc_id, r.text) for r in awkward.dropDuplicates(["doc_id"]).collect() if r.doc_id is not None], 13)
    assert all((r.n_words, r.n_removed, r.kept) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)
    assert substrings.dedup_substrings(nothing).count() == 0


# ---- BPE ----------------------------------------------------------------------------------------------------

def test_bpe(spark, awkward, nothing):
    import random

    from tokenizers import Tokenizer
    text = bpe.read_vocabulary()
    one = Tokenizer.from_str(text)
    rng = random.Random(1)
    parts = ["'s", "'re", "'", "don't", " ", "  ", "\n", "\t", "a", "B", "é", "12", "²", "!", "😀", "́", "\x1c", "\x85", "　", "中", "<|endoftext|>", "࢏"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    ids = {i: one.encode(t, add_special_tokens=False).ids for i, t in rows}
    got = bpe.encode(frame, text).collect()
    assert {r.doc_id: r.ids for r in got} == ids
    assert all(r.n_tokens == len(ids[r.doc_id]) and r.decoded == one.decode(ids[r.doc_id], skip_special_tokens=False) for r in got)
    short = bpe.encode(frame, text, digest=True).collect()
    assert all(r.ids_sha256 == sha(",".join(map(str, ids[r.doc_id]))) and r.decoded_sha256 == sha(dict(rows)[r.doc_id]) for r in short)
    back = bpe.decode(bpe.encode(frame, text), text).collect()
    assert {r.doc_id: r.text for r in back} == dict(rows)
    out = bpe.encode(awkward, text, keep=tuple(c for c in awkward.columns)).collect()
    assert Counter((r.doc_id, r.decoded) for r in out) == Counter((r.doc_id, r.text or "") for r in awkward.collect())
    assert bpe.encode(nothing, text).count() == 0
