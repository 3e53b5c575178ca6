"""Vectors, the pipeline, and the registration of the queries."""
import re

import numpy as np
import pytest

import corpus_pipeline
from tokenloom.llm import registry, vectors


def brute_vectors(rows, least=0.9):
    ids, units = [], []
    for i, v in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if v and all(c is not None and np.isfinite(c) for c in v) and any(v) and len(v) == 16:
            ids.append(i)
            units.append(np.array(v, float) / np.linalg.norm(np.array(v, float)))
    near = np.array(units) @ np.array(units).T >= least
    np.fill_diagonal(near, False)
    label = vectors._labels(near)
    return {i: (int(n), ids[k]) for i, n, k in zip(ids, near.sum(axis=1), label)}


@pytest.mark.parametrize("window", [512, 16])
def test_near_vectors(spark, window):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 16))
    for k in range(0, 120, 3):
        x[k + 1] = x[k] + 0.08 * rng.standard_normal(16)
    x[300:360] = x[300] + 0.05 * rng.standard_normal((60, 16))  # a group larger than a window
    rows = [(int(k), [float(c) for c in v]) for k, v in enumerate(x)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [1.0] * 15 + [None]), (1004, [float("nan")] + [1.0] * 15),
             (1005, [float("inf")] + [1.0] * 15), (1006, [1.0] * 3), (None, rows[0][1]), (1007, [c * 1e-200 for c in rows[5][1]])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, id long, block int")
    got = vectors.near_vectors(frame, window=window, recall=0.9999).collect()
    want = brute_vectors(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id) == want.get(r.vec_id, (0, r.vec_id))
        assert r.kept == (r.vec_id is None or r.vec_id == r.component_id)
    empty = frame.limit(0)
    assert vectors.near_vectors(empty).count() == 0


def test_recall_on_the_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).collect()}
    found = sum(got[i] for i, _ in rows)
    assert found >= 0.99 * near.sum() and all(got[i] <= n for (i, _), n in zip(rows, near.sum(axis=1)))


@pytest.mark.parametrize("n", [10**4, 2 * 10**7, 10**9])
def test_passes_keep_the_recall(n):
    """Enough passes for every number of hashes, at every size; there is no cap."""
    chance = 1 - np.arccos(0.9) / np.pi
    for hashes in range(1, int(np.log2(n)) + 1):
        assert 1 - (1 - chance ** hashes) ** vectors.passes_needed(0.9, hashes, 0.995) >= 0.995


def test_recall_in_a_dense_cone(spark):
    """50,000 vectors with a common mean direction, a part of them in a dense cone, with planted pairs just above the threshold."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((50_000, 64)) / 8
    x[:, 0] += 1.2
    x[:20_000, 1] += 0.6
    x /= np.linalg.norm(x, axis=1)[:, None]
    for k in range(0, 4000, 2):
        y = rng.standard_normal(64)
        y -= (y @ x[k]) * x[k]
        x[k + 1] = 0.905 * x[k] + np.sqrt(1 - 0.905 ** 2) * y / np.linalg.norm(y)
    want, own = np.zeros(len(x), int), np.arange(len(x))
    for lo in range(0, len(x), 2000):
        near = x[lo:lo + 2000] @ x.T >= 0.9
        near[np.arange(len(near)), own[lo:lo + 2000]] = False
        want[lo:lo + 2000] = near.sum(axis=1)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(16)
    got = np.zeros(len(x), int)
    for r in vectors.near_vectors(frame).select("vec_id", "n_links").collect():
        got[r.vec_id] = r.n_links
    assert want.sum() >= 4000 and (got <= want).all() and got.sum() >= 0.99 * want.sum()


def test_registry():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in registry.QUERIES)
    assert numbers == list(range(1, 14)) and set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "bpe"]


def test_pipeline_stages(spark, awkward, nothing):
    sf = "/root/testdata/sf0.001"
    clashing = awkward.selectExpr("*", "label AS toxicity", "text AS found", "lang AS secret", "id AS digest", "node AS print", "score AS _text")
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), clashing, nothing):
        before = docs
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, before, sf)
            after = spark.createDataFrame(after.collect(), after.schema)
            if name != "bpe":
                assert after.columns == before.columns
            own = [c for c in before.columns if c != "text"]  # the other columns of a row stay as they were
            rows = {repr(r) for r in before.select(own).collect()}
            assert all(repr(r) in rows for r in after.select(own).collect())
            if name in ("personal_data", "bpe"):
                assert after.count() == before.count()
            before = after
        assert before.where("NOT round_trip OR n_tokens <> size(ids)").count() == 0


def test_pipeline_decisions(spark):
    """What each stage drops, against plain Python."""
    from tests.llm.test_documents_ops import brute_groups, shingle_texts
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = {r.doc_id: r.text for r in docs.limit(250).collect()}
    some = docs.where(docs.doc_id.isin(list(texts)))
    kept = {r.doc_id for r in stages["near_duplicates"](spark, some, sf).collect()}
    assert kept == {i for i, (_, low) in brute_groups(texts.items(), 80).items() if i == low}
    items = [shingle_texts(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    own = {r.doc_id: shingle_texts(r.text) for r in docs.collect()}
    clean = {i for i, s in own.items() if not any(t and 100 * len(s & t) >= 80 * len(t) for t in items)}
    assert {r.doc_id for r in stages["decontamination"](spark, docs, sf).collect()} == clean
    assert 0 < len(own) - len(clean) < len(own) / 2
    total = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 0 < total.count() <= 200 and "ids" in total.columns


def test_pipeline_rewrites(spark):
    """Toxic documents that go, and the last two stages' texts and tokens, against plain Python and the tokenizers library."""
    import public_tokenizers
    import tokenizers

    from tokenloom.llm import pii, toxicity
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages, texts = dict(corpus_pipeline.STAGES), {r.doc_id: r.text for r in docs.collect()}
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    bias, hit, length = lexicon.curve
    score = {i: 1 / (1 + np.exp(-(bias + np.dot(toxicity.measures(lexicon, t), (hit, length))))) for i, t in texts.items()}
    kept = {r.doc_id for r in stages["toxicity"](spark, docs, sf).collect()}
    assert kept == {i for i, s in score.items() if s < 0.5} and 0.8 * len(texts) < len(kept) < len(texts)
    spark.conf.set(corpus_pipeline.KEY_SETTING, "of the test")
    try:
        hidden = spark.createDataFrame(stages["personal_data"](spark, docs, sf).collect(), docs.schema)
        want = {r.doc_id: r.text for r in pii.pseudonymize(docs, "of the test").collect()}
        assert {r.doc_id: r.text for r in hidden.collect()} == want
    finally:
        spark.conf.unset(corpus_pipeline.KEY_SETTING)
    assert {r.doc_id for r in hidden.collect() if r.text != texts[r.doc_id]} == {r.doc_id for r in pii.pseudonymize(docs, "k").where("n_private > 0").collect()}
    library = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    library.no_truncation()
    library.no_padding()
    for r in stages["bpe"](spark, hidden, sf).collect():
        assert r.ids == library.encode(r.text, add_special_tokens=False).ids and r.n_tokens == len(r.ids) and r.round_trip
