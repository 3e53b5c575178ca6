"""Periodic runs against the definition, on random, planted and awkward texts."""
import hashlib
import random
import zlib

import numpy as np
import pytest

from tokenloom.llm import periods


def brute_runs(words, least=6, times=4):
    n, found = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.append((i, j + q, q))
            i = j
    own = [(s, e - s, q) for s, e, q in found if not any(d < q and q % d == 0 and a <= s and b >= e for a, b, d in found)]
    return sorted(own, key=lambda r: (r[0], r[2]))


def numbered(words):
    known = {}
    return np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)


@pytest.mark.parametrize("seed", range(60))
def test_runs_follow_the_definition(seed):
    rng = random.Random(seed)
    letters = rng.choice([1, 2, 3, 30, 1000])
    words = []
    while len(words) < rng.choice([0, 5, 40, 700, 2500]):
        p, times = rng.choice([1, 2, 3, 7, 15, 16, 17, 31, 32, 33, 63, 64, 65, 100, 128, 129, 200]), rng.choice([1, 3.9, 4, 4.1, 5, 9])
        unit = [rng.randrange(letters) for _ in range(p)]
        if rng.random() < 0.3 and p % 2 == 0:
            unit = unit[:p // 2] * 2  # its period is a divisor
        words += [unit[k % p] for k in range(int(p * times))] + [rng.randrange(letters) for _ in range(rng.choice([0, 1, 5, 60]))]
    assert periods.find_runs(numbered(words)) == brute_runs(words)


def test_sequences_that_defeat_polynomial_hashes():
    thue = [bin(k).count("1") & 1 for k in range(4096)]
    fib = "a"
    for _ in range(14):
        fib = fib.translate({97: "ab", 98: "a"})
    for words in (thue, thue[:512] * 5, list(fib[:1500]), list(fib[:233]) * 6):
        assert periods.find_runs(numbered(words)) == brute_runs(words)
    with pytest.raises(ValueError):
        periods.find_runs(np.arange(5), times=3)


def test_periodic_runs(spark, awkward, nothing):
    rng = random.Random(9)
    unit = [f"w{rng.randrange(50)}" for _ in range(37)]
    texts = [" ".join(["x", *unit * 5, "y"]), "a\na\ta  a\x0ba a", "a a a a a", None, "", "a b a b a b a b c", " ".join(["a"] * 50_000)]
    out = periods.periodic_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: r for r in out.collect()}
    for k, t in enumerate(texts[:6]):
        words = (t or "").split()
        want = brute_runs(words)
        assert [tuple(r) for r in got[k].runs] == want and got[k].n_words == len(words)
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert got[k].collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert [tuple(r) for r in got[6].runs] == [(0, 50_000, 1)] and got[6].collapsed == "a"
    own = {r.doc_id: r for r in periods.digests(out).collect()}
    assert own[0].start == 1 and own[0].period == 37 and own[0].length == 185 and own[0].exponent_milli == 5000
    assert own[3].start is None and own[3].n_runs == 0 and own[3].runs_sha256 == hashlib.sha256(b"").hexdigest()
    assert own[1].runs_sha256 == hashlib.sha256(b"0,6,1\n").hexdigest()
    rows = periods.digests(periods.periodic_runs(periods.planted(awkward)))
    assert rows.count() == awkward.count()
    assert periods.digests(periods.periodic_runs(periods.planted(nothing))).count() == 0


def test_planted_texts(spark):
    rng = random.Random(1)
    texts = {k: "  ".join(f"w{rng.randrange(9)}" for _ in range(rng.choice([0, 1, 2, 9, 80]))) for k in range(300)}
    got = dict(periods.planted(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect())
    for k, t in texts.items():
        h, words = zlib.crc32(str(k).encode()), t.split()
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert got[k].split() == [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        else:
            assert got[k] == t
