"""Property-based checks of column expressions against plain-Python definitions."""

import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tokenloom.functions.tags import grab_tag
from tokenloom.operators.recsets import split_sizes
from tokenloom.session import scale_conf


@pytest.mark.parametrize("text, tag", [
    ("genre---rock", "rock"), ("rock genre---pop", "pop"), ("genre---a---b genre---c", "a---b"), ("xgenre---y", ""),
    ("  \t mood/theme---sad \t genre---x ", "x"), ("genre---", ""), ("genre--- genre---late", ""), ("", ""), ("   ", ""), (None, ""),
    ("Genre---rock", ""), ("genre---x\tgenre---y", "x")])
def test_grab_tag_examples(spark, text, tag):
    assert [r[0] for r in spark.createDataFrame([(text,)], "t string").select(grab_tag("t", "genre---")).collect()] == [tag]


labels = st.text(alphabet="abc-", min_size=1, max_size=5)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.sampled_from(["rock", "x---y", "mood/theme---z"]), max_size=3), labels, st.lists(labels, max_size=2),
                          st.sampled_from([" ", "  ", " \t"])), min_size=1, max_size=8))
def test_first_label_wins(spark, rows):
    """Other words before, further labels behind: the first label comes out."""
    texts = [sep.join([*before, f"genre---{first}", *(f"genre---{x}" for x in behind)]) for before, first, behind, sep in rows]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = dict(df.select("i", grab_tag("t", "genre---")).collect())
    assert [got[i] for i in range(len(rows))] == [first for _, first, _, _ in rows]


@given(st.integers(min_value=1, max_value=10**9))
def test_split_sizes_partition_n(n):
    tr, va, te = split_sizes(n)
    assert tr + va + te == n and min(tr, va, te) >= 0
    assert te >= va and te - va <= 1 and tr >= n - math.ceil(0.2 * n)


@given(st.floats(min_value=1e9, max_value=1e15), st.integers(1, 64), st.integers(1, 2000))
def test_scale_conf_bounds(nbytes, cores, execs):
    c = scale_conf(nbytes, cores, execs)
    assert int(c["spark.sql.shuffle.partitions"]) >= 2 * cores * execs
    assert 32 <= int(re.sub("m$", "", c["spark.sql.files.maxPartitionBytes"])) <= 256
