import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, score double, id long, node long, tokens string"


@pytest.fixture(scope="session")
def spark():
    from tokenloom.session import get_spark
    return get_spark("local[4]", app="tokenloom-tests", shuffle_partitions=8, extra={"spark.driver.memory": "6g"})


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, columns with clashing names."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7)))
    base = [word() for _ in range(60)]
    texts = [None, "", "   \n\t ", "one", "two words", " ".join(base), " ".join(base), " ".join(base[:-1]),
             " ".join([*base, "tail"]).upper(), "x " * 40_000, "y" * 300_000, " ".join(word() for _ in range(30_000)),
             " ".join(base[:20]) + " " + " ".join(word() for _ in range(50)), "a\x00b ​ \u0085 c"]
    rows = [(i, t, None, "s", len(t) if t else None, None, None, i, 1, "t") for i, t in enumerate(texts)]
    rows += [rows[5], rows[1], (None, " ".join(base), None, None, None, None, None, None, None, None), (None,) * 10]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
