import random

import pytest

#: Columns that clash with names the operators use inside.
EXTRA = "block string, key string, n string, _score string, head string, mine string, _row string, asked string, shard string"
BASE = "doc_id long, text string, lang string, source string, n_chars int"


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def frame(spark, rows, extra=True):
    """rows: (doc_id, text[, lang, source])."""
    full = [(d, t, *(more or (["en", "s"])), None if t is None else len(t)) for d, t, *more in rows]
    if extra:
        return spark.createDataFrame([(*r, *["x"] * 9) for r in full], f"{BASE}, {EXTRA}")
    return spark.createDataFrame(full, BASE)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs in every column, empty, tiny and very long texts, repeated rows, clashing columns."""
    long = " ".join(words(1, 30_000, 5000))
    same = " ".join(words(2, 120))
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, long), (5, same), (5, same), (None, same), (6, " ".join(words(3, 90)), None, None), (7, "a\n" * 200), (None, None, None, None)]
    return frame(spark, rows).cache()


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return odd_docs.limit(0)
