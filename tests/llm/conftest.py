import random

import pytest

MESSY_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
                "key string, th long, sig string, h long, n long, spans string, node string, label int")


def prose(rng, n, syllables=("ba", "ko", "ri", "mu", "ten", "sal", "vi", "or")):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls, empty and blank texts, a very long text, copies, near copies, repeated rows, shared passages, odd letters."""
    rng = random.Random(5)
    base, passage = prose(rng, 160).split(), prose(rng, 90)
    texts = [None, "", "   \n", "one", "Two words", "a b c d", "the same five words here", "The same FIVE words here", " ".join(base), " ".join(base),
             " ".join(base[:80] + ["changed"] + base[81:]), " ".join(base[:40] + ["x"] * 60 + base[100:]), prose(rng, 50) + " " + passage,
             prose(rng, 30) + " " + passage + " " + prose(rng, 9), prose(rng, 9000), "a" * 5000, "1234 5678 !!", "éàü ÉÀ ж中文", "tab\tand\x0bvertical\x0cfeed",
             "x" * 399, "y" * 400, "x y " * 300]
    rows = [(i, t) for i, t in enumerate(texts)] + [(8, " ".join(base)), (None, "one"), (None, None), (99, "one")]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    full = [(i, t, None if i is None or i % 3 == 0 else "en", None if i == 4 else f"s{(i or 0) % 3}", None, "k", 1, "s", 2, 3, "x", "n", None) for i, t in messy_rows]
    return spark.createDataFrame(full, MESSY_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], MESSY_SCHEMA)
