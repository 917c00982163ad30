import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, `row` int, g long, size int"


def text(rng: random.Random, n: int) -> str:
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    out = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for i in range(7, n, 9):
        out[i] += "."
    return " ".join(out)


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, ties, nulls, empty, very short and long ones."""
    rng = random.Random(7)
    texts: list[str | None] = [text(rng, rng.randint(4, 120)) for _ in range(40)]
    base = text(rng, 200)
    for i in range(12):
        words = base.split()
        words[10 + 9 * i] = "changed"
        texts.append(" ".join(words))
    texts += [texts[0], texts[0], texts[1].upper(), None, "", " \n\t ", "a", "a b c", "a b c", "é ü \U0001f600 x", text(rng, 6000), "1234 5678 !!!"]
    return texts


@pytest.fixture(scope="session")
def rows(corpus):
    sources = ["b", "a", None, "c", ""]
    return [(i, t, ["en", "de", None][i % 3], sources[0] if i % 3 else sources[i % 5], None if t is None else len(t), "k", 1, 2, 3) for i, t in enumerate(corpus)] + [(0, corpus[0], "en", "b", 1, "k", 1, 2, 3)]


@pytest.fixture(scope="session")
def documents(spark, rows):
    """The corpus as a table whose other columns clash with names used inside; row 0 twice."""
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
