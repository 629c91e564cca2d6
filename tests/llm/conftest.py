import random

import pytest


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages and lines, nulls, and one long text."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(1, 120)) for _ in range(40)]
    passage, line = words(rng, 80), "A common LINE "
    out = [*base, None, None, "", " \n\t", "a", "é" * 500, *base[:8], *(b.replace("a", "A", 1) for b in base[8:16]), *(f"{b}\n{line}\n{passage}" for b in base[16:28]), words(rng, 20_000)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with ids, a null id, a repeated row, and columns with names used inside."""
    rows = [(i, t, "x", 1, "k") for i, t in enumerate(texts)] + [(None, "no id", "x", 1, "k"), (3, texts[3], "x", 1, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, h long, key string").repartition(3)
