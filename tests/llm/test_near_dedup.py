import random

import pytest
from conftest import words

from chronoloom.llm.near_dedup import keep_near_one, near_components


def brute(texts, size=5, similarity=0.8):
    """The group number of each text."""
    sets = []
    for t in texts:
        p = (t or "").encode().lower().split()
        sets.append({tuple(p[k : k + size]) for k in range(max(1, len(p) - size + 1))} if p else set())
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a and b and len(a & b) >= similarity * len(a | b)):
                x, y = group[i], group[j]
                group = [min(x, y) if g in (x, y) else g for g in group]
    return group


@pytest.fixture(scope="module")
def edited(spark):
    """Texts with 0 to 6 words of 200 changed (similarities about 1 to 0.7), a chain, small ones."""
    rng = random.Random(9)
    out = [None, "", " \n", "a b", "A  b", "a c", "a b c d e f"]
    for i in range(30):
        base = words(rng, 200).split()
        out.append(" ".join(base))
        for k in range(7):
            near = list(base)
            for p in rng.sample(range(200), k):
                near[p] = f"w{i}x{k}x{p}"
            out.append(" ".join(near))
    chain = words(rng, 200).split()
    for k in range(40):
        chain[(k * 37) % 200] = f"c{k}"
        chain[(k * 53 + 7) % 200] = f"d{k}"
        out.append(" ".join(chain))
    rng.shuffle(out)
    return out, spark.createDataFrame(list(enumerate(out)), "doc_id long, text string").repartition(3)


def test_near_components_against_brute_force(edited):
    texts, df = edited
    want = brute(texts)
    got = {r["id"]: bytes(r["component"]) for r in near_components(df).collect()}
    assert len(got) == len(texts)
    assert len({(want[i], c) for i, c in got.items()}) == len(set(want)) == len(set(got.values()))


def test_the_stage_keeps_one_of_each(spark, edited):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as pipeline
    from pyspark.sql import functions as F

    texts, df = edited
    docs = df.select("doc_id", "text", F.lit("aa").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    assert sorted(r["doc_id"] for r in pipeline.near_dedup(spark, docs, "").collect()) == sorted(set(brute(texts)))
    assert keep_near_one(df.limit(0)).count() == 0
