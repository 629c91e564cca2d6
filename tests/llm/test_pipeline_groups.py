"""What the pipeline keeps of groups of equal texts."""

import random

import pytest
from conftest import words

pytest.importorskip("public_tokenizers")
import corpus_pipeline as pipeline  # noqa: E402
from chronoloom.llm.simhash import keep_one  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_of_many_copies_stays(spark):
    rng = random.Random(4)
    copied, other = "\n".join(words(rng, 30) for _ in range(70)), words(rng, 40)
    texts = [copied] * 12 + [other] * 11 + [f"{words(rng, 60)}\n{other}" for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    for _, stage in pipeline.STAGES[:4]:
        docs = stage(spark, docs, "").localCheckpoint()
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got[0] == copied and got[12] == other
    # besides one of each group and the rest without its common line, an empty text is left
    assert sorted(got.values()) == sorted(["", copied, other, *(t.split("\n")[0] for t in texts[23:])])
    packed = pipeline.pack(spark, docs, "").collect()
    assert sum(r["length"] for r in packed if r["doc_id"] == 0) > 1000


def test_one_row_of_repeated_rows_and_ids(spark):
    rng = random.Random(6)
    repeated, second, nulls = words(rng, 120), words(rng, 120), [words(rng, 120) for _ in range(3)]
    rows = [(1, repeated), (1, repeated), (1, second), (0, second), *((None, t) for t in nulls), (None, nulls[0])]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in rows], SCHEMA).repartition(3)
    want = sorted([(1, repeated), (0, second), *((-1, t) for t in nulls)])
    for kept in (keep_one(docs), pipeline.near_dedup(spark, docs, "")):
        assert kept.columns == docs.columns
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in kept.collect()) == want
    # a repeated row isn't emptied by the stage after
    cut = pipeline.drop_repeated_passages(spark, pipeline.near_dedup(spark, docs, "").localCheckpoint(), "")
    assert repeated in {r["text"] for r in cut.collect()}


def test_stages_on_an_empty_table_and_on_nulls(spark):
    rng = random.Random(7)
    empty = spark.createDataFrame([], SCHEMA)
    rows = [(None, words(rng, 80), None, None, None), (5, None, "aa", "s", 0), (6, "", "aa", "s", 0), (7, words(rng, 80), None, "s", None), (8, words(rng, 90), "aa", None, 3)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", key long, _row string")
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
        if name != "best_fit_packing":
            assert stage(spark, docs.drop("key", "_row"), "").columns == stage(spark, docs, "").columns == pipeline.COLUMNS
    texts = {r[0]: r[1] or "" for r in rows}
    one_of_empty = [5, 6]
    kept = {r["doc_id"]: r["text"] for r in pipeline.near_dedup(spark, docs, "").collect()}
    assert set(kept) == {None, 5, 7, 8} and all((kept[i] or "") == texts[i] for i in kept) and one_of_empty[0] in kept
    assert {r["doc_id"]: r["text"] for r in pipeline.drop_repeated_passages(spark, docs, "").collect()} == texts
    assert {r["doc_id"] for r in pipeline.language_id(spark, docs, "").collect()} <= {None, 7, 8}
