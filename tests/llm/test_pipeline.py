"""Each stage against brute force over what the stage before it kept."""

import random
from collections import Counter

import numpy as np
import pytest
from conftest import words
from test_dedup import brute_lines, brute_spans

pytest.importorskip("public_tokenizers")
import corpus_pipeline as pipeline  # noqa: E402
from chronoloom.llm import simhash  # noqa: E402


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory, texts):
    rng = random.Random(1)
    rows = [(i, t, "aa", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(1000 + i, words(rng, 60), "aa", "s", 1) for i in range(20)] + [(2000, "12 34 !!", None, None, None)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, table, tmp_path):
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None
    docs, kept = spark.read.parquet(f"{table}/documents.parquet"), []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, table)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == pipeline.COLUMNS
        kept.append(docs.collect())
    given = spark.read.parquet(f"{table}/documents.parquet").collect()
    text = lambda rows: {r["doc_id"]: r["text"] for r in rows}
    # language: those without a letter go, the others stay as they are
    assert text(kept[0]) == {i: t for i, t in text(given).items() if any(c.isalpha() for c in t or "")}
    # lines
    want = brute_lines(list(text(kept[0]).items()), 10)
    assert text(kept[1]) == {i: x[2] for (i, _), x in want.items()} and text(kept[1]) != text(kept[0])
    # near duplicates
    ids = sorted(text(kept[1]))
    fps = np.array([simhash.fingerprint(text(kept[1])[i]) for i in ids], np.uint64)
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3).tolist():
            a, b = group[i], group[j]
            group = [min(a, b) if g in (a, b) else g for g in group]
    assert text(kept[2]) == {ids[g]: text(kept[1])[ids[g]] for g in set(group)} and len(kept[2]) < len(kept[1])
    # passages
    data = [(i, t.encode()) for i, t in text(kept[2]).items()]
    for (i, b), spans in zip(data, brute_spans(data, 200)):
        edges = [0, *(x for s in spans for x in s), len(b)]
        assert text(kept[3])[i] == b"".join(b[x:y] for x, y in zip(edges[::2], edges[1::2])).decode("utf-8", "ignore")
    assert all(r["n_chars"] == len(r["text"]) for r in kept[3])
    # packing
    assert {r["doc_id"] for r in kept[4]} == set(text(kept[3]))
    by = {}
    for r in kept[4]:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in p) <= 4096 for p in by.values())
    assert len(by) <= -(-sum(n for p in by.values() for _, n in p) // 4096) + 1
    # the stages in one go
    cells = lambda rows: Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    assert cells(pipeline.run(spark, table).collect()) == cells(kept[4])
