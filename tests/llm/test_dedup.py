import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm.components import stars
from chronoloom.llm.exact_dedup import Directory, exact_dedup
from chronoloom.llm.line_dedup import line_bitmaps, line_dedup
from chronoloom.llm.simhash import fingerprint, fuzzy_keys, keep_one, simhash_components
from chronoloom.llm.suffix_dedup import _heads, as_text, merge, repeated_windows, suffix_dedup, suffix_order

WHITE = " \t\n\x0b\x0c\r"


def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("hash_bits", [64, 3])
def test_exact_dedup(docs, hash_bits):
    groups = defaultdict(list)
    for i, t in rows(docs):
        groups["".join(c for c in t or "" if c not in WHITE)].append((i, len(t or "")))
    got = exact_dedup(docs, capacity=4, hash_bits=hash_bits).collect()
    assert len(got) == docs.count()
    want = {}
    for norm, members in groups.items():
        best = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        for m in members:
            want[m[0], hashlib.sha256(norm.encode()).hexdigest()] = (best[0], len(members), m == best)
    for r in got:
        assert want[r["doc_id"], r["text_sha256"]] == (r["keep_id"], r["group_size"], r["kept"])
    if hash_bits == 3:
        assert max(r["chain"] for r in got) > 0


def test_directory_doubles():
    d = Directory.build({0: 10, 1: 10, 7: 1}, capacity=10, max_depth=3)
    assert d.depth == 3 and sorted(s for s, _ in d.slots()) == list(range(8))
    assert Directory.build({5: 100}, capacity=1, max_depth=3).depth == 3  # one key can't be split further
    assert Directory.build({}, capacity=1).slots() == [(0, 0)]


def brute_lines(data, min_docs, keep_first=False):
    key = lambda line: line.strip(WHITE).translate({i: i + 32 for i in range(65, 91)})
    found, first = defaultdict(set), {}
    for i, t in sorted(data, key=lambda x: (x[0] is None, x[0] or 0)):
        for p, line in enumerate((t or "").split("\n")):
            if key(line):
                found[key(line)].add(i)
                first.setdefault(key(line), (i, p))
    out = {}
    for i, t in data:
        lines = (t or "").split("\n")
        kept = [x for p, x in enumerate(lines) if not key(x) or len(found[key(x)]) < min_docs or (keep_first and first[key(x)] == (i, p))]
        out[i, t] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("min_docs,keep_first", [(10, False), (2, False), (2, True)])
def test_line_dedup(docs, min_docs, keep_first):
    data = rows(docs)
    want = Counter((i, *x) for (i, t), x in ((d, brute_lines(data, min_docs, keep_first)[d]) for d in data))
    got = line_dedup(docs, min_docs=min_docs, keep_first=keep_first)
    assert set(got.columns) == {*docs.columns, "n_lines", "n_dropped"}
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in got.collect()) == want


def test_line_bitmaps_are_sparse(spark):
    df = spark.createDataFrame([(i, "\n".join(["x"] + [f"{i} {k}" for k in range(300)] + ["x"])) for i in range(3)], "doc_id long, text string")
    drops = [r["drops"] for r in line_bitmaps(df, min_docs=3).collect()]
    assert drops == [{0: 1, 4: 1 << 301 - 256}] * 3


def test_fingerprint():
    import xxhash

    def brute(t, n=3):
        p = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(p[i : i + n]), 42) for i in range(max(1, len(p) - n + 1))] if p else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for t in (None, "", " \n", "a", "A b", "a b C", "a  b\tc d É É", "x y " * 300):
        assert fingerprint(t) == brute(t)


def test_golay_keys_meet_within_three_bits():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = a.copy()
    for i in range(len(a)):
        for k in rng.choice(64, i % 4, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(k)
    both = []
    for x in (a, b):
        sets = [set() for _ in x]
        for i, k in zip(*fuzzy_keys(x)):
            sets[i].add(int(k))
        both.append(sets)
    assert all(x & y for x, y in zip(*both))


@pytest.mark.parametrize("most", [4096, 4])
def test_simhash_components(spark, docs, most):
    got = simhash_components(docs, most=most).collect()
    assert len(got) == docs.count()
    fps, ids = np.array([int(r["fingerprint"], 16) for r in got], np.uint64), [r["doc_id"] for r in got]
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3).tolist():
            parent[root(i)] = root(j)
    for i, r in enumerate(got):
        assert r["component_id"] == min((x for k, x in enumerate(ids) if root(k) == root(i) and x is not None), default=None)
    kept = keep_one(docs).collect()
    assert {r["doc_id"] for r in kept} == {r["component_id"] for r in got}


def test_many_near_fingerprints_make_one_component(spark):
    """A chain of neighbours, more of them than a block holds."""
    from chronoloom.llm.simhash import link_fingerprints

    rng, fp, chain = np.random.default_rng(2), 0, [0]
    while len(chain) < 300:
        fp ^= 1 << int(rng.integers(0, 40))
        if fp not in chain:
            chain.append(fp)
    links = link_fingerprints(spark.createDataFrame([(x,) for x in chain], "fp long"), most=16)
    assert stars(links).select("root").distinct().collect() == [(min(chain),)]


def test_stars(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 202), (202, 200), (None, 5)], "a long, b long")
    assert {r["node"]: r["root"] for r in stars(links).collect()} == {**{i: 0 for i in range(41)}, 200: 200, 201: 200, 202: 200}
    assert stars(links.limit(0)).count() == 0


def brute_spans(data, length):
    counts = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    return [merge([(i, i + length) for i in range(len(b) - length + 1) if counts[b[i : i + length]] > 1]) for _, b in data]


@pytest.mark.parametrize("most", [4096, 2])
def test_suffix_dedup(docs, most):
    data = [(i, (t or "").encode()) for i, t in rows(docs)]
    want = Counter()
    for (i, b), spans in zip(data, brute_spans(data, 200)):
        edges = [0, *(x for s in spans for x in s), len(b)]
        want[i, len(b), tuple(spans), b"".join(b[x:y] for x, y in zip(edges[::2], edges[1::2]))] += 1
    got = suffix_dedup(docs, length=200, most=most)
    assert set(got.columns) == {*docs.columns, "kept", "n_bytes", "spans"} - {"text"}
    assert Counter((r["doc_id"], r["n_bytes"], tuple((s["start"], s["stop"]) for s in r["spans"]), bytes(r["kept"])) for r in got.collect()) == want
    assert got.select(as_text("kept").alias("t")).where("t is null").count() == 0


def test_repeated_windows():
    import random

    rng = random.Random(3)
    for _ in range(150):
        n, base = rng.choice([3, 8, 9, 17]), bytes(rng.choice(b"abc") for _ in range(50))
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) + base[rng.randint(0, 20) : rng.randint(20, 50)] for _ in range(rng.randint(0, 5))] + [b"a" * rng.randint(0, 40)]
        counts = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
        assert [x.tolist() for x in repeated_windows(texts, n)] == [[i for i in range(len(t) - n + 1) if counts[t[i : i + n]] > 1] for t in texts]


def test_repeated_windows_around_the_heads():
    """Strings shorter and longer than the 8 bytes from which the extension starts."""
    rng = np.random.default_rng(12)
    for _ in range(300):
        length, letters = rng.choice([1, 2, 7, 8, 9, 12, 20]), rng.integers(1, 3)
        texts = [bytes(rng.integers(97, 97 + letters, rng.integers(0, 60)).astype(np.uint8)) for _ in range(rng.integers(1, 5))]
        seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = [[i for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1] for t in texts]
        assert [w.tolist() for w in repeated_windows(texts, length)] == want
        data = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)
        order = suffix_order(data, 64, _heads(data))
        padded = data.tobytes() + b"\xff" * 64
        heads = [padded[i : i + 64] for i in order]
        assert heads == sorted(heads) and sorted(order) == list(range(len(data)))


def test_empty_tables(docs):
    none = docs.limit(0)
    for f in (exact_dedup, line_dedup, simhash_components, suffix_dedup, keep_one):
        assert f(none).count() == 0


def test_all_rows_alike(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("the same words again " * 30).alias("text"))
    assert exact_dedup(df).where("kept").collect()[0]["keep_id"] == 0
    assert simhash_components(df).select("component_id").distinct().collect() == [(0,)]
    assert suffix_dedup(df).where("length(kept) > 0").count() == 0
    assert line_dedup(df).where("n_dropped = 1").count() == 500


def test_columns_with_names_used_inside(spark):
    extra = ["n_lines", "n_dropped", "_row", "_key", "_id", "_drops", "kept", "spans", "_z", "_spans", "_kept", "key", "region"]
    df = spark.createDataFrame([(i, f"some words {i}\nline", *[1] * len(extra)) for i in range(12)], ["doc_id", "text", *extra])
    assert line_dedup(df).where("n_dropped = 1").count() == 12
    assert suffix_dedup(df).where("size(spans) = 0").count() == 12
    assert keep_one(df).count() == simhash_components(df).select("component_id").distinct().count()
    assert exact_dedup(df).where("kept").count() == 12


def test_keep_bitmaps(spark):
    df = spark.createDataFrame([(i, "\n".join(["x"] + [f"{i} {k}" for k in range(300)] + ["x"])) for i in range(3)], "doc_id long, text string")
    assert [r["keeps"] for r in line_bitmaps(df, min_docs=3).collect()] == [{0: ~1, 4: ~(1 << 301 - 256)}] * 3


@pytest.mark.parametrize("block", [64, 16, 4, 1])
def test_equal_windows_fall_to_equal_parts(block):
    """Regions of one minimizer, cut out of copies with a changed byte."""
    from chronoloom.llm.suffix_dedup import parts, regions

    rng = np.random.default_rng(8)
    base, keys = rng.integers(97, 100, 700).astype(np.uint8), {}
    for _ in range(60):
        data = base.copy()
        data[rng.integers(0, 700)] = 65 + rng.integers(0, 20)
        for _, start, stop, gram, _, _ in zip(*regions(data, np.array([0, 700]), 200)):
            part = data[start:stop]
            starts, stops, key, *_ = parts(part, int(gram.view(np.int64)), 200, block)
            assert starts[0] == 0 and stops[-1] == len(part) and (starts[1:] == stops[:-1] - 199).all()
            for a, b, k in zip(starts, stops, key):
                for at in range(a, b - 199):
                    assert keys.setdefault((int(gram), part[at : at + 200].tobytes()), int(k)) == int(k)


def test_many_near_copies_of_a_passage(spark):
    """More different regions under a minimizer than a batch takes, on every level."""
    rng = np.random.default_rng(9)
    base, texts = rng.integers(97, 123, 420).astype(np.uint8), []
    for _ in range(80):
        data = base.copy()
        data[rng.integers(0, 420)] = 65
        texts.append(data.tobytes().decode())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {i: spans for (i, _), spans in zip(enumerate(texts), brute_spans([(i, t.encode()) for i, t in enumerate(texts)], 200))}
    got = {r["doc_id"]: [(s["start"], s["stop"]) for s in r["spans"]] for r in suffix_dedup(df, most=3).collect()}
    assert got == want
