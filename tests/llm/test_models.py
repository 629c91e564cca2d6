import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm.bpe import Codec, Prefixes, bpe_encode
from chronoloom.llm.langid import bounded_sample, Profiles, language_id, ngrams
from chronoloom.llm.packing import WordTokenizer, fullest, minimum_bin_slack, pack
from chronoloom.llm.topk import as_integers, nra_topk
from chronoloom.llm.toxicity import WIDTHS, toxicity, train_on, untrained
from chronoloom.llm.warc import dedup_archives, parse, resolve_revisits

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
STRANGE = "abcdefgh éßñ中文日本語😀\t\n  12345!?.,'s ÀÉ́ \x00\r\x1c\x85　\xa0İΣσς<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return Codec(RANKS, P.PATTERN, most_cached=50)


def test_bpe_equals_the_library(own, library, texts):
    rng = random.Random(1)
    strange = ["".join(rng.choice(STRANGE) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for t in [*strange, *(t or "" for t in texts), "a" * 5000]:
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_bpe_of_many_texts_at_once(library, texts):
    rng = random.Random(8)
    some = ["".join(rng.choice(STRANGE + "etaoin " * 9) for _ in range(rng.randint(0, 200))) for _ in range(400)]
    some += [*(t or "" for t in texts), "a" * 300, "", " " + "é" * 48, "x" * 49, "thequickbrownfoxjumps" * 2]
    want = [library.encode_ordinary(t) for t in some]
    for most in (10, 300, 300_000):  # with a cache that forgets while the texts are encoded, and one that doesn't
        c = Codec(RANKS, P.PATTERN, most_cached=most)
        for _ in range(2):
            assert [np.frombuffer(i, "<u4").tolist() for i in c.encode_all(some)] == want
    pieces = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 60))).encode() for _ in range(3000)]
    assert [np.frombuffer(i, "<u4").tolist() for i in c.together.encode(pieces)] == list(map(c.vocabulary.encode, pieces))
    assert c.encode_all([]) == [] and c.together.encode([]) == []


def test_bpe_append_and_edit(own, library):
    rng, v = random.Random(2), own.vocabulary
    for _ in range(100):
        x = "".join(rng.choice("etaoinshr") for _ in range(rng.randint(0, 200)))
        p, k = Prefixes(v), rng.randint(0, len(x))
        p.append(x[:k].encode())
        p.append(x[k:].encode())
        assert p.encode() == library.encode_ordinary(x) and p.encode(k) == library.encode_ordinary(x[:k])
        i = rng.randint(0, len(x))
        j, new = rng.randint(i, min(len(x), i + 4)), "xyz"[: rng.randint(0, 3)]
        p.replace(i, j, new.encode())
        y = x[:i] + new + x[j:]
        assert p.last == Prefixes(v, y.encode()).last and p.encode() == library.encode_ordinary(y)
    p = Prefixes(v, b"some longer text for the edit " * 300)
    assert p.replace(4000, 4001, b"Q") < 500  # only near the edit


def test_bpe_query(docs, library):
    got = bpe_encode(docs, RANKS, P.PATTERN).collect()
    assert len(got) == docs.count()
    want = Counter()
    for r in docs.collect():
        ids = np.array(library.encode_ordinary(r["text"] or ""), "<u4").tobytes()
        want[r["doc_id"], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    by_id = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert all(r["decoded"] == by_id[r["doc_id"]] for r in got)
    assert bpe_encode(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_fullest_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(0, 40)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * m for s in sums for m in range(n + 1) if s + k * m <= room}
        use = fullest(counts, room)
        assert sum(k * n for k, n in use.items()) == max(sums) and all(n <= counts[k] for k, n in use.items())


def test_packing_is_close_to_the_bound():
    rng = random.Random(4)
    counts = Counter(min(4096, int(rng.expovariate(1 / 600)) + 1) for _ in range(20_000))
    plan = minimum_bin_slack(dict(counts))
    used = Counter()
    for use, times in plan:
        assert sum(k * n for k, n in use.items()) <= 4096
        for k, n in use.items():
            used[k] += n * times
    assert used == counts
    assert sum(t for _, t in plan) <= -(-sum(k * n for k, n in counts.items()) // 4096) + 1


def test_pack(docs):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = Counter()
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 256)):
            piece = ids[at : at + 256]
            want[r["doc_id"], k, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    got = pack(docs, path, capacity=256).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= -(-sum(r["length"] for r in got) // 256) + 1
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)
    # a document can be read again from its pieces
    long = max((r for r in docs.collect() if r["text"]), key=lambda r: len(r["text"]))
    ids = b"".join(r["ids"] for r in sorted((r for r in got if r["doc_id"] == long["doc_id"]), key=lambda r: r["piece"]))
    assert np.frombuffer(ids, "<u4").tolist() == t.encode(long["text"], add_special_tokens=False).ids + [1]
    lean = pack(docs, path, capacity=256, with_ids=False)
    assert "ids" not in lean.columns and Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in lean.collect()) == want
    assert pack(docs.limit(0), path).count() == 0


def test_word_tokenizer_equals_the_library():
    from tokenizers import Tokenizer

    path, rng = P.path("word_bpe_49k.json"), random.Random(5)
    t, own = Tokenizer.from_file(path), WordTokenizer(path, True, most_cached=50)
    for _ in range(1500):
        x = "".join(rng.choice(STRANGE) for _ in range(rng.randint(0, 60)))
        assert np.frombuffer(own.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    texts = ["", "a", *("".join(rng.choice(STRANGE) for _ in range(rng.randint(0, 60))) for _ in range(400)), ""]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    for together in (1, 5, 50, 10**6):  # groups of every size, and texts much longer than a group
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts, together)] == want
    assert own.encode_all([]) == []


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 0.2, (300, 8)).round(2)
    x[7] = x[9] = x[11] = 0.5  # ties
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(300, None, 0), (301, [None] + [0.1] * 7, 0), (302, [float("nan")] * 8, 0), (None, [0.1] * 8, 0), (5, x[5].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard long").withColumn("vector", as_integers(F.col("embedding")))
    got = {}
    for r in nra_topk(df, F.col("vec_id") % 20 == 0, k=20, shard_rows=64, block_rows=4).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    a = np.floor(64 * x).astype(int)
    assert set(got) == set(range(0, 300, 20))
    for q in got:
        s = a @ a[q]
        best = sorted((-s[i], i) for i in range(300) if i != q)[:20]
        assert [got[q][k + 1] for k in range(20)] == [(i, -n) for n, i in best]
    few = nra_topk(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert len(few) == 2
    assert nra_topk(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_language_id(spark):
    rng = random.Random(7)
    alphabets = {"aa": "abcde", "bb": "defgh", "cc": "ßéøåñ"}
    make = lambda lang: " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(1, 5))) for _ in range(30))
    rows = [(i, make(lang), lang, "x", 1.0) for i, lang in enumerate(sorted(alphabets) * 60)]
    rows += [(1000, None, "aa", "", 0.0), (1001, "123 !?", "bb", "", 0.0), (1002, "abc", None, "", 0.0), (None, make("aa"), "bb", "", 0.0), (3, rows[3][1], "aa", "", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    got = language_id(df).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["doc_id"]
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if i in (1000, 1001):
            assert r["lang_pred"] == "und" and r["score"] == 0
        elif i is not None and i < 180:
            assert r["lang_pred"] == rows[i][2]
    assert language_id(df.limit(0)).count() == 0


def test_bounded_sample_by_language(spark):
    rows = spark.range(5000).selectExpr("id", "case when id % 100 = 0 then 'few' when id % 2 = 0 then 'many' else 'more' end as lang")
    got = bounded_sample(rows, F.col("id"), 200, F.col("lang")).collect()
    assert Counter(r["lang"] for r in got) == {"few": 50, "many": 200, "more": 200}
    hashes = {r["id"]: r["h"] for r in rows.select("id", F.xxhash64("id", F.lit(7)).alias("h")).collect()}
    many = sorted(hashes[i] for i in range(5000) if i % 2 == 0 and i % 100)
    assert sorted(hashes[r["id"]] for r in got if r["lang"] == "many") == many[:200]
    # in all; repeated ids never exceed the bound
    assert bounded_sample(rows, F.col("id"), 300).count() == 300
    assert bounded_sample(rows.select((F.col("id") % 50).alias("id")), F.col("id"), 450).count() == 400
    assert bounded_sample(rows.limit(0), F.col("id"), 10).count() == 0


def test_rank_distance_against_definition():
    def brute(profiles, text, size):
        own = [g for g, _ in sorted(Counter({int(g): int(n) for g, n in zip(*ngrams(text))}).items(), key=lambda x: (-x[1], x[0]))][:size]
        d = {lang: sum(min(size, abs(p.index(g) - k)) if g in p else size for k, g in enumerate(own)) for lang, p in profiles.items()}
        lang = min(sorted(d), key=d.get)
        return lang, 1 - d[lang] / (size * len(own))

    rng = random.Random(8)
    profiles = {x: [int(g) for g in ngrams("".join(rng.choice("abcd ") for _ in range(200)))[0][:25]] for x in "pq"}
    for _ in range(20):
        t = "".join(rng.choice("abcd ") for _ in range(60))
        (lang, score), (want, want_score) = Profiles(profiles, 25).predict(t), brute(profiles, t, 25)
        assert lang == want and score == pytest.approx(want_score)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(9)
    bad, good = [f"bad{c}" for c in "abcdef"], [f"word{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        w = [rng.choice(good) for _ in range(40)]
        for _ in range(3 * toxic):
            w.insert(rng.randint(0, 40), rng.choice(bad))
        docs.append((i, " ".join(w), "en", 1))
        labels.append((i, int(toxic), 1))
    docs += [(2000, None, "en", 1), (2001, "", None, 1), (None, "bada", "en", 1), (4, docs[4][1], "en", 1), (2002, "x " * 200_000, "en", 1)]
    labels += [(2000, None, 1), (5000, 1, 1)]
    d, y = spark.createDataFrame(docs, "doc_id long, text string, lang string, score int"), spark.createDataFrame(labels, "doc_id long, toxic int, score int")
    got = toxicity(d, y).collect()
    assert len(got) == len(docs)
    hits = [(r["predicted"] == 1) == (r["doc_id"] % 4 == 0) for r in got if r["held_out"] and r["doc_id"] < 900]
    assert np.mean(hits) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["predicted"] == 0 for r in got if r["doc_id"] in (2000, 2001, 2002))
    assert toxicity(d.limit(0), y).count() == 0
    assert toxicity(d, y.limit(0)).where("score >= 0.5").count() == 0


def test_toxicity_learns_from_every_labelled_row(spark):
    rows = spark.range(60_000).selectExpr("id as doc_id", "concat('w', translate(cast(id % 3000 as string), '0123456789', 'abcdefghij')) as text", "'en' as lang", "0 as toxic")
    m = train_on(rows, "doc_id", "text", "lang", "toxic")  # each word is in 20 rows
    assert len(m.embeddings) - 1 > 2950


def test_texts_pooled_together_against_definition():
    rng = np.random.default_rng(9)
    m = untrained(np.full(500, 9), rng.integers(0, 9, 500), 4500, 2000)
    m.biases = [rng.normal(0, 0.1, b.shape).astype(np.float32) for b in m.biases]
    texts = [rng.integers(0, 501, n) for n in (0, 1, 2, 3, 70_000, 0, 5, 300, 1)]  # one goes over a chunk's end
    rows, stops = np.concatenate(texts), np.cumsum([len(t) for t in texts])
    values, places = m.pooled(rows, stops)
    for k, t in enumerate(texts):
        want = []
        for width, w, b in zip(WIDTHS, m.filters, m.biases):
            for f in range(w.shape[2]):
                z = [0.0] if len(t) < width else sum(m.embeddings[t[o : len(t) - width + 1 + o]] @ w[o, :, f] for o in range(width)) + b[f]
                want.append(max(0.0, np.max(z)))
                at = places[len(want) - 1, k]
                assert (at < 0) == (values[len(want) - 1, k] == 0)
                if at >= 0:
                    assert np.isclose(z[at - (stops[k] - len(t))], values[len(want) - 1, k], atol=1e-5)
        assert np.allclose(values[:, k], want, atol=1e-5)
        assert np.isclose(m.raw(t), 1 / (1 + np.exp(-(np.array(want) @ m.weights + m.bias))), atol=1e-5)


def test_toxicity_trained_in_shards(spark):
    rng = random.Random(10)
    good = [f"word{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    docs = [(i, " ".join([rng.choice(good) for _ in range(20)] + [f"bad{rng.choice('abcdef')}"] * (i % 3 == 0)), "en") for i in range(1500)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    rows = d.selectExpr("*", "int(doc_id % 3 = 0) as toxic")
    one, two = (train_on(x, "doc_id", "text", "lang", "toxic", shard_words=5_000) for x in (rows, rows.repartition(7)))
    assert np.array_equal(one.embeddings, two.embeddings) and one.thresholds == two.thresholds and one.bias == two.bias
    many = toxicity(d, rows.select("doc_id", "toxic").union(spark.createDataFrame([(i, 1) for i in range(5000, 9000)], "doc_id long, toxic int")))
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 == 0) for r in many.where("held_out").collect()]) > 0.95


def test_warc_round_trip(spark, tmp_path):
    big, sharp = "<p>é</p>" * 200, "a\r\n\r\nb" * 300
    rows = [(1, "http://a/1", big, 0), (2, "http://a/2", big, 0), (9, "http://a/\r\nX: y", big, 0), (3, "u3", "small", 0), (4, "u4", "small", 0), (5, None, None, 0), (6, "u6", "", 0), (7, "u7", sharp, 0), (8, None, sharp, 0), (None, "n", "x" * 1000, 0), (None, "m", "x" * 1000, 0), (3, "u3", "small", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n int").repartition(3)
    path = f"file://{tmp_path}/archives"
    got = dedup_archives(df, path, per_file=2).collect()
    want = Counter()
    for i, _, html, _ in rows:
        b = (html or "").encode()
        top = max((k for k, _, h, _ in rows if h == html and k is not None), default=None)
        again = len(b) >= 1000 and top is not None and i != top
        want[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    for r in got:
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
    files = sorted((tmp_path / "archives").glob("part-*"))
    heads = [h for f in files for h, _ in parse(f.read_bytes())]
    assert len(heads) == len(rows) and max(sum(1 for _ in parse(f.read_bytes())) for f in files) == 2
    ids = {h["warc-record-id"] for h in heads if h["warc-type"] == "response"}
    assert all(h["warc-refers-to"] in ids for h in heads if h["warc-type"] == "revisit")
    assert dedup_archives(df.limit(0)).count() == 0
    assert resolve_revisits(df, min_bytes=10**6).where("record_type = 'revisit'").count() == 0
