"""Near duplicates by the real similarity of their shingles: candidates by fingerprints and
MinHash, each verified.

1. Texts of the same words (A-Z lower-cased) are one node.
2. Candidates: nodes whose 64-bit fingerprints are within 3 bits (Golay keys, simhash.py), and
   nodes that share one of 40 keys of 6 MinHashes. A pair of similarity 0.8 shares none with a
   chance of 5 in a million, a closer one with less.
3. Each node of a key of the first two bands is compared with the key's smallest one by their
   whole sets of shingles, which links large groups in about as many comparisons as they have
   members. Then the nodes of a key that aren't in the same component yet meet in a task,
   with their sets, in blocks. Of the pairs that agree in so many of 240 MinHashes (a byte of
   each) that 0.8 is possible, but for 5 in a million again, the most alike are compared
   first, and those that have come into one component meanwhile aren't. A pair that shares
   several keys is compared in the first alone. Only links come out, as a spanning forest.
4. Links of at least the asked similarity give the components.

Only sets of nodes that have a candidate are ever shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, row_key, slices, written
from .components import stars
from .simhash import fingerprint, link_fingerprints, one_of_each

BANDS, HASHES, EARLY = 40, 6, 2
_random = np.random.default_rng(20)
_FACTORS = _random.integers(0, 1 << 63, BANDS * HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _random.integers(0, 1 << 63, BANDS * HASHES, dtype=np.uint64)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted XXH64 of the different shingles; of no words: none. Words are split as by
    simhash.fingerprint()."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) <= words:
        return np.array([xxh64_intdigest(b" ".join(parts))], np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = [0, *(ends[:-words]).tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b]) for a, b in zip(starts, stops)), np.uint64, len(starts)))


def node_of(text: str | None) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(b" ".join((text or "").encode().lower().split()))


def minhash(found: np.ndarray) -> tuple[list[int], bytes]:
    """(a signed 64-bit key for each band, a byte of each MinHash); of no shingles: none."""
    from xxhash import xxh64_intdigest

    if not len(found):
        return [], b""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), 512):
        least = np.minimum(least, (found[None, k : k + 512] * _FACTORS[:, None] + _TERMS[:, None]).min(1))
    raw, size = least.tobytes(), 8 * HASHES
    keys = np.array([xxh64_intdigest(raw[i * size : (i + 1) * size], i) for i in range(BANDS)], np.uint64).view(np.int64).tolist()
    return keys, ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def alike(left: np.ndarray, right: np.ndarray, fewest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of left, rows of right, number of bytes in which they agree) of those that agree in
    at least the fewest."""
    found = [(np.zeros(0, np.int64),) * 3]
    for k in range(0, len(left), 32):
        same = (left[k : k + 32, None, :] == right[None, :, :]).sum(2)
        a, b = np.nonzero(same >= fewest)
        found.append((a + k, b, same[a, b]))
    return tuple(np.concatenate(x) for x in zip(*found))


def fewest_alike(similarity: float, chance: float = 5e-6) -> int:
    """In how many MinHashes a pair of this similarity agrees at least, but for the chance."""
    total, count = 0.0, BANDS * HASHES
    for k in range(count + 1):
        total += math.comb(count, k) * similarity**k * (1 - similarity) ** (count - k)
        if total > chance:
            return k
    return count


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    given = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return given.withColumn("row_key", row_key("id", "text"))


def _rows(given: DataFrame, words: int) -> DataFrame:
    """(id, row_key, node, n, fp, keys, sketch) for each row; n is the number of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            sets = [shingles(t, words) for t in texts]
            fps = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            keys, sketches = zip(*map(minhash, sets)) if sets else ((), ())
            columns = [batch.column(0), batch.column(2), pa.array(map(node_of, texts), pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array(fps), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "row_key", "node", "n", "fp", "keys", "sketch"])

    return given.select("id", "text", "row_key").mapInArrow(run, "id long, row_key long, node binary, n long, fp long, keys array<long>, sketch binary")


def _sets(given: DataFrame, words: int) -> DataFrame:
    """(node, hashes) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(map(node_of, texts), pa.binary()), pa.array((shingles(t, words).tobytes() for t in texts), pa.binary())], ["node", "hashes"])

    return given.select("text").mapInArrow(run, "node binary, hashes binary")


def _sets_of(asked: DataFrame, rows: DataFrame, given: DataFrame, words: int) -> DataFrame:
    """(node, hashes) for each node asked for."""
    # one row of each node is enough; a row's key may stand for other rows too, so nodes are made again
    some = rows.join(asked, "node").groupBy("node").agg(F.min("row_key").alias("row_key")).select("row_key").distinct()
    sets = _sets(given.join(written(some, "near-asked"), "row_key", "left_semi"), words)
    return written(sets.dropDuplicates(["node"]), "near-sets")


def _verified(pairs: DataFrame, rows: DataFrame, given: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b), each once, whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [[np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist()] for i in (2, 3)]
            good = pa.array([jaccard(x, y) >= similarity for x, y in zip(*sets)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(good)

    sets = _sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), rows, given, words)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return written(both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary"), "near-links")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Per row: id, row_key, component (the smallest node of texts linked by similarity).

    - Null, empty and white texts are one node; texts of fewer words than a shingle has are
      one shingle.
    - Repeated rows and ids, null ids: each row has its own component.
    - An empty table gives an empty result; other columns are ignored.
    """
    given = _given(docs, id_col, text_col)
    rows = written(_rows(given, words), "near-rows")
    nodes = rows.groupBy("node").agg(F.min("n").alias("n"), F.min("fp").alias("fp"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    nodes = written(nodes, "near-nodes")
    near = F.least("n", "m") >= similarity * F.greatest("n", "m")

    # fingerprints: each node of one with its smallest node, and the smallest nodes of linked ones
    of_fp = written(nodes.where("n > 0").groupBy("fp").agg(F.min(F.struct("node", "n")).alias("least")).select("fp", F.col("least.node").alias("least"), F.col("least.n").alias("m")), "near-fps")
    same = nodes.join(of_fp, "fp").where((F.col("node") != F.col("least")) & near).select(F.col("least").alias("a"), F.col("node").alias("b"))
    close = link_fingerprints(of_fp.select("fp")).join(of_fp.select(F.col("fp").alias("a"), F.col("least").alias("u"), F.col("m").alias("n")), "a").join(of_fp.select(F.col("fp").alias("b"), F.col("least").alias("v"), "m"), "b")
    close = close.where(near).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))

    keyed = nodes.select("node", "n", F.posexplode("keys").alias("band", "key"))
    least = keyed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("least"), F.count(F.lit(1)).alias("members")).where("members > 1")
    least = written(least.select("key", F.col("least.node").alias("least"), F.col("least.n").alias("m")), "near-keys")
    keyed = written(keyed.join(least, "key"), "near-keyed")
    early = keyed.where((F.col("band") < EARLY) & (F.col("node") != F.col("least")) & near).select(F.col("least").alias("a"), F.col("node").alias("b"))
    first = written(early.union(same).union(close).distinct(), "near-pairs")
    links = _verified(first, rows, given, words, similarity)

    # whatever shares a key and isn't joined yet
    open_ = _open(keyed, links)
    sets = _sets_of(open_.select("node").distinct(), rows, given, words)
    met = open_.join(nodes.select("node", "sketch", "keys").join(sets, "node"), "node")
    links = links.union(written(_across(met, similarity), "near-links"))
    roots = written(stars(links), "near-roots")
    return rows.join(roots, "node", "left").select("id", "row_key", F.coalesce("root", "node").alias("component"))


def _across(rows: DataFrame, similarity: float, most: int = 256) -> DataFrame:
    """Links (a, b) that join all similar nodes of a key that have different roots. rows: (key,
    band, node, n, root, sketch, keys, hashes). Nodes of a key with more than most come in
    blocks; each pair of blocks is a group of its own."""
    names = ["key", "side", "band", "node", "n", "root", "sketch", "keys", "hashes"]
    fewest = fewest_alike(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def solve() -> pa.RecordBatch:
            _, sides, (band, *_), nodes, n, roots, sketches, keys, hashes = map(list, zip(*held))
            sides, n, keys = np.array(sides), np.array(n, np.float64), np.array(keys, np.int64)
            names_, root = np.unique(np.array([r.hex() for r in roots]), return_inverse=True)
            sketches = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(held), -1)
            li, ri = (np.flatnonzero(sides != x) for x in (2, 1))
            i, j, same = alike(sketches[li], sketches[ri], fewest)
            i, j = li[i], ri[j]
            good = (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])) & ((i < j) | (sides[i] > 0))
            at = np.flatnonzero(good)
            at = np.concatenate([part[(keys[i[part]] == keys[j[part]]).argmax(1) == band] for part in np.split(at, range(4096, len(at), 4096))])
            parent, links = list(range(len(names_))), []

            def top(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for k in at[np.argsort(-same[at], kind="stable")].tolist():
                x, y = top(root[i[k]]), top(root[j[k]])
                if x != y and jaccard(*(np.frombuffer(hashes[m], np.uint64) for m in (i[k], j[k]))) >= similarity:
                    parent[x] = y
                    links.append((nodes[i[k]], nodes[j[k]]))
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.binary()) for k in (0, 1)], ["a", "b"])

        for batch in slices(batches, 128):
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if held and held[-1][0] != row[0]:
                    yield solve()
                    held.clear()
                held.append(row)
        if held:
            yield solve()

    sizes = written(rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / most).alias("blocks")), "near-sizes")
    cut = rows.join(sizes, "key").withColumn("i", F.pmod(F.xxhash64("node"), "blocks")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    side = F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2).alias("side")
    cut = cut.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), side, *names[2:])
    return cut.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a binary, b binary")


def _open(keyed: DataFrame, links: DataFrame) -> DataFrame:
    """(key, band, node, n, root) of the keys in which several components meet."""
    roots = written(stars(links), "near-roots")
    placed = written(keyed.select("key", "band", "node", "n").join(roots, "node", "left").select("key", "band", "node", "n", F.coalesce("root", "node").alias("root")), "near-placed")
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return written(placed.join(written(mixed, "near-mixed"), "key"), "near-open")


def keep_near_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each component, as by simhash.one_of_each()."""
    return one_of_each(docs, near_components(docs, id_col, text_col, words, similarity), id_col, text_col)
