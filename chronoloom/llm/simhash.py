"""SimHash near-dedup with keys from the Golay code.

Fingerprints within 3 bits of each other are found as follows. Cut into four blocks of 16
bits, two such fingerprints agree in one block at least. The other 48 bits are two halves
of 24, and the 3 errors leave at most one to one of them: so for some block and half, the
block is equal and the half's first 23 bits are at most one bit apart. Words of 23 bits
fall to the codeword of the perfect binary Golay code within distance 3. Two words one
bit apart have a different number of ones modulo 2, so only even words need to carry
the codewords within distance 4 (1 or 6 of them), odd ones their own; two such words then
share a codeword. A key is (block number, block, half, index of the codeword): 28 bits
of content for each of about 25 keys. Rows are joined on keys and verified.

Equal fingerprints are one node. Within a key, links are found by comparing packed
words and come out as a spanning forest, never as all pairs. A key with more than
``most`` fingerprints is cut into blocks; each pair of blocks is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, row_key, slices, written
from .components import stars

#: The generator polynomial of the [23,12,7] code, x^11+x^10+x^6+x^5+x^4+x^2+1 (fixed value).
GENERATOR = 0b110001110101


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits; a bit is 1 if it is set in over half of the shingles' XXH64 (seed 42).

    Words are runs of anything but ASCII white space, A-Z lower-cased. Fewer words than a
    shingle has: one shingle of all of them. None: 0."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxh64_intdigest(b" ".join(parts), 42)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = [0, *(ends[:-words]).tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    h = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 65536):
        bits = np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, with_key: bool = False) -> DataFrame:
    """(id, fp) per row, fp a signed 64-bit integer; with_key also row_key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], ["id", "fp", *batch.schema.names[2:]])

    given = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if with_key:
        given = given.withColumn("row_key", row_key("id", "text"))
    return given.mapInArrow(run, "id long, fp long" + (", row_key long" if with_key else ""))


class Golay:
    """Decoding of arrays of 23-bit words."""

    def __init__(self):
        place = np.arange(1 << 12)
        low, high = place.copy(), place << 11  # remainders of the lower 12 and the upper 12 bits
        self.low, self.high = self._remainders(low), self._remainders(high)
        #: remainder -> the error that gives it, of at most 3 bits
        self.error = np.zeros(1 << 11, np.int64)
        bits = [1 << i for i in range(23)]
        errors = np.array([0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i]), *(a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j])])
        self.error[self._of(errors)] = errors
        #: remainder -> index differences (XOR) from the nearest codeword to those at distance 4
        code = (place << 11) ^ self._of(place << 11)
        sevens = code[np.bitwise_count(code) == 7]
        self.far = np.zeros((1 << 11, 5), np.int64)
        self.n_far = np.zeros(1 << 11, np.int64)
        for e in errors[np.bitwise_count(errors) == 3]:
            s = self._of(e)
            self.far[s] = sevens[sevens & e == e] >> 11
            self.n_far[s] = 5

    @staticmethod
    def _remainders(words: np.ndarray) -> np.ndarray:
        out = words.copy()
        for i in range(22, 10, -1):
            out = np.where(out >> i & 1, out ^ (GENERATOR << (i - 11)), out)
        return out

    def _of(self, words):
        return self.low[words & 0xFFF] ^ self.high[words >> 11 & 0xFFE]

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in words, codeword indices): of odd words the nearest codeword, of even
        ones those within distance 4."""
        s = self._of(words)
        near = (words ^ self.error[s]) >> 11
        more = np.flatnonzero((self.n_far[s] > 0) & (np.bitwise_count(words) % 2 == 0))
        far = near[more, None] ^ self.far[s[more]]
        return np.concatenate([np.arange(len(words)), np.repeat(more, 5)]), np.concatenate([near, far.ravel()])


@lru_cache(maxsize=1)
def golay() -> Golay:
    return Golay()


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in fps, keys); fps of type uint64."""
    where, keys, g = [], [], golay()
    for block in range(4):
        sh = np.uint64(16 * block)
        exact = (fps >> sh & np.uint64(0xFFFF)).astype(np.int64)
        below = fps & ((np.uint64(1) << sh) - np.uint64(1))
        above = (fps >> sh >> np.uint64(16)) << sh
        rest = below | above
        for half in range(2):
            w = (rest >> np.uint64(24 * half) & np.uint64(0x7FFFFF)).astype(np.int64)
            at, index = g.keys(w)
            where.append(at)
            keys.append(((block * 2 + half) << 28) | (exact[at] << 12) | index)
    return np.concatenate(where), np.concatenate(keys)


def forest(left: np.ndarray, right: np.ndarray, distance: int, step: int = 512) -> list[tuple[int, int]]:
    """Links of a spanning forest of what is within distance, among left and right."""
    nodes = np.unique(np.concatenate([left, right]))
    at = {x: i for i, x in enumerate(nodes.tolist())}
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    labels = np.arange(len(nodes))
    li, ri, out = np.searchsorted(nodes, left), np.searchsorted(nodes, right), []
    for k in range(0, len(left), step):
        close = np.bitwise_count(left[k : k + step, None] ^ right[None, :]) <= distance
        close &= labels[li[k : k + step], None] != labels[ri][None, :]
        a, b = np.nonzero(close)
        # of each row and component one link is enough
        _, first = np.unique(a * len(nodes) + labels[ri[b]], return_index=True)
        for x, y in zip(li[k + a[first]].tolist(), ri[b[first]].tolist()):
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                out.append((int(nodes[x]), int(nodes[y])))
        labels = np.array([root(i) for i in range(len(nodes))])
    return out


def _links_in(keys: np.ndarray, sides: np.ndarray, fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links within each key of a batch sorted by key. sides: 1 or 2 for the two blocks of a
    pair of blocks, 0 if a key is whole."""
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    sizes = np.diff(cuts)
    out: list[tuple[int, int]] = []
    small = np.repeat((sizes > 1) & (sizes <= 32), sizes)
    alone = np.flatnonzero(small & (sides == 0))
    k, f = keys[alone], fps[alone]
    gap = 1
    while gap < len(k):
        same = np.flatnonzero(k[gap:] == k[:-gap])
        if not len(same):
            break
        a, b = f[same], f[same + gap]
        ok = (np.bitwise_count(a ^ b) <= distance) & (a != b)
        out += zip(a[ok].tolist(), b[ok].tolist())
        gap += 1
    for i in np.flatnonzero((sizes > 1) & ~((sizes <= 32) & (sides[cuts[:-1]] == 0))):
        lo, hi = cuts[i], cuts[i + 1]
        f, s = np.unique(np.stack([fps[lo:hi], sides[lo:hi].astype(np.uint64)]), axis=1)
        left, right = (f, f) if not s.any() else (f[s == 1], f[s == 2])
        if len(left) and len(right):
            out += forest(left, right, distance)
    return out


def link_fingerprints(fps: DataFrame, distance: int = 3, most: int = 4096) -> DataFrame:
    """Links (a, b) between fingerprints (column fp, each once) that join all those within
    distance (3 at most) of each other into the right components."""
    if not 0 <= distance <= 3:
        raise ValueError("the keys are made for 0 to 3 differing bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(own), 20_000):
                at, keys = fuzzy_keys(own[k : k + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[k : k + 20_000][at].view(np.int64))], ["key", "fp"])

    keyed = written(fps.mapInArrow(spread, "key long, fp long"), "golay-keys")
    sizes = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "golay-sizes")
    large = sizes.where(F.col("n") > most)
    rest = sizes.where(F.col("n") <= most)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(rows: np.ndarray) -> pa.RecordBatch:
            found = _links_in(rows[0], rows[1], rows[2].view(np.uint64), distance)
            ab = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ab[:, 0])), pa.array(np.ascontiguousarray(ab[:, 1]))], ["a", "b"])

        for batch in batches:  # sorted by key; the last key may go on in the next batch
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            rows = np.concatenate([*held, rows], axis=1) if held else rows
            last = np.searchsorted(rows[0], rows[0, -1]) if rows.shape[1] else 0
            held = [rows[:, last:]]
            yield links(rows[:, :last])
        if held:
            yield links(held[0])

    whole = keyed.join(rest.select("key"), "key").select("key", F.lit(0).cast("long").alias("side"), "fp")
    # block i of a key meets itself and each other block j in a group of its own; a fingerprint is in as many groups as there are blocks
    cut = keyed.join(large, "key").withColumn("blocks", F.ceil(F.col("n") / most)).withColumn("i", F.pmod(F.xxhash64("fp"), "blocks")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cut = cut.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2).cast("long").alias("side"), "fp")
    both = whole.union(cut).repartition("key").sortWithinPartitions("key")
    return both.mapInArrow(find, "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3, most: int = 4096) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (the smallest id in the
    component).

    - Null and empty texts have fingerprint zero and are linked like any others.
    - Rows with a null id are linked and counted; component_id is null if no id is there.
    - Repeated rows and ids: each row has its own fingerprint and component.
    - An empty table gives an empty result; other columns are ignored.
    """
    rows = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    return rows.join(_components(rows, distance, most), "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _components(rows: DataFrame, distance: int, most: int) -> DataFrame:
    """(fp, root, component_id) for each fingerprint of rows (id, fp); root is never null."""
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = written(stars(link_fingerprints(nodes.select("fp"), distance, most)), "roots")
    placed = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    placed = written(placed, "placed")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return written(placed.select("fp", "root").join(written(least, "least"), "root").select("fp", "root", "component_id"), "components")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3) -> DataFrame:
    """docs with one row of each component, as by one_of_each()."""
    rows = written(fingerprints(docs, id_col, text_col, words, with_key=True), "fingerprints")
    placed = rows.join(_components(rows, distance, 4096), "fp").select("id", "row_key", F.col("root").alias("component"))
    return one_of_each(docs, placed, id_col, text_col)


def one_of_each(docs: DataFrame, placed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of placed (id, row_key, component for each row):
    that of the smallest id, then of the smallest row_key; null ids come last. Of rows equal in
    id and text one stays. Columns _kept, _kept_row and _row give way."""
    docs = docs.drop("_kept", "_kept_row", "_row")
    rows = placed.groupBy("component", "id", "row_key").agg(F.count(F.lit(1)).alias("times"))
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_key", "times")).alias("best"))
    kept = written(best.select(F.col("best.id").alias("_kept"), F.col("best.row_key").alias("_kept_row"), F.col("best.times").alias("times")), "kept")
    own = F.col(f"`{id_col}`").cast("long")
    left = docs.withColumn("_row", row_key(own, F.col(f"`{text_col}`").cast("string")))
    out = left.join(kept, (F.col("_row") == F.col("_kept_row")) & own.eqNullSafe(F.col("_kept")), "left_semi")
    if kept.where("times > 1").limit(1).count():
        out = out.dropDuplicates(["_row", id_col])
    return out.drop("_row")
