"""Removal of every byte that lies in a repeated string of ``length`` bytes.

1. Each window of ``length`` bytes belongs to its minimizer: of its 32-byte strings, the
   leftmost with the smallest hash. Neighbouring windows with the same minimizer are one
   region. Equal windows have equal minimizers at equal places, wherever they stand, so
   windows need only be compared within a minimizer. A region is a row of hashes.
2. Minimizers that occur once are done. Of the others, each different region is fetched
   from the texts: two of its places, or the only one.
3. Batches of whole minimizers get a suffix order, as deep as ``length``, and a
   Burrows-Wheeler transform. Breadth-first backward extension sets common-prefix values in
   increasing order: the interval of cw, found from that of w, gives the value |w| to the
   boundary behind it, unless that has one. It starts from the intervals of 8 bytes, as
   smaller values follow from the keys that the suffixes were first sorted by, and stops at
   ``length``: boundaries without a value are between suffixes that share that much.
4. A minimizer with more than ``most`` different regions is cut up first: windows in which
   it stands at neighbouring offsets are a part of their region, equal parts become one,
   and parts are compared within those that have the same bytes in all their windows. Where
   that still is too much, offsets are divided further, at last to single windows. Spans of
   parts go back to their regions.
5. The spans found go back to all places of their regions and are cut out of the texts.

In a batch the bytes of a region's two places are compared and it stands in the transform
once, with a weight of 2: each of its windows is repeated, and so is any other that shares
its boundary. Hashes only tell which further places hold the same region: 128 bits beside
the minimizer's 64. Rows are told apart by (row key, id).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from .common import only, row_key, slices, written

GRAM = 32
_SLAB = 1 << 19
_END = 0xFF  # no byte of UTF-8
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_LOW = np.uint64((1 << 24) - 1)


@lru_cache(maxsize=4)
def _tables(n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For both hashes: a number for each byte, powers of the base, and of its inverse."""
    rng, out = np.random.default_rng(11), []
    for base in _BASES:
        row = [rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            row.append(np.multiply.accumulate(p))
        out.append(tuple(row))
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(32)


class Hashes:
    """Hashes of any part of data."""

    def __init__(self, data: np.ndarray, size: int):
        self.sums = []
        for values, powers, inverse in _tables(size):
            s = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(values[data] * powers[: len(data)], out=s[1:])
            self.sums.append((s, inverse))

    def of(self, which: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        s, inverse = self.sums[which]
        return _mix((s[stops] - s[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))


def _sliding_least(keys: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbouring keys."""
    n = len(keys) - w + 1
    blocks = np.full((-(-len(keys) // w), w), ~np.uint64(0))
    blocks.ravel()[: len(keys)] = keys
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def regions(data: np.ndarray, docs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, start, stop, minimizer's hash, two hashes of the region) of each region of joined
    texts; a region's windows start at start, ..., stop - length. docs: where each text begins,
    and the end of the last."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 3
    h = Hashes(data, _SLAB + 8 * length)
    at = np.arange(len(data) - GRAM + 1)
    grams = h.of(0, at, at + GRAM)
    least = _sliding_least(grams & ~_LOW | at.astype(np.uint64), length - GRAM + 1) & _LOW
    n = len(least)
    sound = np.zeros(n + 1, np.int64)
    has = docs[1:] - docs[:-1] >= length
    np.add.at(sound, docs[:-1][has], 1)
    np.add.at(sound, docs[1:][has] - length + 1, -1)
    sound = np.cumsum(sound)[:n] > 0
    joined = np.zeros(n + 1, bool)  # to the window before
    joined[1:n] = sound[1:] & sound[:-1] & (least[1:] == least[:-1])
    starts = np.flatnonzero(sound & ~joined[:n])
    stops = np.flatnonzero(sound & ~joined[1:]) + length
    return np.searchsorted(docs, starts, "right") - 1, starts, stops, grams[least[starts].astype(np.int64)], h.of(1, starts, stops), h.of(0, starts, stops)


def parts(data: np.ndarray, own: int, length: int, block: int) -> tuple[np.ndarray, ...]:
    """(start, stop, key, two hashes) of each part of a region with the key `own`: its windows that
    have the minimizer at an offset in the same block of offsets. All windows of a part hold
    the bytes around the minimizer that make its key."""
    h, w = Hashes(data, _SLAB + 8 * length), length - GRAM + 1
    at = np.arange(w)
    place = int((h.of(0, at, at + GRAM) & ~_LOW | at.astype(np.uint64)).argmin())
    n = len(data) - length + 1
    blocks = (place - np.arange(n)) // block
    cuts = np.flatnonzero(blocks[1:] != blocks[:-1]) + 1
    starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [n]]) - 1 + length
    k = blocks[starts]
    core = h.of(1, place - k * block, place - k * block - block + 1 + length)
    key = _mix(_mix(np.full(len(k), own, np.int64).view(np.uint64)) + core) + k.astype(np.uint64)
    return starts, stops, key, h.of(1, starts, stops), h.of(0, starts, stops)


def _slabs(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(joined bytes, where its parts begin and the end, text of each part, offset of each part
    in its text). Long texts come in overlapping parts, so that each window is in one."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def out():
        data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        return data, np.cumsum([0, *(len(p[2]) for p in parts)]), np.array([p[0] for p in parts]), np.array([p[1] for p in parts])

    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), _SLAB // 2):
            part = t[at : at + _SLAB // 2 + length - 1]
            if len(part) < length:
                continue
            if size + len(part) > _SLAB:
                yield out()
                parts, size = [], 0
            parts.append((k, at, part))
            size += len(part)
    if parts:
        yield out()


def _heads(data: np.ndarray) -> np.ndarray:
    """The first 8 bytes of each suffix as a number."""
    n = len(data)
    padded = np.concatenate([data, np.full(8, _END, np.uint8)])
    return sum(padded[j : j + n].astype(np.uint64) << np.uint64(8 * (7 - j)) for j in range(8))


def suffix_order(data: np.ndarray, depth: int, heads: np.ndarray | None = None) -> np.ndarray:
    """Positions by the first depth bytes or more of their suffixes."""
    n = len(data)
    keys = _heads(data) if heads is None else heads
    order = np.argsort(keys)
    keys = keys[order]
    places = np.arange(n)  # of order, those that aren't settled
    ranks, known, bits = np.empty(n, np.int64), 8, n.bit_length()
    while True:  # a rank is the first place of those that are still alike
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        ranks[order[places]] = np.maximum.accumulate(np.where(new, places, 0))
        alike = ~new
        alike[:-1] |= ~new[1:]
        places = places[alike]
        if known >= depth or not len(places):
            return order
        at = order[places]
        later = np.full(len(at), n, np.int64)  # past the end: behind all others, as the padding is
        inside = at + known < n
        later[inside] = ranks[at[inside] + known]
        keys = ranks[at] << bits | later
        if 3 * bits < 64:  # numbers alone are sorted several times faster than their places
            keys = np.sort(keys << bits | np.arange(len(at)))
            by, keys = keys & ((1 << bits) - 1), keys >> bits
        else:
            by = np.argsort(keys)
            keys = keys[by]
        order[places] = at[by]
        known *= 2


def common_prefixes(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, for each place in it whether it shares length bytes with the one before)."""
    n, known = len(data), min(8, length)
    heads = _heads(data)
    order = suffix_order(data, length, heads)
    bwt = data[order - 1]
    back = np.empty(n, np.int64)  # place of the suffix that is longer by the symbol in bwt
    back[np.argsort(bwt, kind="stable")] = np.arange(n)
    is_set = np.zeros(n + 1, bool)
    is_set[[0, n]] = True
    # what shares less than the heads, and the intervals of heads that share all but the last byte with the next one
    heads = heads[order] >> np.uint64(8 * (8 - known))
    edges = np.flatnonzero(heads[1:] != heads[:-1]) + 1
    is_set[edges] = True
    lo, hi, heads = np.concatenate([[0], edges[:-1]])[: len(edges)], edges, (heads[edges - 1], heads[edges])
    near = heads[0] >> np.uint64(8) == heads[1] >> np.uint64(8)
    for j in range(known):  # strings go over no text's end
        near &= heads[0] >> np.uint64(8 * j) & np.uint64(255) != _END
    lo, hi = lo[near], hi[near]
    bits = np.int64(n.bit_length())
    for _ in range(known, length):  # intervals of w become those of cw, whose boundary gets the value |w|
        sizes = hi - lo
        # an interval of one suffix goes on to one interval
        one = lo[sizes == 1]
        one = back[one[bwt[one] != _END]]
        lo, sizes = lo[sizes > 1], sizes[sizes > 1]
        which = np.repeat(np.arange(len(lo)), sizes)
        at = np.arange(len(which)) + np.repeat(lo - np.cumsum(sizes) + sizes, sizes)
        symbols = bwt[at]
        inner = symbols != _END
        # by interval, symbol and place: the first and last place of a symbol give its interval
        keys = np.sort((which[inner] << 8 | symbols[inner]) << bits | at[inner])
        group, at = keys >> bits, keys & ((1 << int(bits)) - 1)
        cut = np.flatnonzero(group[1:] != group[:-1]) + 1
        begins, ends = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(at) - 1]])
        if not len(at):
            begins = ends = cut
        new_lo, new_hi = np.concatenate([one, back[at[begins]]]), np.concatenate([one, back[at[ends]]]) + 1
        fresh = ~is_set[new_hi]
        lo, hi = new_lo[fresh], new_hi[fresh]
        is_set[hi] = True
        if not len(lo):
            break
    return order, ~is_set[:n]


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, the starts of its windows of length bytes that occur more than once in
    all of texts."""
    data = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    if not len(data):
        return [np.zeros(0, np.int64) for _ in texts]
    order, shares = common_prefixes(data, length)
    both = np.flatnonzero(shares)
    repeated = np.zeros(len(data), bool)
    repeated[order[both]] = repeated[order[both - 1]] = True
    starts = np.flatnonzero(repeated)
    text = np.searchsorted(begins, starts, "right") - 1
    inside = starts + length <= begins[text + 1] - 1
    starts, text = starts[inside], text[inside]
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    return [starts[cuts[k] : cuts[k + 1]] - begins[k] for k in range(len(texts))]


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The spans that windows at these sorted starts cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return [(int(a), int(b) + length) for a, b in zip(starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])])]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans joined where they overlap or touch, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@F.arrow_udf(BinaryType())
def _squeeze(texts: pa.Array) -> pa.Array:
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    return pa.array([z.compress((t.as_py() or "").encode()) for t in texts], pa.binary())


def _unsqueeze(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(b)


_NAMES = ["gram", "region", "more", "copy", "bytes"]
_SAME = ["gram", "region", "more"]
_SPANS = "array<struct<start:long,stop:long>>"
#: Sizes of the blocks of offsets by which large minimizers are cut up.
_BLOCKS = (64, 16, 4, 1)


def _compared(items: DataFrame, length: int) -> DataFrame:
    """(gram, region, more, spans): where windows occur more than once within a minimizer. items:
    the bytes of each different region, those of two places where it has several. A
    minimizer's items are few enough for one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, bytes]] = []
        twice: set[int] = set()
        size = 0

        def solve() -> pa.RecordBatch:
            out = []
            for k, (x, w) in enumerate(zip(held, repeated_windows([x[4] for x in held], length))):
                runs = [(0, len(x[4]))] if k in twice else _runs(w, length)
                if runs and not x[3]:
                    out.append((*x[:3], [{"start": a, "stop": b} for a, b in runs]))
            types = [*[pa.int64()] * 3, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, types)], [*_SAME, "spans"])

        for batch in slices(batches, 2048):
            for row in zip(*(batch.column(c).to_pylist() for c in _NAMES)):
                if size >= _SLAB and row[0] != held[-1][0]:  # whole minimizers
                    yield solve()
                    held.clear()
                    twice.clear()
                    size = 0
                if held and held[-1][:3] == row[:3] and held[-1][4] == row[4]:
                    if row[3] != held[-1][3]:  # else a repeated row's, fetched twice
                        twice.add(len(held) - 1)
                    continue
                held.append(row)
                size += len(row[4])
        if held:
            yield solve()

    return items.select(*_NAMES).repartition("gram").sortWithinPartitions("gram", "region", "more", "copy").mapInArrow(run, f"gram long, region long, more long, spans {_SPANS}")


def _compared_in_parts(items: DataFrame, length: int, most: int, level: int = 0) -> DataFrame:
    """The same for minimizers with any number of items."""
    out = "key long, part long, also long, at long, gram long, region long, more long, copy int, bytes binary"
    names = [x.split()[0] for x in out.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for gram, region, more, copy, b in zip(*(batch.column(c).to_pylist() for c in _NAMES)):
                starts, stops, key, part, also = parts(np.frombuffer(b, np.uint8), gram, length, _BLOCKS[level])
                rows = [pa.array([x] * len(starts), t) for x, t in ((gram, pa.int64()), (region, pa.int64()), (more, pa.int64()), (copy, pa.int32()))]
                hashes = [pa.array(x.view(np.int64)) for x in (key, part, also)]
                yield pa.RecordBatch.from_arrays([*hashes, pa.array(starts), *rows, pa.array([b[i:j] for i, j in zip(starts.tolist(), stops.tolist())], pa.binary())], names)

    same = ["key", "part", "also"]
    links = written(items.select(*_NAMES).mapInArrow(cut, out), "parts")
    row = F.struct("gram", "region", "more", "copy", "at", "bytes")
    # equal parts meet before the exchange, however many there are
    different = links.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("one"), F.max(row).alias("other"))
    different = written(different.select(F.col("key").alias("gram"), F.col("part").alias("region"), F.col("also").alias("more"), "n", F.col("one.bytes").alias("one"), F.col("other.bytes").alias("other")), "different-parts")
    mine = different.select(*_SAME, F.posexplode(_places()).alias("copy", "bytes"))
    large = None if level + 1 == len(_BLOCKS) else _large(different, most)
    if large is None or not large.limit(1).count():
        found = _compared(mine, length)
    else:
        found = _compared(mine.join(large, "gram", "left_anti"), length).union(_compared_in_parts(mine.join(large, "gram", "left_semi"), length, most, level + 1))
    spans = written(found, "part-spans").select(F.col("gram").alias("key"), F.col("region").alias("part"), F.col("more").alias("also"), "spans")
    back = links.where("copy = 0").select(*same, *_SAME, "at").join(spans, same)
    return back.groupBy(*_SAME).agg(F.flatten(F.collect_list(_moved("spans", "at"))).alias("spans"))


def _places() -> Column:
    """Of columns n, one and other: both, or the only one."""
    return F.when(F.col("n") > 1, F.array("one", "other")).otherwise(F.array("one"))


def _moved(spans: str, by: str) -> Column:
    return F.transform(spans, lambda s: F.struct((s["start"] + F.col(by)).alias("start"), (s["stop"] + F.col(by)).alias("stop")))


def _large(different: DataFrame, most: int) -> DataFrame:
    """Minimizers with more than `most` different regions."""
    return written(different.groupBy("gram").agg(F.count(F.lit(1)).alias("items")).where(F.col("items") > most).select("gram"), "large-minimizers")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, most: int = 1024) -> DataFrame:
    """(key, id, spans) for each row with bytes to remove; spans may overlap."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    base = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).withColumn("key", row_key("id", "text"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            for data, docs_at, text, offset in _slabs(texts, length):
                part, start, stop, *hashes = regions(data, docs_at, length)
                shift = offset[part] - docs_at[part]
                row = pa.array(text[part])
                yield pa.RecordBatch.from_arrays([*(pa.array(h.view(np.int64)) for h in hashes), batch.column("key").take(row), batch.column("id").take(row), pa.array(start + shift), pa.array(stop + shift)], [*_SAME, "key", "id", "start", "stop"])

    places = written(base.mapInArrow(spread, "gram long, region long, more long, key long, id long, start long, stop long"), "regions")
    shared = written(places.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "shared-minimizers")
    found = written(places.join(shared, "gram"), "shared-regions")

    row = F.struct("key", "id", "start", "stop")
    different = written(found.groupBy(*_SAME).agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("one"), F.max(row).alias("other")), "different-regions")
    large = _large(different, most)
    asked = different.join(large.withColumn("large", F.lit(True)), "gram", "left").select(*_SAME, F.coalesce("large", F.lit(False)).alias("large"), F.posexplode(_places()).alias("copy", "at"))
    wanted = asked.groupBy("at.key", "at.id").agg(F.collect_list(F.struct(*_SAME, "copy", "large", "at.start", "at.stop")).alias("parts"))
    wanted = written(wanted, "wanted-regions").withColumnsRenamed({"key": "w_key", "id": "w_id"})
    holding = base.select("key", "id", _squeeze("text").alias("z")).join(wanted, (F.col("key") == F.col("w_key")) & F.col("id").eqNullSafe(F.col("w_id")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (*[pa.int64()] * 3, pa.int32(), pa.bool_(), pa.binary())
        for batch in slices(batches):
            done: set = set()
            for key, id_, z, wants in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "z", "parts"))):
                if (key, id_) in done:  # a repeated row
                    continue
                done.add((key, id_))
                text = _unsqueeze(z)
                rows = [(p["gram"], p["region"], p["more"], p["copy"], p["large"], text[p["start"] : p["stop"]]) for p in wants]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [*_SAME, "copy", "large", "bytes"])

    fetched = written(holding.select("key", "id", "z", "parts").mapInArrow(cut, "gram long, region long, more long, copy int, large boolean, bytes binary"), "region-texts")
    spans = _compared(fetched.where("not large"), length)
    if large.limit(1).count():
        # a repeated row's regions may be fetched twice
        once = fetched.where("large").dropDuplicates([*_SAME, "copy"])
        spans = spans.union(_compared_in_parts(once, length, most))
    here = found.join(written(spans, "region-spans"), _SAME).select("key", "id", _moved("spans", "start").alias("spans"))
    return here.groupBy("key", "id").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, most: int = 1024, as_string: bool = False) -> DataFrame:
    """docs and kept (binary: the UTF-8 bytes that stay), n_bytes, spans (start, stop of each
    maximal run that was removed). as_string: kept is text, without parts of a character that
    was cut. Columns of docs with these names, or with those used
    inside (_key, _z, _m_key, _m_id, _spans, _c), give way.

    - Null text is empty: nothing is removed. Texts shorter than length lose nothing.
    - Strings are judged on the input: all places of a repeated string go, those in the same
      text and in repeated rows included. Matches never cross texts.
    - Rows with the same id and different texts are separate; a null id is like any other.
    - An empty table gives an empty result.
    """
    docs = docs.drop("kept", "n_bytes", "spans", "_key", "_z", "_m_key", "_m_id", "_spans", "_c")
    marks = written(repeated_spans(docs, id_col, text_col, length, most), "removed-spans").select(F.col("key").alias("_m_key"), F.col("id").alias("_m_id"), F.col("spans").alias("_spans"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    id_ = F.col(f"`{id_col}`").cast("long")

    @F.arrow_udf(f"kept {'string' if as_string else 'binary'}, n_bytes long, spans array<struct<start:long,stop:long>>")
    def cut(zs: pa.Array, spans: pa.Array) -> pa.Array:
        kept, sizes, runs = [], [], []
        for z, found in zip(zs, spans):
            b = _unsqueeze(z.as_py())
            gone = merge([(s["start"], s["stop"]) for s in found.as_py() or ()])
            edges = [0, *(x for s in gone for x in s), len(b)]
            stays = b"".join(b[x:y] for x, y in zip(edges[::2], edges[1::2]))
            kept.append(stays.decode("utf-8", "ignore") if as_string else stays)
            sizes.append(len(b))
            runs.append([{"start": x, "stop": y} for x, y in gone])
        run = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(kept, pa.string() if as_string else pa.binary()), pa.array(sizes, pa.int64()), pa.array(runs, run)], ["kept", "n_bytes", "spans"])

    cut = cut.asNondeterministic()  # else it may be run once for each field
    small = docs.withColumns({"_key": row_key(id_, text), "_z": _squeeze(text)})
    names = [c for c in docs.columns if c != text_col]
    both = small.select(*[F.col(f"`{c}`") for c in names], "_key", "_z").join(marks, (F.col("_key") == F.col("_m_key")) & id_.eqNullSafe(F.col("_m_id")), "left")
    return both.withColumn("_c", cut("_z", "_spans")).select(*[F.col(f"`{c}`") for c in names], "_c.kept", "_c.n_bytes", "_c.spans")


@F.arrow_udf(StringType())
def as_text(kept: pa.Array) -> pa.Array:
    """Bytes that stay, as text; parts of a character that was cut go too."""
    return pa.array([None if (b := x.as_py()) is None else b.decode("utf-8", "ignore") for x in kept], pa.string())
