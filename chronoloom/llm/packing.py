"""Packing by minimum bin slack.

The solver needs only how many pieces there are of each length, at most ``capacity``
numbers, however many documents there are. For each sequence it takes the longest piece
left and, by bitset subset-sum dynamic programming over the lengths still available,
the fullest feasible combination with it, which it removes. The next sequences would get
the same combination while all its lengths last, so it is taken as often as they do:
a plan is a list of (combination, times), about as long as there are lengths.

Pieces are numbered among those of equal length, by written (part, length) counts and not
by one big sort, and the plan says which numbers go where.
"""

from __future__ import annotations

import bisect
import re
import string
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TextCache, give_back, only, slices, written

CAPACITY = 4096
_LITTLE = struct.Struct("<I").pack


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum of at most room, longer
    lengths preferred. counts: how many there are of each length."""
    mask, steps, reach = (1 << (room + 1)) - 1, [], 1
    for size in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        steps.append((size, reach))
        left, chunk = min(counts[size], room // size), 1
        while left:
            take = min(chunk, left)
            reach |= (reach << (take * size)) & mask
            left -= take
            chunk *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for size, before in reversed(steps):
        while not before >> at & 1:
            out[size] = out.get(size, 0) + 1
            at -= size
    return out


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(combination, times) until nothing is left."""
    left = {k: n for k, n in counts.items() if n and k > 0}
    plan = []
    while left:
        seed = max(left)
        others = left | {seed: left[seed] - 1}
        use = fullest(others, capacity - seed)
        use[seed] = use.get(seed, 0) + 1
        times = min(left[k] // n for k, n in use.items())
        for k, n in use.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        plan.append((use, times))
    return plan


class Places:
    """Where the r-th piece of a length goes."""

    def __init__(self, plan: list[tuple[dict[int, int], int]]):
        self.rows: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
        first = 0
        for use, times in plan:
            at = 0
            for size in sorted(use, reverse=True):
                begins, blocks = self.rows.setdefault(size, ([0], []))
                blocks.append((first, use[size], at))
                begins.append(begins[-1] + use[size] * times)
                at += use[size] * size
            first += times
        self.sequences = first

    def place(self, size: int, rank: int) -> tuple[int, int]:
        """(sequence, offset)"""
        begins, blocks = self.rows[size]
        k = bisect.bisect_right(begins, rank) - 1
        first, each, at = blocks[k]
        n, slot = divmod(rank - begins[k], each)
        return first + n, at + slot * size


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for
    themselves, the others for the code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class WordTokenizer:
    """ids of texts. by_words: the tokenizer lower-cases, never joins what a space or newline
    parts, and parts letters from ASCII punctuation. Then the text between spaces, and the
    letters and punctuation in it, are encoded once and remembered."""

    def __init__(self, path: str, by_words: bool, most_cached: int = 160_000):
        from tokenizers import Tokenizer

        self.t, self.by_words = Tokenizer.from_file(path), by_words
        self.model, self.letters = self.t.model, _byte_letters()
        self.words = TextCache(self._word, most_cached // 2)
        self.chunks = TextCache(self._chunk, most_cached)
        #: what stands before punctuation, and punctuation; None if the chunk must be encoded whole
        self.bases = TextCache(self._base, most_cached)
        self.plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)").fullmatch

    def _encode(self, text: str) -> bytes:
        return np.array(self.t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """A lower-case word, or punctuation: one piece, so the model can be asked directly."""
        if not word.isascii():
            word = "".join([self.letters[b] for b in word.encode()])
        return b"".join([_LITTLE(x.id) for x in self.model.tokenize(word)])

    def _base(self, base: str) -> bytes | None:
        m = self.plain(base)
        if m and not m[2]:
            return self._word(base if base.islower() else base.lower())
        if not base or base.strip(string.punctuation) or self._encode(base) != self._word(base):
            return b"" if not base else None
        return self._word(base)

    def _chunk(self, chunk: str) -> bytes:
        m = self.plain(chunk)
        if not m or (m[2] and m[2] not in self.words and self._encode(m[2]) != self._word(m[2])):
            return self._encode(chunk)
        return self.words[m[1].lower()] + (self.words[m[2]] if m[2] else b"")

    @staticmethod
    def _spaced(text: str) -> str:
        """The text with chunks parted by spaces alone."""
        try:  # in Latin-1 lower-casing is by letter, as the tokenizer's is
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        return text.replace("\n", " ")

    def encode(self, text: str) -> bytes:
        if not self.by_words:
            return self._encode(text)
        return b"".join(map(self.chunks.__getitem__, filter(None, self._spaced(text).split(" "))))

    def encode_all(self, texts: list[str], together: int = 2_000_000) -> list[bytes]:
        """encode() of each. Texts go in groups of about `together` characters, in which equal
        chunks are looked up once; a group with a much longer text goes one by one, so that
        memory is bounded."""
        out, begin, size = [], 0, 0
        for k, text in enumerate(texts, 1):
            size += len(text)
            if size >= together or k == len(texts):
                group = texts[begin:k]
                out += self._group(group) if self.by_words and size < 4 * together else map(self.encode, group)
                begin, size = k, 0
        return out

    def _group(self, texts: list[str]) -> list[bytes]:
        parts = pc.split_pattern(pa.array(map(self._spaced, texts), pa.string()), " ")
        coded = parts.flatten().dictionary_encode()
        made, words = [], self.bases
        for chunk in coded.dictionary.to_numpy(zero_copy_only=False):
            base = chunk.rstrip(string.punctuation)
            ids = words[base]
            if ids is not None and len(base) < len(chunk):
                marks = words[chunk[len(base) :]]
                ids = None if marks is None else ids + marks
            made.append(self.chunks[chunk] if ids is None else ids)
        sizes = np.fromiter(map(len, made), np.int32, len(made)) // 4
        begins, codes = np.cumsum(sizes, dtype=np.int32) - sizes, coded.indices.to_numpy()
        n = sizes[codes]
        stops = np.concatenate([[0], np.cumsum(n)])
        # where each id of the texts is among those of the different chunks
        at = np.repeat(begins[codes] - stops[:-1].astype(np.int32), n) + np.arange(stops[-1], dtype=np.int32)
        ids = np.frombuffer(b"".join(made), "<u4")[at].tobytes()
        edges = (4 * stops[parts.offsets.to_numpy()]).tolist()
        return [ids[a:b] for a, b in zip(edges, edges[1:])]


@lru_cache(maxsize=4)
def _tokenizer(path: str, by_words: bool, most_cached: int) -> WordTokenizer:
    return WordTokenizer(path, by_words, most_cached)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1, by_words: bool = True, with_ids: bool = True, most_cached: int = 160_000) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset and, with_ids, ids (binary,
    little-endian 32-bit): a sequence is its pieces' ids in the order of offset. path: a
    tokenizers file, at the same place on each executor. end_id follows each document's ids. most_cached: how many words a worker remembers,
    those of over 48 characters left out.

    Only documents of more than capacity ids are cut, into pieces of capacity ids, the
    last one shorter. Null text is empty: end_id alone. Rows with a null or repeated id are
    packed like any others, each for itself. An empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    names = ["id", "piece", "start", "length", "part", "nth", "ids" if with_ids else "ids_crc32"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t, part, seen = _tokenizer(path, by_words, most_cached), TaskContext.get().partitionId(), {}
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            rows = []
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for i, ids in zip(batch.column(0).to_pylist(), t.encode_all(texts)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    n = len(piece) // 4
                    seen[n] = seen.get(n, -1) + 1
                    rows.append((i, k, at // 4, n, part, seen[n], piece if with_ids else zlib.crc32(piece)))
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.binary() if with_ids else pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names)
        for cache in (t.bases, t.chunks, t.words):
            cache.trim()
        give_back()

    given = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    pieces = written(given.mapInArrow(cut, "id long, piece int, start long, length long, part long, nth long, " + ("ids binary" if with_ids else "ids_crc32 long")), "pieces")

    # a row for each part and length: how many of the length are in earlier parts
    parts = written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    before = parts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("part", "length", F.coalesce("before", F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    places = spark.sparkContext.broadcast(Places(minimum_bin_slack(counts, capacity)))  # its size is bounded by capacity, not by documents

    @F.arrow_udf("sequence_id long, offset long")
    def put(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        place = places.value.place
        got = [place(n, r) for n, r in zip(lengths.to_pylist(), ranks.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)], ["sequence_id", "offset"])

    put = put.asNondeterministic()  # else it may be run once for each field
    put_at = pieces.join(before, ["part", "length"]).withColumn("at", put("length", F.col("before") + F.col("nth")))
    return put_at.select(F.col("id").alias(id_col), "piece", "start", "length", F.crc32("ids").alias("ids_crc32") if with_ids else "ids_crc32", "at.sequence_id", "at.offset", *["ids"] * with_ids)
