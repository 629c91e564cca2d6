"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece's bytes there is at most one token that can end its BPE
encoding; ``last[i]`` stores it for the prefix of i bytes. A token t ending at i is that
token if the prefix before it is encoded validly and its own last token does not merge
with t. So the encoding of every prefix is known at once: bytes can be appended with
exact results, and after an edit only prefixes near it are done again. Many pieces are
encoded together: each step appends a byte to the tables of all of them (``Together``).
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TextCache, only, slices


class Vocabulary:
    """Ranks of byte strings, lower rank merging first, and what follows from them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: b for b, r in ranks.items()}
        #: (left << 20 | right) -> apart(left, right), for pairs met so far
        self.known: dict[int, bool] = {}
        #: first bytes -> their table and the tokens still open
        self.stems: dict[bytes, tuple[list[int], list[int]]] = {}
        self.longest = max(map(len, ranks), default=0)
        #: token -> the two tokens that it was merged from; itself twice if it is one byte
        self.parts: dict[int, tuple[int, int]] = {}
        #: the two tokens -> token
        self.merges: dict[tuple[int, int], int] = {}
        #: tokens that BPE never makes
        self.unreached: set[int] = set()
        for r, b in sorted(self.tokens.items()):
            halves = self._halves(b, r)
            if len(b) == 1:
                self.parts[r] = (r, r)
            elif halves is None:
                self.unreached.add(r)
            else:
                self.parts[r] = halves
                self.merges[halves] = r
        #: the byte strings that can stand in an encoding
        usable = {b: r for b, r in ranks.items() if r not in self.unreached}
        #: a trie of them: (node << 8 | byte) -> node, and the nodes' tokens, -1 for none
        self.steps: dict[int, int] = {}
        self.ends = [-1]
        for b, r in usable.items():
            node = 0
            for x in b:
                at = node << 8 | x
                if (after := self.steps.get(at)) is None:
                    after = self.steps[at] = len(self.ends)
                    self.ends.append(-1)
                node = after
            self.ends[node] = r

    @classmethod
    def read(cls, path: str) -> "Vocabulary":
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def _halves(self, b: bytes, below: int) -> tuple[int, int] | None:
        """What b is before its last merge, from merges of a rank lower than its own."""
        parts = [self.ranks.get(b[i : i + 1], -1) for i in range(len(b))]
        while len(parts) > 2:
            found = [(self.merges.get(p, below), i) for i, p in enumerate(zip(parts, parts[1:]))]
            rank, at = min(found)
            if rank >= below:
                return None
            parts[at : at + 2] = [rank]
        return tuple(parts) if len(parts) == 2 and -1 not in parts else None

    def apart(self, left: int, right: int) -> bool:
        """Whether BPE keeps a boundary between these two tokens when both stand alone.

        Undoes the merges of both sides from the latest: at each time, the tokens that
        touch the boundary must not have been merged across it any earlier."""
        limit = 1 << 62
        while True:
            across = self.merges.get((left, right), limit)
            if across < limit:
                return False
            # the later of the two was made last: what stood there before it?
            if left > right:
                limit, left = left, self.parts[left][1]
                if left == limit:
                    limit, right = right + 1, self.parts[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, self.parts[right][0]
                if right + 1 == limit:
                    limit, left = left, self.parts[left][1]
                    if left == limit:
                        return True


    def extend(self, data: bytes, begin: int, end: int, last: list[int], open_: list[int]) -> list[int]:
        """Appends to last the entries of the prefixes of begin + 1 to end bytes. open_: the tokens
        begun before begin that may end later, each as start << 24 | node of the trie; those
        of end are returned, so that more bytes can follow at any time."""
        steps, ends, known = self.steps.get, self.ends, self.known
        for i in range(begin, end):
            byte, found, still = data[i], -1, []
            if last[i] >= 0 or not i:
                open_.append(i << 24)
            for at in open_:
                if (node := steps((at & 0xFFFFFF) << 8 | byte)) is None:
                    continue
                start = at >> 24
                still.append(start << 24 | node)
                if found < 0 and (t := ends[node]) >= 0:
                    if not start:
                        found = t
                        continue
                    pair = last[start] << 20 | t
                    if (ok := known.get(pair)) is None:
                        if len(known) >= 500_000:
                            known.clear()
                        ok = known[pair] = self.apart(last[start], t)
                    if ok:
                        found = t
            open_ = still
            last.append(found)
        return open_

    def split(self, data: bytes, last: list[int]) -> list[int]:
        """The tokens of data, from its table."""
        i, out = len(data), []
        while i:
            t = last[i]
            if t < 0:
                raise ValueError("bytes that the vocabulary can't encode")
            out.append(t)
            i -= len(self.tokens[t])
        return out[::-1]

    def encode(self, data: bytes, stem: int = 6) -> list[int]:
        """The tokens of data. Tables of its first bytes are shared with other data."""
        if len(data) <= stem:
            last = [-1]
            self.extend(data, 0, len(data), last, [])
            return self.split(data, last)
        if (known := self.stems.get(data[:stem])) is None:
            if len(self.stems) >= 100_000:
                self.stems.clear()
            last = [-1]
            known = self.stems[data[:stem]] = (last, self.extend(data, 0, stem, last, []))
        last = known[0][:]
        self.extend(data, stem, len(data), last, known[1][:])
        return self.split(data, last)


class _Map:
    """Fixed integers to integers, looked up by arrays; -1 where a key is missing."""

    def __init__(self, given: dict[int, int]):
        keys, values = (np.fromiter(x, np.int64, len(given)) for x in (given.keys(), given.values()))
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        at = self._place(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of those for one place, one stays
            held = self.keys[at] == keys
            self.values[at[held]] = values[held]
            keys, values, at = keys[~held], values[~held], (at[~held] + 1) & (len(self.keys) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


class Together:
    """The tables of many pieces, one step for a byte of each."""

    def __init__(self, v: Vocabulary):
        n = max(v.tokens, default=-1) + 1
        self.steps, self.merges = _Map(v.steps), _Map({a << 20 | b: t for (a, b), t in v.merges.items()})
        self.ends = np.array(v.ends)
        self.sizes, self.left, self.right = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
        for t, b in v.tokens.items():
            self.sizes[t] = len(b)
        for t, (a, b) in v.parts.items():
            self.left[t], self.right[t] = a, b
        #: pairs of tokens met lately, and whether they stay apart
        self.pairs, self.verdicts = np.full(1 << 18, -1, np.int64), np.zeros(1 << 18, bool)

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """As Vocabulary.apart."""
        out = np.ones(len(left), bool)
        which, limit = np.arange(len(left)), np.full(len(left), 1 << 62)
        while len(which):
            across = self.merges(left << 20 | right)
            joined = (across >= 0) & (across < limit)
            out[which[joined]] = False
            which, left, right = which[~joined], left[~joined], right[~joined]
            inner, outer = self.right[left], self.left[right]
            # the later of the two is undone; the other one where that is a byte
            of_left, byte_left, byte_right = left > right, inner == left, outer == right
            by_left = np.where(of_left, ~byte_left, byte_right)
            more = ~(byte_left & byte_right)
            limit = np.where(by_left, left, right + 1)
            left, right = np.where(by_left, inner, left), np.where(by_left, right, outer)
            which, left, right, limit = which[more], left[more], right[more], limit[more]
        return out

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left << 20 | right
        at = (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int64)
        out = self.verdicts[at]
        new = np.flatnonzero(self.pairs[at] != pairs)
        if len(new):
            which, back = np.unique(pairs[new], return_inverse=True)
            found = self._apart(which >> 20, which & ((1 << 20) - 1))
            out[new] = found[back]
            place, first = np.unique(at[new], return_index=True)
            self.pairs[place], self.verdicts[place] = pairs[new[first]], out[new[first]]
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Of each the ids, as little-endian 32-bit integers."""
        if not pieces:
            return []
        sizes = np.array([len(x) for x in pieces])
        order = np.argsort(-sizes, kind="stable")  # those that go on stand first
        longest, sizes = int(sizes.max()), sizes[order]
        data = np.frombuffer(b"".join([pieces[k].ljust(longest, b"\0") for k in order.tolist()]), np.uint8).reshape(len(pieces), longest).T.copy()
        last = np.full((longest + 1, len(pieces)), -1)
        who, start, node = (np.zeros(0, np.int64) for _ in range(3))
        for i in range(longest):
            n = int(np.searchsorted(-sizes, -i))  # are longer than i
            new = np.flatnonzero(last[i, :n] >= 0) if i else np.arange(n)
            going = who < n
            who = np.concatenate([who[going], new])
            start = np.concatenate([start[going], np.full(len(new), i)])
            node = np.concatenate([node[going], np.zeros(len(new), np.int64)])
            node = self.steps(node << 8 | data[i, who])
            going = node >= 0
            who, start, node = who[going], start[going], node[going]
            token = self.ends[node]
            ends = np.flatnonzero(token >= 0)
            w, s, t = who[ends], start[ends], token[ends]
            fits = s == 0
            rest = np.flatnonzero(~fits)
            fits[rest] = self.apart(last[s[rest], w[rest]], t[rest])
            w, t = w[fits], t[fits]
            last[i + 1, w[::-1]] = t[::-1]
        found, at, which = [], sizes.copy(), np.arange(len(pieces))
        while len(which := which[at[which] > 0]):
            t = last[at[which], which]
            if (t < 0).any():
                raise ValueError("bytes that the vocabulary can't encode")
            row = np.full(len(pieces), -1)
            row[which] = t
            found.append(row)
            at[which] -= self.sizes[t]
        tokens = np.array(found[::-1]).reshape(len(found), len(pieces)).T
        stops = np.cumsum((tokens >= 0).sum(1)) * 4
        ids = tokens[tokens >= 0].astype("<u4").tobytes()
        out = [b""] * len(pieces)
        for k, a, b in zip(order.tolist(), [0, *stops.tolist()], stops.tolist()):
            out[k] = ids[a:b]
        return out


class Prefixes:
    """The table of bytes that grow and change."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last, self.open = vocabulary, bytearray(), [-1], []
        self.append(data)

    def append(self, more: bytes) -> None:
        begin = len(self.data)
        self.data += more
        self.open = self.v.extend(self.data, begin, len(self.data), self.last, self.open)

    def _open_at(self, end: int) -> list[int]:
        out = []
        for start in range(max(0, end - self.v.longest), end):
            node = 0
            if not start or self.last[start] >= 0:
                for x in self.data[start:end]:
                    if (node := self.v.steps.get(node << 8 | x)) is None:
                        break
                else:
                    out.append(start << 24 | node)
        return out

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """data[start:stop] = new. Only prefixes that the edit can change are done again: once
        as many in a row as the longest token has bytes are as they were, so are the rest.
        Returns how many were."""
        old = self.last[stop + 1 :]
        self.data[start:stop] = new
        del self.last[start + 1 :]
        open_, same, done = self._open_at(start), 0, 0
        for i in range(start, len(self.data)):
            open_ = self.v.extend(self.data, i, i + 1, self.last, open_)
            k = i - (start + len(new))  # in old
            done += 1
            same = same + 1 if k >= 0 and self.last[i + 1] == old[k] else 0
            if same >= self.v.longest:
                self.last[i + 2 :] = old[k + 1 :]
                break
        self.open = self._open_at(len(self.data))
        return done

    def encode(self, size: int | None = None) -> list[int]:
        """Tokens of the first size bytes; of all by default."""
        return self.v.split(self.data if size is None else self.data[:size], self.last)


#: The characters that \s stands for in the pattern (fixed values: Unicode's White_Space).
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


_LITTLE = struct.Struct("<I").pack


class Codec:
    """Encodes texts, each match of the pattern separately, as tiktoken does; decodes ids.

    A text is first cut before each single space and around runs of white space: no match
    of the pattern goes over such a cut, as white space only stands at a match's start or
    makes up all of it. The parts repeat, and so do the matches in them; both are
    remembered. by_spaces=False for a pattern of which that isn't true."""

    def __init__(self, path: str, pattern: str, by_spaces: bool = True, most_cached: int = 300_000):
        self.vocabulary = Vocabulary.read(path)
        self.matches = regex.compile(pattern).findall
        self.together = Together(self.vocabulary)
        self.pieces = TextCache(self._piece, most_cached // 2)
        self.parts = TextCache(self._part, most_cached)
        self.cut = re.compile(f" ?[^{_SPACES}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+").findall if by_spaces else lambda text: [text]

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.vocabulary.ranks.get(raw)
        return b"".join([_LITTLE(t) for t in ([whole] if whole is not None else self.vocabulary.encode(raw))])

    def _part(self, part: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.matches(part)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        return b"".join(map(self.parts.__getitem__, self.cut(text)))

    def _learn(self, parts: list[str]) -> None:
        """Encodes these parts together and remembers them. Long ones are left to encode()."""
        matches = list(map(self.matches, parts))
        single = [p for p, m in zip(parts, matches) if len(m) == 1]
        wanted = [*single, *{x for m in matches if len(m) > 1 for x in m if x not in self.pieces and len(x) <= self.pieces.longest}]
        raws = [x.encode() for x in wanted]
        whole = list(map(self.vocabulary.ranks.get, raws))
        many = iter(self.together.encode([x for x, t in zip(raws, whole) if t is None]))
        ids = [next(many) if t is None else _LITTLE(t) for t in whole]
        for cache, begin, end in ((self.parts, 0, len(single)), (self.pieces, len(single), len(wanted))):
            for x, i in zip(wanted[begin:end], ids[begin:end]):
                cache.keep(x, i)
        for p, m in zip(parts, matches):
            if len(m) > 1:
                self.parts.keep(p, b"".join(map(self.pieces.__getitem__, m)))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """encode() of each; what is new in any of them is encoded together."""
        cuts = list(map(self.cut, texts))
        new = [p for p in set().union(*cuts) - self.parts.keys() if p not in self.parts.old and len(p) <= self.parts.longest]
        for k in range(0, len(new), 20_000):
            self._learn(new[k : k + 20_000])
        return [b"".join(map(self.parts.__getitem__, q)) for q in cuts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker."""
    return Codec(path, pattern)


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids (binary, little-endian 32-bit), decoded (the bytes that the ids
    stand for), ids_sha256 and decoded_sha256. path: ranks, one "base64 rank" a line, at the same
    place on each executor.

    Null text is encoded as empty: no ids. Equal rows give equal rows; ids may be null or
    repeat; an empty table gives an empty result; other columns are ignored. Very long
    pieces take time in proportion to their length and are not cached.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in slices(batches):
            ids = c.encode_all([t or "" for t in batch.column(1).to_pylist()])
            cols = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(c.decode, ids), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_tokens", "ids", "decoded"])
        c.parts.trim()
        c.pieces.trim()

    given = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    coded = given.mapInArrow(run, "id long, n_tokens long, ids binary, decoded binary")
    return coded.select("*", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")).withColumnRenamed("id", id_col)
