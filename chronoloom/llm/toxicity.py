"""Toxicity by a convolutional text classifier in numpy.

Words are hashed to embeddings; filters of several widths run over the whole text and
each is pooled to its maximum; a logistic unit reads the pooled values. Every labelled row
counts: four fifths train, in shards. In each epoch every shard starts from the same
numbers and goes over its rows by Adam; the changes are then averaged, a word's over the
shards that hold it. Words too rare to be learned share one embedding. The other fifth of the
rows calibrates thresholds for each language: as scoring may not be told a text's language,
the words vote for one. Scores are stretched so that the threshold is at 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, only, scratch_path, slices, written
from .langid import held_out

WIDTHS = (1, 2, 3)
#: Words are hashed to that many numbers, so that the model's size is bounded.
BUCKETS = 1 << 20
#: Changes and scores are summed as whole numbers, so that their order doesn't matter.
_FIXED, _BINS = 2.0**18, 1 << 14
#: Words are runs of letters.
_words = re.compile(r"[^\W\d_]+").findall


class WordHashes(dict):
    """word -> its bucket, or what known gives for that; emptied when it holds too many."""

    def __init__(self, known: np.ndarray | None = None, most: int = 200_000):
        self.known, self.most = known, most

    def __missing__(self, word: str) -> int:
        out = zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS
        if self.known is not None:
            out = int(self.known[out])
        if len(self) >= self.most:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out

    def of(self, text: str | None) -> np.ndarray:
        words = _words((text or "").lower())
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _sigmoid(z: float) -> float:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Classifier:
    """known: a word's bucket -> its row of the embeddings; rare words have row 0. share: how many
    of the labels are 1. votes: row -> for each language the log of how common it is there."""

    known: np.ndarray
    embeddings: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    share: float = 0.0
    langs: list[str] = field(default_factory=list)
    votes: np.ndarray | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def taps(self) -> np.ndarray:
        """All filters' rows, by width and place."""
        return np.concatenate([w[o].T for w in self.filters for o in range(len(w))])

    def pooled(self, rows: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts that stand one after another in rows, each up to its stop: pooled filter values,
        a column for each text, and where in rows each is reached; 0 and -1 where none is positive."""
        n_filters, begins = self.filters[0].shape[2], np.concatenate([[0], stops[:-1]])
        values = np.zeros((n_filters * len(WIDTHS), len(stops)), np.float32)
        places = np.full(values.shape, -1)
        taps = self.taps()
        for begin in range(0, len(rows), 65_536):  # bounds what is held of very long texts
            x = self.embeddings[rows[begin : begin + 65_536 + WIDTHS[-1] - 1]]
            parts = (taps @ x.T).reshape(-1, n_filters, len(x))
            texts = np.flatnonzero((begins < begin + 65_536) & (stops > begin) & (begins < stops))
            first, tap = np.maximum(begins[texts] - begin, 0), 0
            for j, width in enumerate(WIDTHS):
                n = min(65_536, len(x) - width + 1)
                z = sum(parts[tap + o][:, o : o + n] for o in range(width)) + self.biases[j][:, None]
                tap += width
                over = (stops[texts][:, None] - np.arange(1, width) - begin).ravel()
                z[:, over[(over >= 0) & (over < n)]] = -np.inf  # windows that go on into the next text
                inside = first < n
                for t, at, to in zip(texts[inside].tolist(), first[inside].tolist(), [*first[inside][1:].tolist(), n]):
                    part, own = z[:, at:to], slice(j * n_filters, (j + 1) * n_filters)
                    top = part.argmax(1)
                    value = part[np.arange(n_filters), top]
                    better = value > values[own, t]
                    values[own, t][better] = value[better]
                    places[own, t][better] = (begin + at + top)[better]
        return values, places

    def language(self, rows: np.ndarray) -> str:
        if not self.langs:
            return ""
        return self.langs[int(self.votes[rows].sum(0).argmax())] if len(rows) else self.langs[0]

    def raw(self, rows: np.ndarray) -> float:
        """Of one text by itself, so that equal texts have equal scores; pooled() without places."""
        n_filters, taps = self.filters[0].shape[2], self.taps()
        best = [np.zeros(n_filters, np.float32) for _ in WIDTHS]
        for begin in range(0, len(rows), 65_536):
            x = self.embeddings[rows[begin : begin + 65_536 + WIDTHS[-1] - 1]]
            parts, tap = (taps @ x.T).reshape(-1, n_filters, len(x)), 0
            for j, width in enumerate(WIDTHS):
                n = min(65_536, len(x) - width + 1)
                if n > 0:
                    z = parts[tap][:, :n]
                    for o in range(1, width):
                        z = z + parts[tap + o][:, o : o + n]
                    best[j] = np.maximum(best[j], z.max(1) + self.biases[j])
                tap += width
        return float(_sigmoid(np.concatenate(best) @ self.weights + self.bias))

    def score(self, rows: np.ndarray) -> float:
        p, t = self.raw(rows), self.thresholds.get(self.language(rows), 0.5)
        return float(0.5 * p / t if p < t else 0.5 + 0.5 * (p - t) / (1 - t))


def untrained(df: np.ndarray, toxic: np.ndarray, n_rows: int, n_toxic: int, dim: int = 8, n_filters: int = 8, min_docs: int = 5, seed: int = 1) -> Classifier:
    """df, toxic: for each bucket the number of rows, and of rows with label 1, that hold it.

    The first number of an embedding starts as how surely its word's share differs between
    the labels, the others at random."""
    rng = np.random.default_rng(seed)
    share = n_toxic / n_rows if n_rows else 0.0
    frequent = np.flatnonzero(df >= min_docs)
    known = np.zeros(BUCKETS, np.int32)
    known[frequent] = np.arange(1, len(frequent) + 1)
    normal = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
    m = Classifier(known, normal(len(frequent) + 1, dim, by=0.05), [normal(w, dim, n_filters, by=0.2) for w in WIDTHS], [np.zeros(n_filters, np.float32) for _ in WIDTHS], normal(n_filters * len(WIDTHS), by=0.2), 0.0, share)
    n = df[frequent]
    m.embeddings[1:, 0] = np.clip((toxic[frequent] - n * share) / np.sqrt(n * share * (1 - share) + 1), -8, 8) / 4
    for k in range(len(WIDTHS)):  # one filter of each width starts by reading it
        m.filters[k][:, 0, 0] = 1
        m.weights[k * n_filters] = 1
    m.embeddings[0] = 0
    m.bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    return m


def train_epoch(m: Classifier, rows: list[np.ndarray], labels: np.ndarray, left: float, rng: np.random.Generator, rate: float = 0.01, blank: float = 0.2, decay: float = 1e-3) -> None:
    """Changes m by going over all rows once; left: the rate's part that is left. A share `blank`
    of the words is hidden."""
    n_filters, share = len(m.biases[0]), m.share
    params = [*m.filters, *m.biases, m.weights]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    first_e, second_e, move = (np.zeros_like(m.embeddings) for _ in range(3))
    step, b1, b2 = 0, 0.9, 0.99
    order = rng.permutation(len(rows))
    for k in range(0, len(order), 32):
        batch = order[k : k + 32]
        seen, stops = np.concatenate([rows[i] for i in batch]), np.cumsum([len(rows[i]) for i in batch])
        seen[rng.random(len(seen)) < blank] = 0
        values, places = m.pooled(seen, stops)
        p, y = _sigmoid(values.T @ m.weights + m.bias), labels[batch]
        # the rarer label weighs more
        g = ((p - y) * np.where(y, 0.5 / share, 0.5 / (1 - share)) / len(batch)).astype(np.float32)
        back = m.weights[:, None] * g * (places >= 0)
        by_filter, used, pulls = [], [np.zeros(1, np.int64)], [np.zeros((1, m.embeddings.shape[1]), np.float32)]
        for j, width in enumerate(WIDTHS):
            gf, at = back[j * n_filters : (j + 1) * n_filters], places[j * n_filters : (j + 1) * n_filters]
            on = np.nonzero(at >= 0)
            of_filter = np.zeros_like(m.filters[j])
            for o in range(width):
                r, w = seen[at[on] + o], gf[on][:, None]
                np.add.at(of_filter[o].T, on[0], m.embeddings[r] * w)
                used.append(r)
                pulls.append(m.filters[j][o].T[on[0]] * w)
            by_filter.append(of_filter)
        grads = [*by_filter, *back.reshape(len(WIDTHS), n_filters, -1).sum(2), values @ g]
        used, pulls = np.concatenate(used), np.concatenate(pulls)
        by = np.argsort(used, kind="stable")
        used, begins = np.unique(used[by], return_index=True)
        pulls = np.add.reduceat(pulls[by], begins)
        step += 1
        lr = float(rate * left * np.sqrt(1 - b2**step) / (1 - b1**step))
        for p, g_p, a, v in zip(params, grads, first, second):
            a += (1 - b1) * (g_p - a)
            v += (1 - b2) * (g_p * g_p - v)
            p -= lr * a / (np.sqrt(v) + 1e-8) + rate * decay * p
        # the same for the embeddings, most of which no text of the batch moves
        first_e *= b1
        first_e[used] += (1 - b1) * pulls
        second_e *= b2
        second_e[used] += (1 - b2) * pulls * pulls
        np.sqrt(second_e, out=move)
        move += 1e-8
        np.divide(first_e, move, out=move)
        move *= lr
        m.embeddings *= 1 - rate * decay
        m.embeddings -= move
        m.embeddings[0] = 0
        m.bias -= rate * float(g.sum())


def _dense(m: Classifier) -> np.ndarray:
    """All numbers but the embeddings, one after another."""
    return np.concatenate([*(p.ravel() for p in (*m.filters, *m.biases, m.weights)), [m.bias]]).astype(np.float64)


def _set_dense(m: Classifier, numbers: np.ndarray) -> None:
    at = 0
    for p in (*m.filters, *m.biases, m.weights):
        p[...] = numbers[at : at + p.size].reshape(p.shape)
        at += p.size
    m.bias = float(numbers[at])


def _changes(m: Classifier, words: np.ndarray, stops: np.ndarray, labels: np.ndarray, left: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's epoch: (rows of the embeddings, how many texts hold each, changes times that).
    Negative rows stand for parts of the other numbers. words: buckets of all texts in a row."""
    dim = m.embeddings.shape[1]
    every, is_used = m.known[words], np.zeros(len(m.embeddings), bool)
    is_used[every] = is_used[0] = True  # 0 stays the first
    used = np.flatnonzero(is_used)
    rows = np.split((np.cumsum(is_used) - 1)[every], stops[:-1])
    own = Classifier(m.known, m.embeddings[used], [f.copy() for f in m.filters], [b.copy() for b in m.biases], m.weights.copy(), m.bias, m.share)
    train_epoch(own, rows, labels, left, rng)
    held = np.zeros(len(used), np.int64)
    for r in rows:
        held[np.unique(r)] += 1
    moved = _dense(own) - _dense(m)
    moved = np.concatenate([moved, np.zeros(-len(moved) % dim)]).reshape(-1, dim)
    rest = np.full(len(moved), len(rows))
    weight = np.concatenate([held[1:], rest])
    change = np.concatenate([(own.embeddings - m.embeddings[used])[1:].astype(np.float64), moved])
    return np.concatenate([used[1:], -1 - np.arange(len(moved))]), weight, np.rint(change * weight[:, None] * _FIXED).astype(np.int64)


def best_threshold(scores: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> float:
    """The middle of the cuts with the best F1; 0.5 without both labels. For each score, n rows
    have it, toxic of them with label 1."""
    if toxic.sum() in (0, n.sum()):
        return 0.5
    order = np.argsort(-scores, kind="stable")
    s, y, n = scores[order], toxic[order], n[order]
    f1 = 2 * np.cumsum(y) / (np.cumsum(n) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # no cut between equal scores
    k = int(f1.argmax())
    return float(np.clip((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k] / 2, 0.02, 0.98))


def _counted(rows: DataFrame, min_docs: int) -> pa.Table:
    """lang, bucket, n (times it occurs), df and toxic (training rows, and those with label 1, that
    hold it), of buckets that min_docs training rows hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, got in held.items():
                buckets, at = np.unique(np.concatenate([w for w, _, _ in got]), return_inverse=True)
                once = [np.unique(w) if fit else w[:0] for w, fit, _ in got]
                place = np.searchsorted(buckets, np.concatenate(once))
                ones = np.repeat([float(label) for _, _, label in got], [len(o) for o in once])
                counts = [np.bincount(x, w, len(buckets)).astype(np.int64) for x, w in ((at, None), (place, None), (place, ones))]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(buckets), pa.string()), pa.array(buckets.astype(np.int32)), *map(pa.array, counts)], ["lang", "bucket", "n", "df", "toxic"])
            held.clear()

        for batch in slices(batches):
            for words, lang, fit, label in zip(*(batch.column(c).to_pylist() for c in ("words", "lang", "fit", "label"))):
                w = np.frombuffer(words, "<u4")
                held.setdefault(lang, []).append((w, fit, label))
                size += len(w)
            if size > 1_000_000:
                yield from flush()
                size = 0
        yield from flush()

    counts = rows.select("words", "lang", "fit", "label").mapInArrow(run, "lang string, bucket int, n long, df long, toxic long")
    counts = counts.groupBy("bucket", "lang").agg(*[F.sum(c).alias(c) for c in ("n", "df", "toxic")])
    return counts.withColumn("_all", F.sum("df").over(Window.partitionBy("bucket"))).where(F.col("_all") >= min_docs).drop("_all").toArrow()


def _packed(rows: DataFrame, shards: int) -> DataFrame:
    """A row, and a file, for each shard: its texts' words, where they stop, and the labels."""

    def pack(table: pa.Table) -> pa.Table:
        found = sorted(zip(*(table.column(c).to_pylist() for c in ("at", "words", "label"))))  # the same in each run
        stops = np.cumsum([len(w) // 4 for _, w, _ in found]).astype("<i8")
        return pa.table({"shard": table.column("shard")[:1].cast(pa.int32()), "words": pa.array([b"".join(w for _, w, _ in found)], pa.binary()), "stops": pa.array([stops.tobytes()], pa.binary()), "labels": pa.array([np.array([x for _, _, x in found], "<i8").tobytes()], pa.binary())})

    made = rows.where("fit").select(F.pmod("at", F.lit(shards)).cast("int").alias("shard"), "at", "words", "label")
    made = made.repartition(shards, "shard").groupBy("shard").applyInArrow(pack, "shard int, words binary, stops binary, labels binary")
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "shards")
    made.write.option("maxRecordsPerFile", 1).parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def _averaged(m: Classifier, packed: DataFrame, epoch: int, left: float, seed: int) -> None:
    """Changes m by an epoch over all shards."""
    dim = m.embeddings.shape[1]
    held = packed.sparkSession.sparkContext.broadcast(m)
    names = [f"d{i}" for i in range(dim)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            words, stops, labels = (np.frombuffer(batch.column(c)[0].as_buffer(), t) for c, t in (("words", "<u4"), ("stops", "<i8"), ("labels", "<i8")))
            row, weight, change = _changes(held.value, words, stops, labels, left, np.random.default_rng((seed, epoch, batch.column("shard")[0].as_py())))
            yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(weight), *(pa.array(change[:, i]) for i in range(dim))], ["row", "weight", *names])

    moved = packed.mapInArrow(run, f"row int, weight long, {', '.join(f'{c} long' for c in names)}")
    got = moved.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("weight", *names)]).toArrow()
    row, weight = (got.column(c).to_numpy() for c in ("row", "weight"))
    change = np.stack([got.column(c).to_numpy() for c in names], 1) / _FIXED / weight[:, None]
    m.embeddings[row[row > 0]] += change[row > 0].astype(np.float32)
    numbers, rest = _dense(m), change[row < 0][np.argsort(-row[row < 0])].ravel()
    _set_dense(m, numbers + rest[: len(numbers)])
    held.destroy()


def _calibrate(m: Classifier, rows: DataFrame) -> None:
    """Thresholds by the rows that didn't train; their scores are counted on a grid."""
    held = rows.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [held.value.known[np.frombuffer(w, "<u4")] for w in batch.column("words").to_pylist()]
            bins = [int(held.value.raw(r) * _BINS) for r in found]
            yield pa.RecordBatch.from_arrays([pa.array([held.value.language(r) for r in found], pa.string()), pa.array(bins, pa.int32()), batch.column("label")], ["by", "bin", "label"])

    scored = rows.where("not fit").select("words", "label").mapInArrow(run, "by string, bin int, label long")
    got = scored.groupBy("by", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).orderBy("by", "bin").toArrow()
    by = np.array(got.column("by").to_pylist(), object)
    bins, n, toxic = (got.column(c).to_numpy() for c in ("bin", "n", "toxic"))
    scores = (bins + 0.5) / _BINS
    everywhere = best_threshold(scores, toxic, n)
    for lang in {*by, *m.langs, ""}:
        of = by == lang
        enough = toxic[of].sum() >= 10 and (n - toxic)[of].sum() >= 10
        m.thresholds[lang] = best_threshold(scores[of], toxic[of], n[of]) if enough else everywhere
    held.destroy()


def train_on(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, label_col: str, shard_words: int = 2_000_000, epochs: int = 5, min_docs: int = 5, seed: int = 1) -> Classifier:
    """Trained on all rows, in shards of about shard_words words. Rows with a null label or id
    aren't used; null texts are empty. Without rows of both labels every score is below 0.5."""
    id_ = F.col(f"`{id_col}`")
    rows = only(labelled, id_col, text_col, lang_col, label_col).select(id_.alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{label_col}`").cast("long").alias("label"))
    rows = rows.where("label is not null and id is not null").select(F.xxhash64("id", F.lit(7)).alias("at"), (F.pmod(F.xxhash64("id", F.lit(11)), F.lit(5)) != 0).alias("fit"), "text", "lang", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordHashes()
        for batch in slices(batches):
            words = pa.array([ids.of(t).astype("<u4").tobytes() for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("fit"), words, batch.column("lang"), batch.column("label")], ["at", "fit", "words", "lang", "label"])

    rows = written(rows.mapInArrow(run, "at long, fit boolean, words binary, lang string, label long"), "labelled")
    size = rows.where("fit").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic"), F.sum(F.octet_length("words") / 4).alias("words")).first()
    langs = sorted(r["lang"] for r in rows.where("lang is not null").select("lang").distinct().collect())
    counted = _counted(rows, min_docs)
    bucket, n, df, toxic = (counted.column(c).to_numpy() for c in ("bucket", "n", "df", "toxic"))
    m = untrained(np.bincount(bucket, df, BUCKETS), np.bincount(bucket, toxic, BUCKETS), size["n"], size["toxic"] or 0, min_docs=min_docs, seed=seed)
    if 0 < m.share < 1:
        packed = _packed(rows, -int(-size["words"] // shard_words) or 1)
        for epoch in range(epochs):
            _averaged(m, packed, epoch, 1 - epoch / epochs, seed)
        drop_written(packed)
    m.langs = langs
    counts = np.full((len(m.embeddings), len(langs)), 0.1)
    of = np.array(counted.column("lang").to_pylist(), object)
    for k, lang in enumerate(langs):
        counts[m.known[bucket[of == lang]], k] += n[of == lang]
    counts[0] = 1
    m.votes = np.log(counts / counts.sum(0)).astype(np.float32)
    _calibrate(m, rows)
    drop_written(rows)
    return m


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row; the whole text counts. A null text is empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        ids = WordHashes(m.known)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.score(ids.of(t)) for t in batch.column(1).to_pylist()], pa.float64())], ["id", "score"])

    given = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return given.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def _only_known(docs: DataFrame, ids: DataFrame, id_: Column) -> DataFrame:
    """docs without rows whose id isn't in ids, but for a few that share a bit of a map of 2**26
    hashes: a join that follows shuffles few texts in vain."""
    spark, n_bits = docs.sparkSession, 1 << 26
    place = F.pmod(F.xxhash64(id_, F.lit(3)), F.lit(n_bits))
    found = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    at = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    held = spark.sparkContext.broadcast({r["k"]: np.frombuffer(bytes(r["bits"]), np.uint8) for r in found})

    @F.arrow_udf("boolean")
    def known(bucket: pa.Array, bit: pa.Array) -> pa.Array:
        none = np.zeros(4096, np.uint8)
        return pa.array([bool(held.value.get(k, none)[b >> 3] >> (b & 7) & 1) for k, b in zip(bucket.to_pylist(), bit.to_pylist())], pa.bool_())

    return docs.where(known(*at))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> DataFrame:
    """Per row: id, held_out, score, predicted. Learns from all labelled rows that aren't held out.

    Rows with a null id are scored but not learned from and not held out. Repeated rows are
    scored alike; labels of an id that contradict each other are both learned from. An
    empty table gives an empty result; other columns are ignored.
    """
    id_ = F.col(f"`{id_col}`")
    learns = id_.isNotNull() & ~held_out(id_)
    marked = only(labels, id_col, label_col).where(learns & F.col(f"`{label_col}`").isNotNull())
    learned = _only_known(only(docs, id_col, text_col, lang_col).where(learns), marked, id_).join(marked, id_col)
    out = score(docs, train_on(learned, id_col, text_col, lang_col, label_col), id_col, text_col)
    return out.select(id_, held_out(id_).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
