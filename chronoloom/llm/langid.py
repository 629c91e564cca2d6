"""Language identification by rank-order profiles of character n-grams.

A profile is a language's most frequent n-grams in order. A document's own most frequent
n-grams are compared with each profile: the distance is the sum, over them, of how far
each is from its place in the profile, or the profile's length if it isn't in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, slices

UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """code point -> its lower-case letter, or a space if it is no letter."""
    out = np.full(0x110000, 32, np.uint64)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of 1 to 3 letters or word ends, their counts) of a whole text; each as one
    number of 21 bits a character."""
    a = _letters()[np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)]
    a = np.concatenate([[np.uint64(32)], a, [np.uint64(32)]])
    space = a == 32
    a = a[~(space & np.concatenate([[False], space[:-1]]))]
    if len(a) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    b = np.uint64(21)
    two = a[:-1] << b | a[1:]
    return np.unique(np.concatenate([a[a != 32], two, two[:-1] << b | a[2:]]), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams in order, ties by n-gram."""
    return grams[np.lexsort((grams, -counts))[:most]]


class Profiles:
    """profiles: language -> its n-grams in order."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.size, self.langs = size, sorted(profiles)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.uint64))
        self.places = np.full((len(self.langs), len(self.grams)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            p = np.array(profiles[lang], np.uint64)
            self.places[k, np.searchsorted(self.grams, p)] = np.arange(len(p))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, 1 - distance / largest distance); no letters or no profile: und, 0."""
        own = ranked(*ngrams(text), self.size)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        places = self.places[:, at]
        out = np.where((self.grams[at] == own) & (places >= 0), np.abs(places - np.arange(len(own))), self.size)
        distance = np.minimum(out, self.size).sum(1)
        best = int(distance.argmin())
        return self.langs[best], float(1 - distance[best] / (self.size * len(own)))


def bounded_sample(rows: DataFrame, key: Column, most: int, by: Column | None = None) -> DataFrame:
    """At most `most` rows of each value of by (of all by default), those of the smallest hashes
    of key; of a key that repeats beyond that bound, none. Counts thin the hashes to about twice
    as many before they are sorted, and rows are then chosen by comparing hashes, so texts are
    neither sorted nor shuffled. Two numbers for each value with more rows reach the driver."""
    rows = rows.select("*", F.lit("").alias("_by") if by is None else by.alias("_by"), F.xxhash64(key, F.lit(7)).alias("_h"))
    counts = rows.groupBy("_by").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).collect()
    if not counts:
        return rows.drop("_by", "_h")

    def of(values: dict[str, float]) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("_by")]

    early = rows.select("_by", "_h").where(F.col("_h").cast("double") / 2.0**64 + 0.5 < of({r["_by"]: 2.0 * most / r["n"] for r in counts}))
    nth = F.row_number().over(Window.partitionBy("_by").orderBy("_h"))
    stops = {r["_by"]: r["_h"] for r in early.withColumn("nth", nth).where(F.col("nth") == most + 1).collect()}
    return rows.where(of(stops).isNull() | (F.col("_h") < of(stops))).drop("_by", "_h") if stops else rows.drop("_by", "_h")


def train_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", size: int = 400, most_rows: int = 5_000) -> Profiles:
    """Profiles of size n-grams for each language, from at most most_rows rows of each. Rows with
    null text or language don't count; without any row there is no language."""
    rows = only(labelled, *dict.fromkeys((key_col, text_col, lang_col))).select(F.col(f"`{key_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = bounded_sample(rows.where("text is not null and lang is not null"), F.col("key"), most_rows, F.col("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            by: dict[str, list] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                by.setdefault(lang, []).append(ngrams(text))
            for lang, got in by.items():
                grams, at = np.unique(np.concatenate([g for g, _ in got]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([c for _, c in got]), len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    counts = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= size)
    profiles: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["place"])):  # size rows for each language
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(profiles, size)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs and lang_pred, lang_score, by their whole text. Null texts and texts without a
    letter: und, 0. Columns of docs with these names, or _p, give way."""
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "lang_score", "_p")
    model = spark.sparkContext.broadcast(profiles)  # size numbers for each language

    @F.arrow_udf("lang_pred string, lang_score double")
    def predict(texts: pa.Array) -> pa.Array:
        found = [model.value.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang_pred", "lang_score"])

    predict = predict.asNondeterministic()  # else it may be run once for each field
    return docs.withColumn("_p", predict(F.col(f"`{text_col}`").cast("string"))).select(*[F.col(f"`{c}`") for c in docs.columns], "_p.lang_pred", "_p.lang_score")


def held_out(id_: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(id_.cast("string")) % 5 == 0, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = 400, most_rows: int = 5_000) -> DataFrame:
    """Per row: id, held_out, lang_pred, score. Learns from rows that aren't held out.

    Rows with a null id aren't held out, nor learned from. Repeated rows are predicted
    alike. An empty table gives an empty result; other columns are ignored.
    """
    id_ = F.col(f"`{id_col}`")
    learned = docs.where(id_.isNotNull() & ~held_out(id_))
    profiles = train_profiles(learned, text_col, lang_col, id_col, size, most_rows)
    out = identify(only(docs, id_col, text_col), profiles, id_col, text_col)
    return out.select(id_, held_out(id_).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
