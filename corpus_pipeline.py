"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one
the packed pieces. Stages are meant to be written as Parquet and read again between.

In all stages: other columns than those of documents are left out, whatever their names; an
empty table gives an empty result; lang, source and n_chars may be null anywhere, and so may
doc_id; a null text counts as empty. Repeated rows are decided alike up to near_dedup, after
which one of them is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import langid, line_dedup, packing, suffix_dedup
from chronoloom.llm import near_dedup as near
from chronoloom.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted again."""
    return df.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, min_score: float = 0.25) -> DataFrame:
    """Rejects documents without a letter, and those whose most frequent n-grams are far from
    every profile. Null and empty texts go. Rows with a null id or lang aren't learned from; if
    there are none to learn from, every document goes."""
    profiles = langid.train_profiles(docs.where(F.col("doc_id").isNotNull() & ~langid.held_out(F.col("doc_id"))))
    named = langid.identify(docs.select(*COLUMNS), profiles)
    return named.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= min_score)).select(*COLUMNS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; documents stay. Of documents that would be
    left without a line, each line stays once. Null texts stay null; rows with the same id are one
    document in the count."""
    return _with_text(line_dedup.line_dedup(docs.select(*COLUMNS), min_docs=10, min_chars=1, spare=True))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: documents are linked if the Jaccard similarity of
    their 5-word shingles is 0.8 or more. It is that of the smallest id, null ids last, ties by
    content. Texts without a word are one component."""
    return near.keep_near_one(docs.select(*COLUMNS), words=5, similarity=0.8).select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 200 bytes that occur more than once go; documents stay, empty ones and
    null texts as empty text."""
    cut = suffix_dedup.suffix_dedup(docs.select(*COLUMNS), length=200, as_string=True)
    return _with_text(cut.withColumnRenamed("kept", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens. Empty texts are the closing id alone."""
    import public_tokenizers

    return packing.pack(docs.select(*COLUMNS), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1, most_cached=64_000)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_common_lines),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", drop_repeated_passages),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the fingerprints' components nor the packing; tests compare with brute force.
ORACLE_SQL = None
