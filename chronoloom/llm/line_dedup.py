"""Line dedup by hashes that are range-partitioned and sorted by document and position;
DataFrame operations only.

1. Each line becomes (128-bit hash of its key, document, position), written once. The
   hash's halves are XXH64 with unrelated seeds.
2. These rows are range-partitioned by (hash, document) with position as secondary sort.
   As the document is part of the range, a line found in a third of all documents is cut
   over as many tasks as its rows need. Each task streams over its sorted run: of each
   (hash, document) the first row, the document's first occurrence, goes on, and then one
   summary for each hash; the tasks' summaries are merged.
3. Rows of the hashes to drop become a keep bitmap for each document: words of 64 lines,
   a set bit being a line that stays. It is compressed: words in which all lines stay
   aren't stored, nor are documents that keep everything.
4. The bitmaps, not texts, are the operator's result; apply_bitmaps() joins them to the
   documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, only, row_key, written


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _n_keys(text: Column, min_chars: int) -> Column:
    return F.size(F.filter(_lines(text), lambda line: F.char_length(F.btrim(line, F.lit(WHITE))) >= min_chars))


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, spare: bool = False) -> DataFrame:
    """Per document that loses lines: id, row_key, keeps (map of word number to 64 bits; a set
    bit is a line that stays, as do all lines of a word that isn't there) and drops (the same
    words' complements).

    Keys of at least min_chars code points found in at least min_docs documents lose all
    their lines; with keep_first, the first line in order of (document, position) stays. With
    spare, documents that would lose every such key keep the lines that are first among these
    documents, so that copies of one text don't all end empty.

    - Null or empty text: one empty line, whose key is too short to go.
    - Rows with the same id are one document in the count. Rows without id are documents of
      their own, equal ones among them being one.
    - Repeated rows have the same bitmap, given once.
    - An empty table gives an empty result; other columns are ignored.
    """
    base = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    extra = ["n"] if spare else []
    if spare:  # counted below the explosion, once for each document
        base = base.withColumn("n", _n_keys(F.col("text"), min_chars))
    lines = base.select("id", row_key("id", "text").alias("row_key"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"), *extra)
    lines = lines.select("id", "row_key", "pos", line_key(F.col("line")).alias("key"), *extra).where(F.char_length("key") >= min_chars)
    lines = lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), F.coalesce("id", "row_key").alias("doc"), "pos", "id", "row_key", *extra)
    lines = written(lines, "line-hashes")

    ordered = lines.select("h1", "h2", "doc", "pos").repartitionByRange("h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "pos")
    in_docs = ordered.groupBy("h1", "h2", "doc").agg(F.first("pos").alias("pos"))  # first depends on the order, so the sort stays in the plan
    hashes = in_docs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), *([F.min(F.struct("doc", "pos")).alias("first")] if keep_first else []))
    hashes = written(hashes.where(F.col("n_docs") >= min_docs), "common-lines")

    going = lines.join(hashes, ["h1", "h2"])
    if keep_first:
        going = going.where(F.struct("doc", "pos") != F.col("first"))
    bit, word = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64), (F.col("pos") / 64).cast("int").alias("word")
    words = going.groupBy("row_key", "id", word).agg(F.bit_or(bit).alias("bits"), *([F.max("n").alias("n")] if spare else []))
    if spare:
        words = written(words, "line-words")
        emptied = words.groupBy("row_key", "id").agg(F.sum(F.bit_count("bits")).alias("gone"), F.max("n").alias("n")).where("gone = n")
        emptied = emptied.select(F.col("row_key").alias("e_key"), F.col("id").alias("e_id"))
        among = going.join(written(emptied, "emptied"), (F.col("row_key") == F.col("e_key")) & F.col("id").eqNullSafe(F.col("e_id")), "left_semi")
        firsts = among.groupBy("h1", "h2").agg(F.min(F.struct("doc", "pos", "row_key", "id")).alias("first")).select("first.*")
        # a row of words and its row of spared bits meet in a group, so that null ids need no join
        spared = firsts.groupBy("row_key", "id", word).agg(F.bit_or(bit).alias("spared"))
        none = F.lit(0).cast("long")
        both = words.select("row_key", "id", "word", "bits", none.alias("spared")).union(spared.select("row_key", "id", "word", none, "spared"))
        words = both.groupBy("row_key", "id", "word").agg(F.bit_or("bits").bitwiseAND(F.bitwise_not(F.bit_or("spared"))).alias("bits")).where("bits <> 0")
    words = words.groupBy("row_key", "id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "bits")))).alias("drops"))
    return words.select("row_key", "id", F.transform_values("drops", lambda _, bits: F.bitwise_not(bits)).alias("keeps"), "drops")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their bitmap applied: text_col without the dropped lines, plus n_lines and
    n_dropped. Null text stays null and counts as one line. Columns of docs with these names,
    or with those used inside (_row, _key, _id, _keeps), give way."""
    docs = docs.drop("n_lines", "n_dropped", "_row", "_key", "_id", "_keeps")
    marks = bitmaps.select(F.col("row_key").alias("_key"), F.col("id").alias("_id"), F.col("keeps").alias("_keeps"))
    left = docs.withColumn("_row", row_key(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")))
    both = left.join(marks, (F.col("_row") == F.col("_key")) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_id")), "left")
    stays = lambda i: F.getbit(F.coalesce(F.element_at("_keeps", F.floor(i / 64).cast("int")), F.lit(-1).cast("long")), i % 64) == 1
    lines = _lines(F.col(f"`{text_col}`"))
    dropped = F.coalesce(F.aggregate(F.map_values("_keeps"), F.lit(0), lambda n, w: n + 64 - F.bit_count(w)), F.lit(0))
    kept = F.when(F.col("_keeps").isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(F.filter(lines, lambda _, i: stays(i)), "\n"))
    names = [c for c in docs.columns if c != text_col]
    return both.select(*[F.col(f"`{c}`") for c in names], kept.alias(text_col), F.size(lines).cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, spare: bool = False) -> DataFrame:
    """docs with common lines removed; see line_bitmaps() and apply_bitmaps()."""
    return apply_bitmaps(docs, line_bitmaps(docs, id_col, text_col, min_docs, min_chars, keep_first, spare), id_col, text_col)
