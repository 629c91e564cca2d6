"""Exact dedup by an extendible-hash index on shared files; DataFrame operations only.

1. One pass over the texts writes a digest row per document: the 64-bit hash that
   addresses the index, SHA-256 and byte length of the normalised text.
2. The directory: distinct hashes are counted by their leading ``MAX_DEPTH`` bits (at
   most ``2**MAX_DEPTH`` numbers reach the driver). Starting from one bucket, a bucket of
   more than ``capacity`` keys is split, and the directory doubles whenever a bucket
   grows deeper than it. By default the capacity is 4096 keys, or in large tables as many
   as let half of the deepest directory do, so that splitting goes on at any size.
3. A combiner ships a text at most ``SALTS`` times, however many copies it has. It doesn't
   decide anything: its rows carry their whole texts and the bucket that the directory
   gives them, and are written to the shared folder.
4. Owner tasks take contiguous ranges of (bucket, hash). They compare the texts of a hash
   byte for byte, merge equal ones into an entry, chain the different ones by number, and
   write their share of the index to the shared folder.
5. Digest rows find their bucket by the directory and their entry in it by (hash, SHA-256,
   length). A hot key makes one large partition of digest rows at most, which adaptive
   execution splits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, strip_white, written

MAX_DEPTH = 12
SALTS = 16
_SPAN = "36893488147419103232"  # 2**65: the id takes less than half of it, so rounding is safe
_TOP = "9223372036854775807"  # 2**63 - 1


@dataclass(frozen=True)
class Directory:
    """depth: leading bits that address it. buckets: (prefix, local depth) of each bucket."""

    depth: int
    buckets: tuple[tuple[int, int], ...]

    @staticmethod
    def build(counts: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> "Directory":
        """counts: keys by their leading max_depth bits."""
        sums = [dict() for _ in range(max_depth)] + [counts]
        for d in range(max_depth - 1, -1, -1):
            for p, n in sums[d + 1].items():
                sums[d][p >> 1] = sums[d].get(p >> 1, 0) + n
        depth, buckets, open_ = 0, [], [(0, 0)]
        while open_:
            prefix, local = open_.pop()
            if sums[local].get(prefix, 0) > capacity and local < max_depth:
                depth = max(depth, local + 1)  # doubling
                open_ += [(2 * prefix + 1, local + 1), (2 * prefix, local + 1)]
            else:
                buckets.append((prefix, local))
        return Directory(depth, tuple(buckets))

    def slots(self) -> list[tuple[int, int]]:
        """(slot, bucket number) of every slot; at most 2**MAX_DEPTH."""
        return [(s, k) for k, (p, d) in enumerate(self.buckets) for s in range(p << (self.depth - d), (p + 1) << (self.depth - d))]


def _leading(h: Column | str, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, hash_bits: int = 64) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Texts are equal if identical without ASCII white space. Of equal texts the row with
    the most code points in its text stays, then the one with the smallest id.

    - Null text counts as empty; empty texts are equal to each other.
    - A null id ranks behind all other ids; keep_id is null if the whole group has none.
    - Rows repeated with the same id are decided alike, and each counts in group_size.
    - An empty table gives an empty result; other columns are ignored.
    - hash_bits: fewer bits force collisions, for tests.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.char_length(text).alias("chars"), strip_white(text).alias("norm"))
    h = F.shiftleft(F.xxhash64("norm"), 64 - hash_bits) if hash_bits < 64 else F.xxhash64("norm")
    rows = rows.withColumn("h", h)
    digests = written(rows.select("id", "chars", "h", F.unhex(F.sha2("norm", 256)).alias("sha"), F.octet_length("norm").alias("bytes")), "digests")

    counts = digests.select("h").distinct().groupBy(_leading("h", MAX_DEPTH).alias("p")).count()
    keys = {r["p"]: r["count"] for r in counts.collect()}
    directory = Directory.build(keys, capacity or max(4096, -(-sum(keys.values()) // 2 ** (MAX_DEPTH - 1))))
    slots = F.broadcast(spark.createDataFrame(directory.slots(), "slot long, bucket long"))  # at most 2**MAX_DEPTH rows
    addressed = lambda df: df.withColumn("slot", _leading("h", directory.depth)).join(slots, "slot").drop("slot")

    # most code points first, then the smallest id, as one number that a hash aggregate can keep
    rank = F.col("chars").cast("decimal(10,0)") * F.lit(_SPAN).cast("decimal(20,0)") + F.coalesce(F.lit(_TOP).cast("decimal(20,0)") - F.col("id").cast("decimal(20,0)"), F.lit(-1).cast("decimal(20,0)"))
    salt = F.pmod(F.xxhash64("id", "chars"), F.lit(SALTS))
    combined = rows.groupBy("h", "norm", salt.alias("salt")).agg(F.count(F.lit(1)).alias("n"), F.max(rank.cast("decimal(38,0)")).alias("best"))
    combined = written(addressed(combined.drop("salt")), "hash-entries")
    # the ranges' partitioning serves both steps, so an owner's rows stay with it
    owned = combined.repartitionByRange("bucket", "h").groupBy("bucket", "h", "norm").agg(F.sum("n").alias("group_size"), F.max("best").alias("best"))
    chain = F.row_number().over(Window.partitionBy("bucket", "h").orderBy("norm")) - 1
    top = F.floor((F.col("best") + 1) / F.lit(_SPAN).cast("decimal(20,0)")).cast("decimal(10,0)")
    keep = F.lit(_TOP).cast("decimal(20,0)") - (F.col("best") - F.col("top") * F.lit(_SPAN).cast("decimal(20,0)"))
    index = owned.select("bucket", "h", chain.alias("chain"), F.unhex(F.sha2("norm", 256)).alias("sha"), F.octet_length("norm").alias("bytes"), "group_size", "best")
    index = written(index, "hash-index")
    index = index.withColumn("top", top).withColumn("keep", keep).select(
        "bucket", "chain", "h", "sha", "bytes", "group_size", F.col("top").cast("int").alias("top"), F.when(F.col("keep") <= F.lit(_TOP).cast("decimal(20,0)"), F.col("keep")).cast("long").alias("keep_id")
    )
    found = addressed(digests).join(index, ["bucket", "h", "sha", "bytes"])
    return found.select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("top"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "bucket", "chain"
    )
