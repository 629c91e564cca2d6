"""Connected components of links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def stars(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of a link, root being the component's smallest node.

    Alternates large-star (a node's larger neighbours go to the smallest of its
    neighbourhood) and small-star (its smaller ones do) until nothing changes. Minima are
    pre-aggregated and the joins can be split, so a node with very many links does no
    harm. Each round is written to the shared folder. Nothing but a count and a checksum
    reaches the driver. Links of a node to itself, repeated links, nulls and an empty
    table are allowed; nulls link nothing."""

    def state(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    # u > v
    pairs = links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = written(pairs.distinct(), "links")
    before = state(now)
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u"))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large-star")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "links")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        after = state(new)
        for old in (now, least, large, low):
            drop_written(old)
        now = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components haven't settled after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
