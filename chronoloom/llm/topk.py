"""Exact top-k inner products by no-random-access aggregation.

The candidates are dealt into shards. A shard is 64 lists (one for each component), each
sorted by component; a query reads all of them in step, from the end where its products
are largest. What has been read gives each candidate a sum; what hasn't is bounded
above by the product at the list's frontier and below by that at its other end. Reading
stops when the candidates that can still reach the k-th best lower bound are few; their
final scores are then resolved. The shards' results meet in a ranking for each query.

Queries are taken in blocks, against each shard of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, written


class Shard:
    """Sorted lists of a matrix of integers (held as doubles, exact below 2**53)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.n = ids, x, len(ids)
        order = np.argsort(x, axis=0, kind="stable")
        #: place of each candidate in each list, and the lists' values
        self.place = np.empty(x.shape, np.int32)
        np.put_along_axis(self.place, order, np.arange(self.n, dtype=np.int32)[:, None], axis=0)
        self.sorted = np.take_along_axis(x, order, axis=0)

    def search(self, queries: np.ndarray, k: int, own: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(positions, scores, depth read) of the k best for each query, ties to the smaller id;
        own: positions that take no part, for each query.

        All queries of a block read in step. Which candidates a list has given by some depth
        depends on the end that is read from only, so the sums and bounds of all queries are
        products of a few matrices."""
        n, up, down = self.n, np.maximum(queries, 0).T, np.minimum(queries, 0).T
        depth, done, out = max(1, n // 4), np.zeros(len(queries), bool), [None] * len(queries)
        while not done.all():
            left = np.flatnonzero(~done)
            u, d = up[:, left], down[:, left]
            top, bottom = (self.place >= n - depth).astype(np.float64), (self.place < depth).astype(np.float64)
            known = (self.x * top) @ u + (self.x * bottom) @ d
            # what isn't read: at best the frontier's product, at worst that of the other end
            lower = known + (1 - top) @ (self.sorted[0][:, None] * u) + (1 - bottom) @ (self.sorted[-1][:, None] * d)
            upper = known + (1 - top) @ (self.sorted[max(0, n - 1 - depth)][:, None] * u) + (1 - bottom) @ (self.sorted[min(n - 1, depth)][:, None] * d)
            for c, i in enumerate(left):
                lower[own[i], c] = upper[own[i], c] = -np.inf
            floor = np.partition(np.ascontiguousarray(lower.T), n - k, axis=1)[:, n - k] if n > k else np.full(len(left), -np.inf)
            alive = upper >= np.maximum(floor, np.finfo(float).min)
            few = (alive.sum(0) <= 8 * k) | (depth >= n)
            for c in np.flatnonzero(few):
                i, rows = left[c], np.flatnonzero(alive[:, c])
                scores = self.x[rows] @ queries[i]  # final scores of those left
                best = np.lexsort((self.ids[rows], -scores))[:k]
                out[i] = (rows[best], scores[best], min(depth, n))
            done[left[few]] = True
            depth = min(n, 2 * depth)
        return out


def as_integers(vector: Column, factor: int = 64) -> Column:
    """floor(factor * x) of each component; null if the vector is null or has a component that
    is null or not finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(sound & vector.isNotNull(), F.transform(vector, lambda x: F.floor(x.cast("double") * factor)))


def nra_topk(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "vector", k: int = 20, shard_rows: int = 4096, block_rows: int = 512) -> DataFrame:
    """(query_id, rank from 1, id, score): for each query the k rows of the largest inner
    product, all if there are fewer, ties to the smaller id; the query's own row is no
    candidate. vector_col: array of integers. is_query: a condition on id_col.

    - Rows with a null id or vector take no part. Shorter vectors are filled with zeros.
    - Rows that repeat an id and vector count once; of an id with several vectors, none is
      a candidate of a query with that id.
    - An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = only(vectors, id_col, vector_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<long>").alias("x"), is_query.alias("q"))
    rows = written(rows.where("id is not null and x is not null").dropDuplicates(["id", "x"]), "vectors")
    n, n_q, dim = rows.agg(F.count(F.lit(1)), F.count_if("q"), F.max(F.size("x"))).first()
    dim = dim or 0
    blocks = lambda count, each: max(1, -(-count // each))

    def packed(df: DataFrame, key: str) -> DataFrame:
        """A row for each group: its ids and its matrix as bytes. Groups have a bounded number of
        rows, as keys are hashes modulo the number of groups."""

        def run(table: pa.Table) -> pa.Table:
            ids = table["id"].to_numpy().astype(np.int64)
            x = np.zeros((len(ids), dim), np.int64)
            for i, v in enumerate(table["x"].to_pylist()):
                x[i, : len(v)] = v
            return pa.table({key: table[key][:1], "ids": pa.array([ids.tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary())})

        return df.groupBy(key).applyInArrow(run, f"{key} long, ids binary, x binary")

    n_shards, n_blocks = blocks(n, shard_rows), blocks(n_q, block_rows)
    shards = packed(rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n_shards))), "shard")
    queries = packed(rows.where("q").withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_blocks))), "block")
    tasks = shards.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    tasks = tasks.join(written(queries.select("block", F.col("ids").alias("q_ids"), F.col("x").alias("q_x")), "query-blocks"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c, t=np.int64: np.frombuffer(batch.column(c)[row].as_buffer(), t)  # noqa: E731, B023
                ids = get("ids")
                shard = Shard(ids, get("x").reshape(len(ids), dim).astype(np.float64))
                q_ids = get("q_ids")
                out: list[tuple] = []
                by_id = np.argsort(ids)
                lo, hi = np.searchsorted(ids[by_id], q_ids), np.searchsorted(ids[by_id], q_ids, "right")
                found = shard.search(get("q_x").reshape(len(q_ids), dim).astype(np.float64), k, [by_id[a:b] for a, b in zip(lo, hi)])
                for q_id, (at, scores, depth) in zip(q_ids, found):
                    out += [(q_id, i, s, depth) for i, s in zip(ids[at], scores)]
                cols = list(zip(*out)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in cols], ["query_id", "id", "score", "depth"])

    found = tasks.repartition(max(n_shards, spark.sparkContext.defaultParallelism), "shard", "block").mapInArrow(run, "query_id long, id long, score long, depth long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    out = found.withColumn("rank", place).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("id").alias(id_col), "score", F.col("depth").alias("depth_read"))
