"""Approximate nearest neighbours by a permutation index.

Pivots are vectors of the table. Each vector is stood for by its nearest pivots in order; an inverted file per pivot
posts (vector, place of the pivot in its order). A query visits the files of its own nearest pivots, sums the footrule
distance |place in query - place in vector| (a pivot missing from an order counts as just after its end), and the
vectors with the least sums are ranked again by exact inner product in double precision.

Equal vectors are one entry of the index, with their k + 1 least vec_ids (repeated up to k times): a query needs no
more of them, its own left out. Pivots are distinct vectors, and an entry is spread into its rows after the second ranking.

Inner products are turned into angles by one more dimension that gives all rows the largest norm. The index is cut
into shards and the queries into blocks, each shard meets each block in one task, and at most k rows a query leave it.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold a null or non-finite component
take no part. Components may have any size that a double holds, as directions are scaled first. Rows that repeat a vec_id are candidates like any other, but a query never finds its own vec_id; queries
that repeat one count once, with the least vector. Extra columns are dropped. Empty table, empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch

PIVOTS = 512
PREFIX = 64
SHARD_ROWS = 16384
BLOCK_QUERIES = 8192
CANDIDATES = 0.2
LEAST_CANDIDATES = 1000


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.where(F.exists("v", lambda x: x != 0))
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return rows.where(F.size("v") == (width["w"] if width else 0))


class InvertedFiles:
    """The index of one shard."""

    def __init__(self, rows: np.ndarray, pivots: np.ndarray, prefix: int):
        self.prefix = min(prefix, len(pivots))
        order = orders(rows, pivots, self.prefix)
        by = np.argsort(order.ravel(), kind="stable")
        self.row, self.place = by // self.prefix, (by % self.prefix).astype(np.int32)
        self.edge = np.searchsorted(order.ravel()[by], np.arange(len(pivots) + 1))
        self.size = len(rows)

    def nearest(self, order: np.ndarray, most: int) -> np.ndarray:
        """Rows with the least footrule distance to an order of pivots."""
        far = np.full(self.size, self.prefix * (self.prefix + 1), np.int32)
        for place, pivot in enumerate(order.tolist()):
            a, b = self.edge[pivot], self.edge[pivot + 1]
            # found after all: the distance of places replaces that of a pivot missing from both orders
            far[self.row[a:b]] += np.abs(self.place[a:b] - place) - (self.prefix - place) - (self.prefix - self.place[a:b])
        if most >= self.size:
            return np.arange(self.size)
        return np.argpartition(far, most)[:most]


def orders(rows: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    near = rows @ pivots.T
    top = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix] if prefix < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(near), 1))
    by = np.lexsort((top, -np.take_along_axis(near, top, 1)), axis=1)
    return np.take_along_axis(top, by, 1)


def raised(rows: np.ndarray, most2: float) -> np.ndarray:
    """Rows (scaled so that none has a component over 1) with one more component, all of the largest norm then, at unit length."""
    rest = np.sqrt(np.maximum(0.0, most2 - (rows * rows).sum(axis=1)))
    return np.hstack([rows, rest[:, None]]) / np.sqrt(most2)


def search(vectors: DataFrame, k: int = 20, every: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX, candidates: float = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score for the queries whose vec_id is divisible by `every`."""
    rows = usable(vectors)
    # zeros of either sign are one value
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    times = rows.groupBy("v", "vec_id").agg(F.count("*").alias("times"))
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = times.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    each = F.array_repeat("vec_id", F.least("times", F.lit(k)).cast("int"))
    distinct = few.groupBy("v").agg(F.array_sort(F.flatten(F.collect_list(each))).alias("ids"))
    top = distinct.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 1.0
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / top) * (x / top))
    facts = distinct.agg(F.count("*").alias("n"), F.max(norm2).alias("most2")).first()
    queries = rows.where(F.col("vec_id") % every == 0).count()
    arrow = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    spec = "query_id long, vec_id long, score double"
    n, most2 = facts["n"], facts["most2"] or 1.0
    # a bounded sample: the rows with the least hashes
    chosen = distinct.orderBy(F.xxhash64("v"), "v").limit(pivots).select("v").collect()
    aims = raised(np.array([r["v"] for r in chosen]) / top, most2) if chosen else np.zeros((1, 1))
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-queries // BLOCK_QUERIES))
    lay = lambda count, other: F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
    index = distinct.select("ids", "v", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), lay(shards, blocks).alias("block"))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), lay(blocks, shards).alias("shard"))

    def matrix(table: pa.Table) -> np.ndarray:
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(table.num_rows, -1) if table.num_rows else np.empty((0, 1))

    def meet(own: pa.Table, queries: pa.Table) -> pa.Table:
        data, asks = matrix(own), matrix(queries)
        names, out = queries.column("vec_id").to_numpy(), []
        if len(data) and len(names):
            lists = own.column("ids").combine_chunks()
            # each entry has one id at least
            ids, edges = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            files = InvertedFiles(raised(data / top, most2), aims, prefix)
            near = asks / np.abs(asks).max(axis=1, keepdims=True)
            order = orders(np.hstack([near / np.sqrt((near * near).sum(axis=1, keepdims=True)), np.zeros((len(asks), 1))]), aims, files.prefix)
            most = max(LEAST_CANDIDATES, int(candidates * len(data)))
            for i, name in enumerate(names):
                near = files.nearest(order[i], most)
                near = near[(ids[edges[near]] != name) | (ids[edges[near + 1] - 1] != name)]
                # summed in one order for all rows, unlike a matrix product
                score = (data[near] * asks[i]).sum(axis=1)
                # k entries hold k rows besides the query's own; more of them if scores tie
                if len(near) > k:
                    some = score >= np.partition(score, len(score) - k)[len(score) - k]
                    near, score = near[some], score[some]
                if not len(near):
                    continue
                found = np.concatenate([ids[edges[x] : edges[x + 1]] for x in near])
                score = np.repeat(score, edges[near + 1] - edges[near])
                found, score = found[found != name], score[found != name]
                by = np.lexsort((found, -score))[:k]
                out.append((np.full(len(by), name), found[by], score[by]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        return pa.Table.from_batches([batch(arrow, columns)])

    found = index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(lambda a, b: meet(a, b), spec)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
