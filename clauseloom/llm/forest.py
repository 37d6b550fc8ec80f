"""Approximate nearest neighbours by a hash-prefix forest.

Each tree is a sorted array of long hash strings (signs of random projections). A query descends to its
longest matching prefix in every tree; then all trees ascend together, one bit at a time, and the rows
under the shortened prefixes are scored. Nothing caps the candidates: a query stops ascending when the
chance that a row as near as its current ``k``-th was missed by all trees is at most ``miss``; near the
root that is the whole block.

Rows are dealt into blocks of at most about ``ROWS`` by hash. A task builds the forest of a block once and
lets the queries stream through it; the results of a query's blocks are merged by rank. Only where there are
fewer blocks than tasks to keep busy, blocks are held more than once, for a share of the queries each.
For largest inner products rows get one more coordinate, so that they all have one norm; the nearest
by angle is then the one with the largest product. Scores are computed anew from the original vectors
in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped

#: Rows of a block, and queries that are searched at once.
ROWS, QUERIES = 65_536, 512
TREES, BITS = 48, 24


class Forest:
    def __init__(self, rows: np.ndarray, most: float, seed: int = 3):
        """``most``: the greatest norm of all rows."""
        planes = np.random.default_rng(seed).normal(size=(rows.shape[1] + 1, TREES * BITS)).astype(np.float32)
        self.planes, self.most = planes, most
        scaled = rows / most
        last = np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(1)))
        self.rows = np.concatenate([scaled, last[:, None]], axis=1).astype(np.float32)
        strings = self.hashed(self.rows)
        self.order = np.argsort(strings, axis=0, kind="stable").T.copy()
        self.strings = np.take_along_axis(strings, self.order.T, axis=0).T.copy()

    def hashed(self, vectors: np.ndarray) -> np.ndarray:
        """A string of BITS bits for each vector and tree, as an integer."""
        out = np.zeros((len(vectors), TREES), np.int64)
        for start in range(0, len(vectors), 4096):
            signs = (vectors[start : start + 4096] @ self.planes > 0).reshape(-1, TREES, BITS)
            out[start : start + 4096] = signs @ (1 << np.arange(BITS - 1, -1, -1))
        return out

    def search(self, queries: np.ndarray, k: int, miss: float) -> list[np.ndarray]:
        """For each query the rows that may be among the ``k`` nearest, of those found."""
        units = queries / np.maximum(np.sqrt((queries * queries).sum(1)), 1e-300)[:, None]
        units = np.concatenate([units, np.zeros((len(units), 1))], axis=1).astype(np.float32)
        strings = self.hashed(units)
        # the rows under each prefix of each length: places in the sorted arrays
        low = np.empty((BITS + 1, len(units), TREES), np.int64)
        high = np.empty_like(low)
        for t in range(TREES):
            for length in range(BITS + 1):
                rest = (1 << (BITS - length)) - 1
                low[length, :, t] = np.searchsorted(self.strings[t], strings[:, t] & ~rest)
                high[length, :, t] = np.searchsorted(self.strings[t], strings[:, t] | rest, side="right")
        k = min(k, len(self.rows))
        out = []
        for q in range(len(units)):
            longest = BITS
            while longest and not (high[longest, q] > low[longest, q]).any():
                longest -= 1
            seen = np.zeros(len(self.rows), bool)
            found, scores, total = [], [], 0
            for length in range(longest, -1, -1):
                new = np.zeros(0, np.int64)
                if length == 0:
                    new = np.flatnonzero(~seen)
                else:
                    under = [self.order[t, i:j] for t, (i, j) in enumerate(zip(low[length, q].tolist(), high[length, q].tolist(), strict=True)) if j > i]
                    if under:
                        new = np.concatenate(under)
                        new = np.unique(new[~seen[new]])
                seen[new] = True
                if len(new):
                    found.append(new)
                    scores.append(self.rows[new] @ units[q])
                    total += len(new)
                if total >= k:
                    every = np.concatenate(scores)
                    worst = np.partition(every, total - k)[total - k]
                    same = 1 - np.arccos(np.clip(worst, -1, 1)) / np.pi
                    if (1 - same**length) ** TREES <= miss:
                        break
                    found, scores = [np.concatenate(found)], [every]
            every, scores = np.concatenate(found), np.concatenate(scores)
            worst = np.partition(scores, total - k)[total - k]
            out.append(every[scores >= worst - 1e-5])
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows that take part, once for each id, with the vectors as doubles.

    Rows without an id or a vector, with a null or non-finite component, of zeros only, or of another
    length than most rows have (ties: the greater) take no part; of rows with one id the least vector does.
    """
    v = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    good = vectors.where(F.col("vec_id").isNotNull()).select("vec_id", F.when(fine, v).alias("v")).where("v is not null")
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return good.where(F.size("v") == (sizes["d"] if sizes else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, miss: float = 0.08) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the largest inner products found for each query row.

    Ties go to the smaller vec_id; a row isn't its own neighbour. See :func:`usable` for rows that take
    no part. Other columns are ignored; an empty table gives an empty result.
    """
    rows = usable(vectors.select("vec_id", "embedding"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    n, asked, most = rows.agg(F.count(F.lit(1)), F.count_if(is_query), F.max(norm)).first()
    row_blocks = max(1, ceil(n / ROWS))
    shares = max(1, min(ceil(2 * vectors.sparkSession.sparkContext.defaultParallelism / row_blocks), ceil(asked / 32)))
    hashed = lambda salt, count: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    own = rows.select("vec_id", "v", hashed(2, row_blocks).alias("block"), F.lit(False).alias("asks")).withColumn("share", every(shares))
    asking = rows.where(is_query).select("vec_id", "v", every(row_blocks).alias("block"), F.lit(True).alias("asks"), hashed(1, shares).alias("share"))
    dealt = own.unionByName(asking).repartition("block", "share").sortWithinPartitions("block", "share", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ids, x, forest = None, [], None, None, None
        for batch in batches:
            if not len(batch):
                continue
            block, share, asks, vec_id = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            matrix = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(share) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)], strict=True):
                if now != (block[start], share[start]):
                    now, held, forest = (block[start], share[start]), [], None
                if not asks[start]:
                    held.append((vec_id[start:stop].copy(), matrix[start:stop].copy()))
                    continue
                if not held and forest is None:
                    continue  # no rows fell into this block
                if forest is None:
                    ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
                    held, forest = [], Forest(x, most)
                for k in range(start, stop, QUERIES):
                    q, q_ids = matrix[k : min(k + QUERIES, stop)], vec_id[k : min(k + QUERIES, stop)]
                    out: list[tuple[np.ndarray, ...]] = []
                    for i, found in enumerate(forest.search(q, k_nearest + 1, miss)):
                        found = found[ids[found] != q_ids[i]]
                        scores = (x[found] * q[i]).sum(1)
                        best = np.lexsort((ids[found], -scores))[:k_nearest]
                        out.append((np.full(len(best), q_ids[i]), ids[found[best]], scores[best]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    k_nearest = k
    found = mapped(dealt.select("block", "share", "asks", "vec_id", "v"), run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
