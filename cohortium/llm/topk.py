"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Vectors are dealt to shards of bounded size by a hash of their id. A shard's task builds a ball tree (centre and radius
per node) and lets blocks of queries stream through it. A node's upper bound is q.c + |q| r; nodes are visited from the
highest bound down, and a query leaves a node aside when the bound is below its kth score. That score is shared: each
query first searches one shard, and carries the kth score found there into all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .texts import importable

SHARD_ROWS = 8192
LEAF = 64
QUERY_BLOCK = 256


def whole_vector(c: str, scale: int = 256) -> Column:
    """Components as floor(scale * x) of the double x; null if the vector or a component is null or not finite."""
    x = F.transform(F.col(c), lambda v: v.cast("double"))
    limit = F.lit(float("inf"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < limit))
    return F.when(sound, F.transform(x, lambda v: F.floor(v * scale)))


class BallTree:
    """Nodes in levels; the children of node i of a level are nodes 2i and 2i+1 of the next, the last level are leaves."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        vectors, ids = vectors[order], ids[order]
        depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / leaf))))
        parts = [np.arange(len(ids))]
        for _ in range(depth):
            parts = [half for part in parts for half in self.halves(vectors, part)]
        order = np.concatenate(parts)
        self.vectors, self.ids = vectors[order], ids[order]
        edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.levels = []
        for level in range(depth + 1):
            cut = edges[::1 << (depth - level)]
            centres, radii = [], []
            for a, b in zip(cut, cut[1:]):
                own = self.vectors[a:b]
                centre = own.mean(axis=0) if b > a else np.zeros(vectors.shape[1])
                centres.append(centre)
                radii.append(np.sqrt(((own - centre) ** 2).sum(axis=1).max()) if b > a else -np.inf)
            self.levels.append((np.array(centres), np.array(radii)))
        self.edges = edges

    @staticmethod
    def halves(vectors: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Halves by the projection on the line through two far points; equal projections stay in order of id."""
        own = vectors[part]
        if not len(part):
            return part, part
        first = own[((own - own[0]) ** 2).sum(axis=1).argmax()]
        second = own[((own - first) ** 2).sum(axis=1).argmax()]
        order = np.argsort(own @ (second - first), kind="stable")
        half = len(part) // 2
        # members in order of id again, so that the smallest ids of equal vectors are met first
        return np.sort(part[order[:half]]), np.sort(part[order[half:]])

    def search(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best of each query (ties to the smaller id, -1 where there are fewer), its own id left out.

        ``floor`` is a score that k rows elsewhere reach; what lies below it need not be found.
        """
        length = np.sqrt((queries ** 2).sum(axis=1))
        slack = 1e-9 * (1 + length * np.sqrt((self.vectors ** 2).sum(axis=1).max(initial=0)))
        alive = np.ones((len(queries), 1), bool)
        for centres, radii in self.levels:  # whole levels at once; a node below the floor takes its subtree along
            bound = queries @ centres.T + length[:, None] * radii + slack[:, None]
            alive = alive.repeat(len(radii) // alive.shape[1], axis=1) & (bound >= floor[:, None])
        bound = np.where(alive, bound, -np.inf)
        best = np.full((len(queries), k), -np.inf)
        best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
        rank = np.argsort(-bound, axis=1, kind="stable")
        kth = floor.copy()
        for step in range(rank.shape[1]):
            leaf = rank[:, step]
            open_ = np.flatnonzero(bound[np.arange(len(queries)), leaf] >= kth)
            open_ = open_[np.isfinite(bound[open_, leaf[open_]])]
            if not len(open_):
                break
            for node in np.unique(leaf[open_]).tolist():  # all queries that want this leaf now
                who = open_[leaf[open_] == node]
                a, b = self.edges[node], self.edges[node + 1]
                score = queries[who] @ self.vectors[a:b].T
                ids = np.broadcast_to(self.ids[a:b], score.shape)
                score = np.where(ids == own[who][:, None], -np.inf, score)
                score, ids = np.concatenate([best[who], score], axis=1), np.concatenate([best_id[who], ids], axis=1)
                keep = np.lexsort((ids, -score), axis=1)[:, :k]
                best[who], best_id[who] = np.take_along_axis(score, keep, 1), np.take_along_axis(ids, keep, 1)
            kth = np.maximum(kth, best[:, -1])
        return best, np.where(np.isfinite(best), best_id, -1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "vector",
          shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``k`` best rows of each query: query_id, rank (from 1), ``key``, score (an exact integer inner product).

    Both sides have ``key`` and ``vector`` (an array of whole numbers, all of one length). A row is no candidate of the
    query of its own key. Ties go to the smaller key; fewer candidates give fewer rows. Rows with a null key or vector take
    no part. Keys must be unique. An empty side gives an empty result.
    """
    importable(vectors)

    def sound(df):
        return df.where(F.col(vector).isNotNull() & F.col(key).isNotNull() & (F.size(vector) > 0)).select(
            F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))

    rows, asked = stage(sound(vectors), "vectors"), stage(sound(queries), "queries")
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), F.lit(0).alias("side"), "id", "v",
                        F.lit(None).cast("double").alias("floor"))
    home = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards))

    def searched(ask: DataFrame) -> DataFrame:
        both = dealt.unionByName(ask.select("shard", F.lit(1).alias("side"), "id", "v", "floor"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, tree, own, ids = None, None, [], []
            for batch in batches:
                flat = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                numbers, sides = batch.column("shard").to_numpy(), batch.column("side").to_numpy()
                keys, floors = batch.column("id").to_numpy(), batch.column("floor").to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero(np.diff(numbers) | np.diff(sides)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                    if numbers[a] != shard:
                        shard, tree, own, ids = numbers[a], None, [], []
                    if sides[a] == 0:
                        own.append(flat[a:b])
                        ids.append(keys[a:b])
                        continue
                    if tree is None:
                        if not own:
                            continue
                        tree = BallTree(np.concatenate(own), np.concatenate(ids))
                    for at in range(a, b, QUERY_BLOCK):
                        to = min(b, at + QUERY_BLOCK)
                        floor = np.nan_to_num(floors[at:to].astype(float), nan=-np.inf)
                        score, found = tree.search(flat[at:to], keys[at:to], floor, k)
                        good = found >= 0
                        who = np.repeat(keys[at:to], good.sum(axis=1))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(who), pa.array(found[good]), pa.array(score[good].astype(np.int64))], ["query_id", "id", "score"])

        return (both.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "side")
                .mapInArrow(run, "query_id long, id long, score long"))

    first = stage(searched(asked.select("*", home.alias("shard"), F.lit(None).cast("double").alias("floor"))), "first")
    if shards == 1:
        found = first
    else:
        floors = first.groupBy("query_id").agg(
            F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("floor"))
        carried = asked.join(floors, F.col("id") == F.col("query_id"), "left").drop("query_id")
        others = carried.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != home)
        found = first.unionByName(searched(others.withColumn("shard", F.col("shard").cast("long"))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(key), "score"))
