"""Nearest neighbours by a forest of hash prefixes.

A vector's hash in a tree is a string of sign bits of random projections around the centre of the data.
A tree is the sorted array of the hashes, so all vectors that share a prefix lie side by side. A query goes
down every tree to its longest matching prefix; then all trees go up together, one bit at a time, and the
vectors that join are candidates, measured exactly. The ascent ends when a vector as near as the worst
neighbour held so far would have been met in some tree but for a chance below `miss`: that follows from
the largest angle that the lengths of the block's vectors allow, the depth and the number of trees. So clustered data end early and data without structure go on.

Vectors are dealt into blocks, queries into blocks, and each pair of blocks is a task of bounded size. Only
k neighbours for each query leave it, and the best of these are the answer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossbook.session import stage

BLOCK, QUERIES = 16_384, 8_192       # vectors and queries of a task
SAMPLE = 5_000                       # vectors that the centre is fitted on, about


@dataclass(frozen=True)
class ForestPlan:
    """Trees, bits of a hash string, chance to miss a neighbour, seed of the projections."""
    trees: int = 40
    bits: int = 24
    miss: float = 0.05
    seed: int = 7


class Forest:
    """Sorted hash strings of one block's vectors."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, plan: ForestPlan):
        self.plan, self.centre, self.vectors = plan, centre, vectors
        self.planes = np.random.default_rng(plan.seed).normal(size=(vectors.shape[1], plan.trees * plan.bits)).astype(np.float32)
        hashes = self.hash(vectors)
        self.order = np.argsort(hashes, 1, kind="stable")
        self.sorted = np.take_along_axis(hashes, self.order, 1)
        norms = np.linalg.norm(vectors - centre, axis=1)
        self.least, self.most = float(norms.min()), float(norms.max())

    def hash(self, vectors: np.ndarray) -> np.ndarray:
        """(trees, vectors) strings as integers."""
        bits = ((vectors - self.centre).astype(np.float32) @ self.planes > 0).reshape(len(vectors), self.plan.trees, self.plan.bits)
        return (bits @ (1 << np.arange(self.plan.bits - 1, -1, -1))).T

    def agreement(self, query: np.ndarray, distance: float) -> float:
        """Least chance that one bit of the query equals that of a vector within this distance, of any length in the block."""
        a = max(float(np.linalg.norm(query - self.centre)), 1e-12)
        # the widest angle is at the length of a tangent's end, or at the possible length next to it
        low, high = max(self.least, a - distance), min(self.most, a + distance)
        b = min(max(np.sqrt(max(a * a - distance * distance, 0.0)), low), high)
        if b < 1e-12:
            return 0.0
        return 1 - float(np.arccos(np.clip((a * a + b * b - distance * distance) / (2 * a * b), -1, 1))) / np.pi

    def nearest(self, query: np.ndarray, hashes: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of the k nearest found; `own` marks rows that are the query itself."""
        plan = self.plan
        low = np.array([np.searchsorted(s, h) for s, h in zip(self.sorted, hashes)])
        high = low.copy()
        seen = own.copy()
        found, far = np.zeros(0, np.int64), np.zeros(0)
        for depth in range(plan.bits, -1, -1):
            rest = plan.bits - depth
            first = (hashes >> rest) << rest
            joined = []
            for t in range(plan.trees):
                s = self.sorted[t]
                lo, hi = np.searchsorted(s, first[t]), np.searchsorted(s, first[t] + (1 << rest))
                if lo < low[t]:
                    joined.append(self.order[t, lo:low[t]])
                if hi > high[t]:
                    joined.append(self.order[t, high[t]:hi])
                low[t], high[t] = min(low[t], lo), max(high[t], hi)
            if joined:
                fresh = np.unique(np.concatenate(joined))
                fresh = fresh[~seen[fresh]]
                seen[fresh] = True
                found = np.concatenate([found, fresh])
                far = np.concatenate([far, np.sqrt(((self.vectors[fresh] - query) ** 2).sum(1))])
                if len(found) > k:
                    best = np.lexsort((ids[found], far))[:k]
                    found, far = found[best], far[best]
            if len(found) >= k and (1 - self.agreement(query, float(far.max())) ** depth) ** plan.trees <= plan.miss:
                break
        best = np.lexsort((ids[found], far))[:k]
        return found[best], far[best]


def usable(vectors: DataFrame, vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v) without null and zero vectors and those with null or non-finite components."""
    v = F.col(f"`{column}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, plan: ForestPlan = ForestPlan()) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query its k nearest of the vectors with other ids, by
    Euclidean distance in double precision, ties to the smaller id.

    Both are (vec_id, embedding, ...); unusable vectors take no part, and only vectors of a query's own length
    are compared with it. Equal vectors are at distance 0. Repeated ids among the vectors are vectors each;
    a repeated query is searched once. Empty tables give an empty result. Other columns are ignored.
    """
    every = stage(usable(vectors).withColumn("dim", F.size("v")), "vectors")
    asked = stage(usable(queries).withColumn("dim", F.size("v")).dropDuplicates(["vec_id"]), "asked")
    n, m = every.count(), asked.count()
    blocks, rounds = max(1, -(-n // BLOCK)), max(1, -(-m // QUERIES))
    part = F.pmod(F.xxhash64(F.lit("centre"), "vec_id"), F.lit(2**30)) < F.lit(int(2**30 * min(1.0, SAMPLE / max(n, 1))))
    centres: dict[int, np.ndarray] = {}
    for row in every.filter(part).select("dim", F.posexplode("v").alias("i", "x")).groupBy("dim", "i").agg(F.avg("x").alias("x")).collect():
        centres.setdefault(row.dim, np.zeros(row.dim))[row.i] = row.x
    left = every.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks).cast("long"))).withColumn(
        "round", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rounds - 1).cast("long"))))
    right = asked.withColumn("round", F.pmod(F.xxhash64("vec_id"), F.lit(rounds).cast("long"))).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def run(have: pa.Table, want: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if have.num_rows and want.num_rows:
            def matrix(t: pa.Table) -> np.ndarray:
                return t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            v, q = matrix(have), matrix(want)
            ids = have.column("vec_id").to_numpy()
            forest = Forest(v, centres.get(v.shape[1], np.zeros(v.shape[1])), plan)
            for query, name, hashes in zip(q, want.column("vec_id").to_pylist(), forest.hash(q).T):
                at, far = forest.nearest(query, hashes, ids == name, ids, k)
                out += [(name, int(ids[a]), float(d)) for a, d in zip(at, far)]
        cols = list(zip(*out)) if out else [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    keys = ("dim", "block", "round")
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
