"""Exact top-k by inner product, with candidates left out by distances to pivots.

A vector x gets one more component, sqrt(M^2 - |x|^2) with M the largest length, and a query gets 0 there; then
|q - x|^2 = |q|^2 + M^2 - 2 q.x, so the largest inner products are the smallest distances. Distances of all vectors to
a few dozen pivots are computed once and stored. For a query the largest difference of its distance and a vector's to
the same pivot is a lower bound on their distance. Candidates are evaluated in the order of the bound, until the bound
of the next says that it, and so all after it, is worse than the k-th best inner product found.

Vectors and queries are dealt into blocks, and each pair of blocks is a task of bounded size. A first wave of blocks
gives every query an inner product that its k best have at least; the other blocks start from it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossbook.session import stage

FIRST_READ = 256                     # candidates evaluated first; later reads double
EXACT = float(2**53)                 # below this, sums of whole doubles are exact


@dataclass(frozen=True)
class PivotPlan:
    """Results of a query; pivots; vectors they are chosen from, about; vectors and queries of a task."""
    k: int = 5
    pivots: int = 48
    sample: int = 4_000
    block: int = 16_384
    queries: int = 4_096


def integers(vectors: DataFrame, vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v, dim): floor(256 x) of each component, held within 64 bits; without vectors that are null or hold
    null or non-finite components."""
    x = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{column}`").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = F.lit(9.2e18)
    v = F.transform("x", lambda c: F.floor(F.greatest(F.least(256 * c, held), -held)).cast("long"))
    return x.filter(F.col("x").isNotNull() & finite).select("vec_id", v.alias("v")).withColumn("dim", F.size("v"))


def far_apart(rows: np.ndarray, count: int) -> np.ndarray:
    """Up to `count` rows, each the farthest from those chosen before it; the first is farthest from the mean."""
    chosen, far = [], ((rows - rows.mean(0)) ** 2).sum(1)
    for _ in range(min(count, len(rows))):
        at = int(far.argmax())
        if chosen and far[at] <= 0:
            break
        to = ((rows - rows[at]) ** 2).sum(1)
        far = to if not chosen else np.minimum(far, to)
        chosen.append(at)
    return rows[chosen]


def inner(vectors: np.ndarray, query: np.ndarray, top: float) -> np.ndarray:
    """Exact inner products; `top` bounds the size of any. Beyond 64 bits a product is held at the end of the range."""
    if top < EXACT:
        return (vectors.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    vectors = vectors.astype(np.int64)
    if top < 2.0**62:
        return vectors @ query
    lowest, highest = -2**63, 2**63 - 1
    return np.array([min(max(sum(a * b for a, b in zip(v, query.tolist())), lowest), highest) for v in vectors.tolist()], np.int64)


class Table:
    """Vectors of one block with their distances to the pivots."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray, far: np.ndarray, longest: float):
        self.unnamed = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        size = float(np.abs(vectors.astype(np.float64)).max(initial=0))
        self.size = size
        self.vectors = vectors.astype(np.float64) if size < 2**26 else vectors
        self.far, self.longest = np.ascontiguousarray(far.T), longest

    def best(self, name: int, query: np.ndarray, far: np.ndarray, k: int, least: int | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions and inner products of the k best rows of other ids with `least` or more, and the number evaluated."""
        q = query.astype(np.float64)
        whole = float(q @ q) + self.longest**2
        bound = np.zeros(len(self.ids))
        for mine, theirs in zip(far, self.far):
            np.maximum(bound, np.abs(theirs - mine), out=bound)
        # the doubles of the bounds are off by far less than this share of the squares they come from
        high = (whole - bound**2) / 2 + 1e-9 * (whole + 1)
        order = np.argsort(bound, kind="stable")
        order = order[(self.ids[order] != name) | self.unnamed[order]]
        top = self.size * float(np.abs(q).max(initial=0)) * max(len(q), 1)
        found, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        done, step, reach = 0, FIRST_READ, least
        while done < len(order) and (reach is None or high[order[done]] >= reach):
            at = order[done:done + step]
            if reach is not None:
                at = at[:np.searchsorted(-high[at], -float(reach), side="right")]
            product = inner(self.vectors[at], query, top)
            done, step = done + max(len(at), 1), 2 * step
            if reach is not None:
                at, product = at[product >= reach], product[product >= reach]
            found, score = np.concatenate([found, at]), np.concatenate([score, product])
            if len(found) > k:
                keep = np.lexsort((self.ids[found], self.unnamed[found], ~score))[:k]      # ~ turns the order of integers without overflow
                found, score = found[keep], score[keep]
            if len(found) == k:
                reach = max(int(score.min()), reach if reach is not None else -2**63)
        keep = np.lexsort((self.ids[found], self.unnamed[found], ~score))[:k]
        return found[keep], score[keep], done


def _matrix(column: pa.ChunkedArray, rows: int, dtype: type) -> np.ndarray:
    return np.ascontiguousarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(rows, -1) if rows else np.zeros((0, 0), dtype))


def with_distances(rows: DataFrame, pivots: dict[int, np.ndarray], longest: dict[int, float], queries: bool = False) -> DataFrame:
    """Add `far`, the distances to the pivots of a vector's dimension (empty where there are none), and `salt`, which
    differs from row to row. A query's further component is 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() << 40
        for batch in batches:
            far = []
            for v in batch.column("v").to_pylist():
                p = pivots.get(len(v))
                if p is None:
                    far.append(np.zeros(0))
                    continue
                x, top = np.array(v, np.float64), longest[len(v)] ** 2
                own = 0.0 if queries else math.sqrt(max(top - float(x @ x), 0.0))
                lift = np.sqrt(np.maximum(top - (p * p).sum(1), 0.0))
                far.append(np.sqrt(((p - x) ** 2).sum(1) + (lift - own) ** 2))
            salts = pa.array(salt + np.arange(batch.num_rows))
            salt += batch.num_rows
            columns = {c: batch.column(c) for c in ("vec_id", "v", "dim")}
            yield pa.record_batch(columns | {"far": pa.array([f.tolist() for f in far], pa.list_(pa.float64())), "salt": salts})

    return rows.mapInArrow(run, "vec_id long, v array<long>, dim int, far array<double>, salt long")


def search(vectors: DataFrame, queries: DataFrame, plan: PivotPlan = PivotPlan()) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query its k largest integer inner products with vectors of other
    ids, ties to the smaller id.

    Both are (vec_id, embedding, ...); a component counts as floor(256 x). Vectors that are null or hold null or
    non-finite components take no part, and only vectors of a query's own length are compared with it. Every row of
    `vectors` is a vector, also where ids repeat; those without id come last among ties. A query id that repeats is
    searched once, with its smallest vector; queries without id are left out. Products beyond 64 bits are held at the
    end of the range. Empty tables give an empty result. Other columns are ignored.
    """
    raw = integers(vectors)
    spark = raw.sparkSession
    sizes = raw.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)).alias("top"))
    n = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = F.pmod(F.xxhash64(F.lit("pivots"), "vec_id", "v"), F.lit(2**30)) < F.lit(int(2**30 * min(1.0, plan.sample / max(n, 1))))
    some: dict[int, list] = {}
    for row in raw.filter(share).select("v").distinct().collect():             # about plan.sample vectors at any size of the table
        some.setdefault(len(row.v), []).append(row.v)
    tops = {r.dim: math.sqrt(r.top) for r in sizes.filter(F.col("dim").isin([*some, -1])).collect()}
    pivots = {d: far_apart(np.array(sorted(rows), np.float64).reshape(len(rows), d), plan.pivots) for d, rows in some.items() if d}
    every = stage(with_distances(raw, pivots, tops), "distances")
    one = integers(queries).filter(F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    asked = stage(with_distances(one, pivots, tops, True).drop("salt"), "query_distances")
    blocks, rounds = max(1, -(-n // plan.block)), max(1, -(-asked.count() // plan.queries))
    first = math.isqrt(blocks - 1) + 1

    def run(have: pa.Table, want: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if have.num_rows and want.num_rows:
            ids = have.column("vec_id").combine_chunks()
            far, qfar = _matrix(have.column("far"), have.num_rows, np.float64), _matrix(want.column("far"), want.num_rows, np.float64)
            block = Table(ids, _matrix(have.column("v"), have.num_rows, np.int64), far, tops.get(have.column("dim")[0].as_py(), 0.0))
            names, v = ids.to_pylist(), _matrix(want.column("v"), want.num_rows, np.int64)
            for name, query, f, least in zip(want.column("vec_id").to_pylist(), v, qfar, want.column("least").to_pylist()):
                at, score, _ = block.best(name, query, f, plan.k, least)
                out += [(name, names[a], int(s)) for a, s in zip(at, score)]
        cols = list(zip(*out)) if out else [[], [], []]
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), cols)})

    left = every.withColumn("block", F.pmod(F.xxhash64("salt"), F.lit(blocks).cast("long"))).drop("salt").withColumn(
        "round", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rounds - 1).cast("long"))))
    keys = ("dim", "block", "round")

    def best_of(rows: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
        return rows.withColumn("rank", place).filter(F.col("rank") <= plan.k).select("query_id", "rank", "vec_id", "score")

    def wave(low: int, high: int, asked: DataFrame) -> DataFrame:
        right = asked.withColumn("round", F.pmod(F.xxhash64("vec_id"), F.lit(rounds).cast("long"))).withColumn(
            "block", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high - 1).cast("long"))))
        near = left.filter(F.col("block").between(low, high - 1)).groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
            run, "query_id long, vec_id long, score long")
        return best_of(near)

    early = wave(0, first, asked.withColumn("least", F.lit(None).cast("long")))
    if first == blocks:
        return early
    early = stage(early, "first_wave")
    least = early.filter(F.col("rank") == plan.k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    later = wave(first, blocks, asked.join(least, "vec_id", "left"))
    return best_of(early.drop("rank").unionByName(later.drop("rank")))
