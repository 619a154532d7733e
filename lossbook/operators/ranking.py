"""Exact order statistics without a global sort in one task.

A group of more than BUDGET rows is cut into parts by approximate quantile edges (a mergeable sketch, so no shuffle of
rows); parts that may still be above the budget are cut again, and so on. The depth follows from the size of
the largest group: a cut by 63 edges leaves at most a fiftieth of the rows in a part, but for rows of one value, which
get a part of their own and are one row in a tally. Totals of parts are summed up the levels and prefix-summed down
them, so no window sees more than the children of one part. The edges decide how work is split, never the result. They are
written to a stage table, so every later use sees the same edges, also after a retry. NULL keys are a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossbook.session import stage

BUDGET = 1_000_000                      # rows that one task may order
EDGES, ACCURACY, SHRINK = 63, 2000, 50
_STEPS = (32, 16, 8, 4, 2, 1)
_BITS = 7                               # bits of a part's number that one cut adds
_ALL = "_all"


def unpivot(frame: DataFrame, features: Sequence[str], keep: Sequence[str] = (), kind: str = "double") -> DataFrame:
    """Wide to long: one (feature, value) row per listed column."""
    cols = frame.select(*keep, *[F.col(f"`{n}`").cast(kind).alias(n) for n in features])
    return cols.unpivot(list(keep), list(features), "feature", "value")


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where NULL equals NULL; the keys are those of the left side."""
    right = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return left.join(right, same, how).drop(*[f"_of_{k}" for k in keys])


def depth_of(rows: DataFrame, by: Sequence[str], budget: int) -> int:
    """Cuts after which no part of any group is above the budget."""
    n = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    depth = 0
    while n > budget:
        n, depth = -(-n // SHRINK), depth + 1
    return depth


def with_parts(rows: DataFrame, by: Sequence[str], value: str, depth: int) -> DataFrame:
    """Add `_part`, a number that rises with the value within a group, by `depth` cuts."""
    probs = [i / (EDGES + 1) for i in range(1, EDGES + 1)]
    rows = rows.withColumn("_part", F.lit(0).cast("long"))
    for level in range(depth):
        keys = [*by, "_part"]
        edges = stage(rows.groupBy(*keys).agg(F.percentile_approx(value, probs, ACCURACY).alias("_edges")), f"edges-{level}")
        out = join_on(rows, edges, keys).withColumn("_below", F.lit(0))
        for step in _STEPS:
            out = out.withColumn("_below", F.col("_below") + F.when(F.element_at("_edges", F.col("_below") + step) < F.col(value), step).otherwise(0))
        same = F.coalesce(F.get("_edges", "_below") == F.col(value), F.lit(False)).cast("int")
        rows = out.withColumn("_part", F.shiftleft("_part", _BITS) + 2 * F.col("_below") + same).drop("_edges", "_below")
    return rows


def part_offsets(totals: DataFrame, by: Sequence[str], sums: Sequence[str], depth: int) -> DataFrame:
    """For (by, _part, sums), one row per part: `<column>_before` over the parts before, and `<column>_all`."""
    by, up = list(by), F.shiftright("_part", _BITS)
    current, levels = stage(totals, "parts"), []
    for _ in range(depth):
        before = Window.partitionBy(*by, up).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        levels.append(current.select(*by, "_part", up.alias("_up"), *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_own_{s}") for s in sums]))
        current = current.groupBy(*by, up.alias("_part")).agg(*[F.sum(s).alias(s) for s in sums])
    out = current.select(*by, "_part", *[(F.col(s) - F.col(s)).alias(f"{s}_before") for s in sums], *[F.col(s).alias(f"{s}_all") for s in sums])
    for level in reversed(levels):
        out = join_on(level, out.withColumnRenamed("_part", "_up"), [*by, "_up"]).select(
            *by, "_part", *[(F.col(f"_own_{s}") + F.col(f"{s}_before")).alias(f"{s}_before") for s in sums], *[f"{s}_all" for s in sums])
    return out


def running_totals(tallied: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (), budget: int | None = None) -> DataFrame:
    """For rows that are unique per (by, value): the sum of each column over smaller values.

    Adds `<column>_before` and `<column>_all` (the group's total).
    """
    by = list(by)
    rows = stage(tallied if by else tallied.withColumn(_ALL, F.lit(0)), "tally")
    keys = by or [_ALL]
    depth = depth_of(rows, keys, budget or BUDGET)
    if depth == 0:
        before = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select(*tallied.columns, *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before") for s in sums],
                           *[F.sum(s).over(Window.partitionBy(*keys)).alias(f"{s}_all") for s in sums])
    parted = with_parts(rows, keys, value, depth)
    totals = part_offsets(parted.groupBy(*keys, "_part").agg(*[F.sum(s).alias(s) for s in sums]), keys, sums, depth)
    inner = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return join_on(parted, totals, [*keys, "_part"]).select(
        *tallied.columns, *[(F.col(f"{s}_before") + F.coalesce(F.sum(s).over(inner), F.lit(0))).alias(f"{s}_before") for s in sums],
        *[f"{s}_all" for s in sums])


def quantile_grid(rows: DataFrame, m: int, by: Sequence[str], value: str, count: str | None = None, budget: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles at 0, 1/m, ..., 1 of every group: (by, n, grid array).

    Rank j sits at j*(n-1)/m; whole and fractional parts come from integer arithmetic. With `count` the rows are a tally.
    """
    by = list(by)
    rows = rows.filter(F.col(value).isNotNull()).select(*by, value, (F.col(count) if count else F.lit(1)).cast("long").alias("_cnt"))
    depth = depth_of(rows, by, budget or BUDGET)

    # first and last grid index whose neighbouring ranks can fall inside [low, high]
    def grid_range(low: Column, high: Column) -> tuple[Column, Column]:
        span = F.greatest(F.col("_n") - 1, F.lit(1))
        first = F.greatest(F.floor((low - 1) * m / span), F.lit(0)).cast("int")
        last = F.least(F.ceil((high + 1) * m / span), F.lit(m)).cast("int")
        return F.when(F.col("_n") == 1, 0).otherwise(first), F.when(F.col("_n") == 1, m).otherwise(last)

    if depth == 0:
        run = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        placed = rows.groupBy(*by, value).agg(F.sum("_cnt").alias("_cnt")).select(
            "*", F.coalesce(F.sum("_cnt").over(run), F.lit(0)).alias("_low"), F.sum("_cnt").over(Window.partitionBy(*by)).alias("_n"))
    else:
        parted = with_parts(rows, by, value, depth)
        sizes = stage(parted.groupBy(*by, "_part").agg(F.sum("_cnt").alias("_size")), "sizes")
        hist = join_on(sizes, part_offsets(sizes, by, ["_size"], depth), [*by, "_part"]).select(
            *by, "_part", "_size", F.col("_size_before").alias("_before"), F.col("_size_all").alias("_n"))
        first, last = grid_range(F.col("_before"), F.col("_before") + F.col("_size") - 1)
        counted = join_on(parted, hist.filter(first <= last).drop("_size"), [*by, "_part"]).groupBy(*by, "_part", "_before", "_n", value).agg(
            F.sum("_cnt").alias("_cnt"))
        run = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumn("_low", F.col("_before") + F.coalesce(F.sum("_cnt").over(run), F.lit(0)))
    placed = placed.withColumn("_high", F.col("_low") + F.col("_cnt") - 1)
    first, last = grid_range(F.col("_low"), F.col("_high"))
    hits = placed.filter(first <= last).withColumn("_j", F.explode(F.sequence(first, last)))
    rank = F.col("_j") * (F.col("_n") - 1)
    floor_rank = F.floor(rank / m)
    exact = F.pmod(rank, F.lit(m)) == 0
    ceil_rank = F.when(exact, floor_rank).otherwise(floor_rank + 1)

    def inside(r: Column) -> Column:
        return (r >= F.col("_low")) & (r <= F.col("_high"))

    per_j = hits.groupBy(*by, "_n", "_j").agg(
        F.max(F.when(inside(floor_rank), F.col(value))).alias("_lo"),
        F.max(F.when(inside(ceil_rank), F.col(value))).alias("_hi"))
    share = F.pmod(F.col("_j") * (F.col("_n") - 1), F.lit(m)) / F.lit(float(m))
    q = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * share
    return (per_j.groupBy(*by, F.col("_n").alias("n"))
            .agg(F.array_sort(F.collect_list(F.struct("_j", q.alias("q")))).alias("_g"))
            .select(*by, "n", F.col("_g.q").alias("grid")))


def average_ranks(rows: DataFrame, by: Sequence[str], value: str, budget: int | None = None) -> DataFrame:
    """(by, value, rank): tied values share their mean rank, ranks start at 1."""
    t = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_cnt"))
    r = running_totals(t, value, ["_cnt"], by, budget)
    return r.select(*by, value, (F.col("_cnt_before") + (F.col("_cnt") + 1) / 2).alias("rank"))


def distinct_counts(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Exact number of distinct values per group; equal values collapse before the shuffle."""
    return (rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
            .groupBy(*by).agg(F.count("*").alias("distinct")))


def most_frequent(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, mode, freq): the most frequent value, the smallest one on a tie."""
    t = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    best = F.min_by(F.struct(F.col(value).alias("mode"), F.col("_c").alias("freq")), F.struct(-F.col("_c"), F.col(value)))
    return t.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.mode", "_b.freq")


def smallest_by_hash(rows: DataFrame, key: str, hashed: Column, share: Mapping | float | None = None,
                     count: Column | None = None, strata: Sequence[str] = ()) -> DataFrame:
    """Mark the first k keys of every stratum in (hash, key) order with `chosen`.

    k is `count` (an expression over the stratum's size `_n`) or ceil(share * size). The hash
    has about a million slots: their histogram finds the slot in which the k-th key lies, and
    only that slot's keys are ordered. The rows themselves are filtered by the cut, not sorted.
    Cuts are one row per stratum; NULL is a stratum. The cuts are the side that is sent to the tasks: rows laid out by an
    explode are estimated by the size before it, and would be sent instead.
    """
    strata = list(strata)
    base = rows.withColumn("_h", hashed)
    keys = strata or [_ALL]
    slots = (base if strata else base.withColumn(_ALL, F.lit(0))).groupBy(*keys, "_h").agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*keys).orderBy("_h")
    upto = slots.select(*keys, "_h", "_c", F.sum("_c").over(order).alias("_upto"),
                        F.sum("_c").over(Window.partitionBy(*keys)).alias("_n"))
    k = count if count is not None else F.ceil(F.col("_n") * float(share))
    cut = upto.withColumn("_k", k.cast("long")).filter(
        (F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_c") < F.col("_k"))).select(
        *keys, F.col("_h").alias("_cut_h"), (F.col("_k") - F.col("_upto") + F.col("_c")).alias("_take"))
    edge = (base if strata else base.withColumn(_ALL, F.lit(0))).join(
        F.broadcast(cut.withColumnsRenamed({k: f"_of_{k}" for k in keys})), reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])).filter(
        F.col("_h") == F.col("_cut_h")).drop(*[f"_of_{k}" for k in keys])
    numbered = edge.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(key)))
    last = numbered.filter(F.col("_rn") == F.col("_take")).select(*keys, "_cut_h", F.col(key).alias("_cut_key"))
    last = last.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    mine = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    joined = (base if strata else base.withColumn(_ALL, F.lit(0))).join(last if strata else F.broadcast(last), mine, "left")
    inside = (F.col("_h") < F.col("_cut_h")) | ((F.col("_h") == F.col("_cut_h")) & (F.col(key) <= F.col("_cut_key")))
    return joined.select(*rows.columns, F.coalesce(inside, F.lit(False)).alias("chosen"))


def fold_by_hash(rows: DataFrame, key: str, hashed: Column, shares: Sequence[float], stratum: str) -> DataFrame:
    """Add `fold`: how many cuts a row lies above in (hash, key) order of its stratum.

    Cut i is the key at position ceil(share i * size). All cuts come from one histogram of hash
    slots and one look at the slots they fall into; each row then meets its stratum's few cuts.
    """
    base = rows.withColumn("_h", hashed)
    order = Window.partitionBy(stratum).orderBy("_h")
    upto = base.groupBy(stratum, "_h").agg(F.count("*").alias("_c")).select(
        F.col(stratum).alias("_of"), F.col("_h").alias("_cut_h"), "_c", F.sum("_c").over(order).alias("_upto"),
        F.sum("_c").over(Window.partitionBy(stratum)).alias("_n"))
    at = F.posexplode(F.array(*[F.ceil(F.col("_n") * float(x)).cast("long") for x in shares])).alias("_i", "_k")
    cut = upto.select("_of", "_cut_h", (F.col("_upto") - F.col("_c")).alias("_start"), "_upto", at).filter(
        (F.col("_upto") >= F.col("_k")) & (F.col("_start") < F.col("_k")))
    edge = base.select(F.col(stratum).alias("_s"), "_h", F.col(key).alias("_cut_key")).join(
        F.broadcast(cut), F.col("_s").eqNullSafe(F.col("_of")) & (F.col("_h") == F.col("_cut_h")))
    place = F.row_number().over(Window.partitionBy("_of", "_i").orderBy("_cut_key"))
    cuts = (edge.withColumn("_rn", place).filter(F.col("_rn") == F.col("_k") - F.col("_start"))
            .groupBy("_of").agg(F.collect_list(F.struct("_cut_h", "_cut_key")).alias("_cuts")))
    above = F.filter("_cuts", lambda c: (F.col("_h") > c["_cut_h"]) | ((F.col("_h") == c["_cut_h"]) & (F.col(key) > c["_cut_key"])))
    return base.join(cuts, F.col(stratum).eqNullSafe(F.col("_of")), "left").select(*rows.columns, F.size(above).alias("fold"))
