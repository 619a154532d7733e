"""Equal-frequency bins (A5) of many columns at once, from one tally of their values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lossbook.operators.ranking import quantile_grid
from lossbook.session import stage

MISSING = "<missing>"


def usable(frame: DataFrame, features: Sequence[str]) -> list[str]:
    """The listed columns that the frame has and that can be cut into levels: no arrays, maps, structs or binaries."""
    levels = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return [n for n in features if n in frame.columns and isinstance(frame.schema[n].dataType, levels)]


def tally(frame: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, value, key, n, bads): one row per distinct value of each column, written once.

    Numbers stand in `value`, NULL where missing; other values in `key`, `<missing>` where missing. Numbers are laid out by one
    scan and other columns by another, each as plain values, and combined before the shuffle; `bads` sums the target.
    """
    def tallied(names: Sequence[str], numeric: bool) -> DataFrame:
        cells = [F.col(f"`{n}`").cast("double") if numeric else F.coalesce(F.col(f"`{n}`").cast("string"), F.lit(MISSING)) for n in names]
        long = frame.select(F.col(target).cast("int").alias("_y"), *[c.alias(n) for c, n in zip(cells, names)]).unpivot(
            ["_y"], list(names), "feature", "_cell")
        value, key = (F.col("_cell"), F.lit(None).cast("string")) if numeric else (F.lit(None).cast("double"), F.col("_cell"))
        return long.groupBy("feature", "_cell").agg(F.count("*").alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("bads")).select(
            "feature", value.alias("value"), key.alias("key"), "n", "bads")

    numbers = [n for n in features if isinstance(frame.schema[n].dataType, T.NumericType)]
    others = [n for n in features if n not in numbers]
    parts = [tallied(names, numeric) for names, numeric in ((numbers, True), (others, False)) if names]
    return stage(reduce(DataFrame.unionByName, parts), "tally")


def bin_edges(numeric: DataFrame, bins: int, by: Sequence[str] = ("feature",), value: str = "value", count: str | None = None) -> DataFrame:
    """(by, edges) of the groups with more than `bins` distinct values; duplicate edges dropped.

    With `count` the rows are a tally: one per value, standing for so many; other rows are tallied first. The tally and the
    groups to cut are stage tables: the steps that follow read them again, and the few groups are sent to the rows.
    """
    by = list(by)
    known = numeric.filter(F.col(value).isNotNull())
    if not count:
        count = "_times"
        known = stage(known.groupBy(*by, value).agg(F.count("*").alias(count)), "values")
    distinct = known.groupBy(*by).agg(F.count("*").alias("distinct"))
    rows = known.join(stage(distinct.filter(F.col("distinct") > bins).select(*by), "cut-groups"), by, "left_semi")
    grid = quantile_grid(rows, bins, by, value, count)
    return grid.select(*by, F.array_distinct("grid").alias("edges"))


def bin_number(edges: str, value: str, bins: int):
    """Right-closed bin of a value, 0-based; the lowest edge belongs to bin 0."""
    over = [F.coalesce(F.get(F.col(edges), F.lit(i)) < F.col(value), F.lit(False)).cast("int")
            for i in range(1, bins)]
    return reduce(lambda a, b: a + b, over)


def binned(frame: DataFrame, features: Sequence[str], target: str, bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """The tally with bins, (feature, bin, key, n, bads), and the edges of the binned features.

    A numeric column with more than `bins` values gets a bin number, any other column keeps
    its own values as `key`; a missing value has the key `<missing>` and no bin. The table itself is
    read once, by the tally: distinct counts, edges and bins come from the tally.
    """
    values = tally(frame, features, target)
    edges = stage(bin_edges(values.filter(F.col("value").isNotNull()), bins, count="n"), "edges")
    cut = F.col("edges").isNotNull() & F.col("value").isNotNull()
    own = F.coalesce("key", F.col("value").cast("string"), F.lit(MISSING))
    rows = values.join(edges, "feature", "left").select(
        "feature", F.when(cut, bin_number("edges", "value", bins)).alias("bin"), F.when(~cut, own).alias("key"), "n", "bads")
    return rows, edges
