"""Bad rate, weight of evidence and information value per bin."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossbook import fixed_values as V
from lossbook.operators.binning import MISSING, binned, usable

SMOOTH = 0.5


def bin_counts(frame: DataFrame, features: Sequence[str], target: str = V.TARGET, bins: int = 10,
               keep_empty: bool = False) -> DataFrame:
    """(feature, bin, key, Count, Bads); `keep_empty` also lists empty bins and `<missing>`."""
    rows, edges = binned(frame, features, target, bins)
    counts = rows.groupBy("feature", "bin", "key").agg(
        F.sum("n").alias("Count"), F.sum("bads").alias("Bads"))
    if keep_empty:
        zero = F.lit(0).cast("long")
        last = F.size("edges") - 2
        slots = edges.filter(last >= 0).select(
            "feature", F.explode(F.sequence(F.lit(0), last)).alias("bin"), F.lit(None).cast("string").alias("key"))
        gaps = edges.select("feature", F.lit(None).cast("int").alias("bin"), F.lit(MISSING).alias("key"))
        extra = slots.unionByName(gaps).select("*", zero.alias("Count"), zero.alias("Bads"))
        counts = counts.unionByName(extra).groupBy("feature", "bin", "key").agg(
            F.sum("Count").alias("Count"), F.sum("Bads").alias("Bads"))
    return counts


def target_rate(frame: DataFrame, features: Sequence[str], target: str = V.TARGET, bins: int = 10,
                min_count: int = 1) -> DataFrame:
    """Count, bads, bad rate and share per level, percent with two digits."""
    counts = bin_counts(frame, features, target, bins)
    w = Window.partitionBy("feature")
    return (counts.select(
        "feature", "bin", "key", "Count", "Bads",
        F.bround(F.col("Bads") / F.col("Count") * 100, 2).alias("bad_rate_pct"),
        F.bround(F.col("Count") / F.sum("Count").over(w) * 100, 2).alias("share_pct"))
        .filter(F.col("Count") >= min_count)
        .orderBy("feature", F.col("bin").asc_nulls_last(), F.desc("bad_rate_pct"), "key"))


def _evidence(counts: DataFrame, digits: int | None) -> DataFrame:
    w = Window.partitionBy("feature")

    def rounded(c: Column) -> Column:
        return c if digits is None else F.bround(c, digits)

    goods = F.col("Count") - F.col("Bads")
    d_bad = F.try_divide(F.col("Bads") + SMOOTH, F.sum("Bads").over(w))      # NULL where a class is empty
    d_good = F.try_divide(goods + SMOOTH, F.sum(goods).over(w))
    return (counts.withColumn("Goods", goods).withColumn("_db", d_bad).withColumn("_dg", d_good)
            .withColumn("WOE", rounded(F.log(F.col("_dg") / F.col("_db"))))
            .withColumn("IV", rounded((F.col("_dg") - F.col("_db")) * F.col("WOE"))).drop("_db", "_dg"))


def woe_table(frame: DataFrame, features: Sequence[str], target: str = V.TARGET, bins: int = 10) -> DataFrame:
    """Rounded WOE table; IV uses the rounded WOE, `IV_total` is the rounded sum per feature."""
    counts = bin_counts(frame, features, target, bins, keep_empty=True)
    t = _evidence(counts, 4)
    return t.withColumn("bad_rate_pct", F.bround(F.try_divide(F.col("Bads"), F.col("Count")) * 100, 2)).withColumn(
        "IV_total", F.bround(F.sum("IV").over(Window.partitionBy("feature")), 4))


def information_value(frame: DataFrame, features: Sequence[str], target: str = V.TARGET, bins: int = 10) -> DataFrame:
    """Unrounded IV per feature; empty groups do not count."""
    counts = bin_counts(frame, features, target, bins)
    return _evidence(counts, None).groupBy("feature").agg(F.sum("IV").alias("IV"))


def iv_band(iv: Column) -> Column:
    out = F.when(iv.isNull(), "?")
    for limit, name in V.IV_BANDS:
        out = out.when(iv < limit, name)
    return out.otherwise(V.IV_TOP_BAND)


def iv_ranking(frame: DataFrame, features: Sequence[str], target: str = V.TARGET, bins: int = 10,
               rounded: bool = True) -> DataFrame:
    """Features by information value, best first. One scan of the table serves all columns.

    A feature that the table lacks, or that has no levels to count (an array, map, struct or binary), is listed last
    with a NULL value; the others are ranked all the same.
    """
    known = usable(frame, features)
    lacking = frame.sparkSession.createDataFrame([(n, None) for n in features if n not in known], "feature string, IV double")
    if not known:
        return lacking.withColumn("band", iv_band(F.col("IV"))).orderBy("feature")
    features = known
    if rounded:
        iv = woe_table(frame, features, target, bins).groupBy("feature").agg(F.max("IV_total").alias("IV"))
    else:
        iv = information_value(frame, features, target, bins).withColumn("IV", F.bround("IV", 4))
    return iv.unionByName(lacking).withColumn("band", iv_band(F.col("IV"))).orderBy(F.col("IV").desc_nulls_last(), "feature")


def monotone_check(frame: DataFrame, directions: Mapping[str, int] = V.RISK_DIRECTIONS,
                   target: str = V.TARGET, bins: int = 10) -> DataFrame:
    """Compare the step signs of WOE over the ordered bins with each declared direction.

    A rising WOE means falling risk, so a +1 feature is monotone when no step rises.
    """
    features = [f for f in directions if f in frame.columns]
    t = woe_table(frame, features, target, bins).filter(F.col("Count") > 0)
    position = F.coalesce(F.col("bin").cast("double"), F.expr("try_cast(key AS double)"))
    w = Window.partitionBy("feature").orderBy("_pos")
    steps = (t.withColumn("_pos", position).filter(F.col("_pos").isNotNull())
             .withColumn("_step", F.col("WOE") - F.lag("WOE").over(w)))
    pairs = [F.lit(x) for kv in directions.items() for x in kv]
    sign = F.element_at(F.create_map(*pairs), F.col("feature"))
    return steps.groupBy("feature").agg(
        F.count("_step").alias("steps"),
        F.count(F.when(F.col("_step") > 0, 1)).alias("woe_up"),
        F.count(F.when(F.col("_step") < 0, 1)).alias("woe_down")).select(
        "feature", sign.alias("direction"), "steps",
        F.when(sign > 0, F.col("woe_up")).otherwise(F.col("woe_down")).alias("violations")).withColumn(
        "monotone", F.col("violations") == 0)
