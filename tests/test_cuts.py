"""Hash cuts of rows laid out by an explode: the cuts are sent to the rows."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from lossbook.operators import splits as SP
from lossbook.session import stage


@pytest.fixture(scope="module")
def months(spark):
    """200 loans of 60 months each; Spark estimates them by the size of the 200."""
    loans = stage(spark.range(200).select(F.col("id").alias("loan_id"), (F.col("id") % 3).cast("int").alias("is_bad")), "loans")
    rows = loans.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(60))))
    return rows.select("*", (F.col("loan_id") * 1000 + F.col("t")).alias("row_key"), (F.col("is_bad") == 1).cast("int").alias("event"))


def plan_of(df):
    """The plan as it ran: sizes found on the way count too."""
    df.collect()
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("cut", [lambda m: SP.downsample_negatives(m, "event", "row_key"), lambda m: SP.fixed_size_sample(m, 700, "row_key"),
                                 lambda m: SP.stratified_split(m, "row_key", "is_bad"), lambda m: SP.stratified_folds(m, "row_key", "is_bad")])
def test_rows_are_not_sent_to_find_a_cut(spark, months, cut):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50k")         # above the 200 loans, below the counts of 12,000 hash slots
    try:
        assert "BuildLeft" not in plan_of(cut(months))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_a_sample_of_months_is_exact(months):
    assert SP.fixed_size_sample(months, 700, "row_key").select("row_key").distinct().count() == 700
