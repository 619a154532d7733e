"""Monthly series from files: delimited text and JSON observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def to_monthly(raw: DataFrame, name: str) -> DataFrame:
    """First two columns as (month, number); rows that do not parse are dropped."""
    date, number = raw.columns[:2]
    day = F.expr(f"try_to_timestamp(`{date}`)")
    return raw.select(F.date_format(day, "yyyy-MM").alias("ym"),
                      F.expr(f"try_cast(`{number}` AS DOUBLE)").alias(name)).dropna()


def read_csv_series(spark: SparkSession, path: str, name: str) -> DataFrame:
    return to_monthly(spark.read.schema("date string, value string").csv(path, header=True), name)


def read_json_series(spark: SparkSession, path: str, name: str) -> DataFrame:
    """`{"observations": [{"date": ..., "value": ...}]}` documents to monthly rows."""
    schema = "observations array<struct<date: string, value: string>>"
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    return to_monthly(docs.select(F.explode("observations").alias("o")).select("o.date", "o.value"), name)
