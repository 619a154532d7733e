"""Wide projections run in methods that the JVM compiles."""

from pyspark.sql import functions as F

from lossbook.session import SETTINGS, apply_settings


def test_wide_projections_are_not_fused_into_one_huge_method(spark):
    apply_settings(spark)
    limit = "spark.sql.codegen.hugeMethodLimit"
    assert spark.conf.get(limit) == SETTINGS[limit] == "8000"
    wide = spark.range(5).select(*[F.when(F.col("id") % (i + 2) == 0, F.col("id") * i).otherwise(F.sqrt("id") + i).alias(f"c{i}") for i in range(60)])
    assert wide.agg(F.sum("c3")).first()[0] is not None and len(wide.collect()) == 5
