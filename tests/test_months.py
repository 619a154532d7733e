"""Months of a loan are laid out where its window runs."""

import re

from pyspark.sql import functions as F
from test_cuts import plan_of

from lossbook.operators import pricing as PX
from lossbook.plans import jobs
from lossbook.sources import book as B


def test_windows_over_months_do_not_shuffle_them(spark, monkeypatch):
    loans = spark.range(300).select(F.col("id").alias("loan_id"), F.lit(12).cast("long").alias("Term"), (F.col("id") / 1000).alias("pd"))
    monkeypatch.setattr(jobs, "population", lambda *_: loans)
    monkeypatch.setattr(jobs, "scored_population", lambda *_: loans)
    monkeypatch.setattr(jobs, "MONTHS_A_PART", 400)
    rows = jobs.hazard_rows(spark, "")
    assert rows.rdd.getNumPartitions() == 10
    alive = PX.alive_at_start(PX.survival_rows(rows))
    plan = plan_of(alive).split("Initial Plan")[0]
    laid_out, dealt = plan.index("Generate"), plan.index("Exchange")
    assert len(re.findall("Exchange", plan)) == 1 and laid_out < dealt          # the exchange is below the explode
    got = {(r.loan_id, r.t): r.h for r in rows.collect()}
    want = loans.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(12)))).select("loan_id", "t", B.fixed_hazard(F.col("pd"), F.col("t"), F.col("Term")).alias("h"))
    assert len(got) == 3600 and got == {(r.loan_id, r.t): r.h for r in want.collect()}


def test_no_loans_have_no_months(spark, monkeypatch):
    none = spark.createDataFrame([], "loan_id long, Term long, pd double")
    monkeypatch.setattr(jobs, "population", lambda *_: none)
    monkeypatch.setattr(jobs, "scored_population", lambda *_: none)
    assert jobs.hazard_rows(spark, "").count() == 0
