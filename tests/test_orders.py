"""Ranks, quantiles, splits and prefix sums against brute force, also with hot keys and values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lossbook.functions.expr import key_hash
from lossbook.operators import metrics as ME
from lossbook.operators import overlay as OV
from lossbook.operators import splits as SP
from lossbook.operators import survival as SU
from lossbook.operators.binning import binned, tally
from lossbook.operators.prefix import totals_before
from lossbook.operators.ranking import average_ranks, quantile_grid, smallest_by_hash
from lossbook.operators.risk_tables import iv_ranking, woe_table
from lossbook.operators.results import nearest_rank_picks

RNG = np.random.default_rng(7)


@pytest.fixture(scope="module")
def values():
    hot = np.concatenate([np.zeros(700), np.round(RNG.normal(size=1400), 3)])
    return pd.DataFrame({"feature": ["a"] * 2100 + ["b"] * 3 + ["c"], "value": [*hot, 1.0, 5.0, 9.0, 4.0]})


@pytest.mark.parametrize("m", [2, 10, 100])
def test_quantiles_equal_pandas(spark, values, m):
    got = {r["feature"]: r["grid"] for r in quantile_grid(spark.createDataFrame(values), m, ["feature"], "value").collect()}
    for f, g in values.groupby("feature"):
        assert got[f] == pytest.approx(np.quantile(g["value"], np.arange(m + 1) / m), abs=1e-12)


def test_average_ranks(spark, values):
    r = average_ranks(spark.createDataFrame(values), ["feature"], "value").toPandas().sort_values(["feature", "value"])
    want = values.assign(rank=values.groupby("feature")["value"].rank()).drop_duplicates().sort_values(["feature", "value"])
    assert r["rank"].tolist() == want["rank"].tolist()


def test_hot_key_prefix_equals_plain_window(spark):
    pdf = pd.DataFrame({"k": [1] * 300 + list(range(2, 102)), "d": RNG.integers(0, 20, 400), "id": np.arange(400), "x": RNG.integers(0, 9, 400)})
    df = spark.createDataFrame(pdf)
    got = totals_before(df, "k", ["d", "id"], [F.col("d"), F.shiftright("id", 3)], {"n": F.lit(1), "s": F.col("x")}, hot_rows=50).toPandas()
    pdf = pdf.sort_values(["k", "d", "id"])
    pdf["n"], pdf["s"] = pdf.groupby("k").cumcount(), pdf.groupby("k")["x"].cumsum() - pdf["x"]
    cols = ["id", "n", "s"]
    assert got.sort_values("id")[cols].to_numpy().tolist() == pdf.sort_values("id")[cols].to_numpy().tolist()


def test_hash_cut_takes_exact_counts(spark):
    df = spark.range(1000).select(F.col("id").alias("loan_id"), (F.col("id") % 4 == 0).cast("int").alias("is_bad"))
    got = SP.stratified_split(df).groupBy("is_bad", "split").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {(0, "test"): 150, (0, "train"): 600, (1, "test"): 50, (1, "train"): 200}
    tied = smallest_by_hash(df, "loan_id", F.lit(5), share=0.1)
    assert sorted(r[0] for r in tied.filter("chosen").select("loan_id").collect()) == list(range(100))
    assert SP.fixed_size_sample(df, 2000).count() == 1000 and SP.fixed_size_sample(df, 17).count() == 17
    again = SP.stratified_split(df.repartition(13)).filter("split = 'test'").select("loan_id").collect()
    first = SP.stratified_split(df.coalesce(1)).filter("split = 'test'").select("loan_id").collect()
    assert set(again) == set(first)
    assert df.select(F.max(key_hash(F.col("loan_id") + 5_000_000_000_000))).first()[0] < 1_000_003


def test_downsampling_keeps_all_positives(spark):
    df = spark.range(500).select(F.col("id").alias("row_key"), (F.col("id") < 5).cast("int").alias("y"))
    out = SP.downsample_negatives(df, "y", "row_key", 20).groupBy("y").count().collect()
    assert dict(map(tuple, out)) == {1: 5, 0: 100}


def test_folds_are_balanced(spark):
    df = spark.range(300).select(F.col("id").alias("loan_id"), (F.col("id") % 3 == 0).cast("int").alias("is_bad"))
    assert {r["count"] for r in SP.stratified_folds(df).filter("is_bad = 0").groupBy("fold").count().collect()} <= {66, 67}


def test_metrics_with_ties(spark):
    y, s = RNG.integers(0, 2, 400), np.round(RNG.random(400), 1)
    r = ME.ranking_metrics(spark.createDataFrame(pd.DataFrame({"y": y, "s": s})), F.col("s"), F.col("y")).first()
    diff = s[y == 1][:, None] - s[y == 0][None, :]
    assert r["AUC"] == pytest.approx((diff > 0).mean() + (diff == 0).mean() / 2)
    grid = np.unique(s)
    assert r["KS"] == pytest.approx(max(abs((s[y == 1] <= g).mean() - (s[y == 0] <= g).mean()) for g in grid))


def test_concordance_against_pairs(spark):
    n = 150
    pdf = pd.DataFrame({"T_obs": RNG.integers(1, 15, n), "is_event": RNG.random(n) < 0.4, "r": np.round(RNG.random(n), 1)})
    df = spark.createDataFrame(pdf)
    g = {r["t"]: r["G"] for r in SU.censoring_survival(df).collect()}
    num = den = 0.0
    for i in pdf[pdf.is_event].itertuples():
        if g[i.T_obs] <= 0:
            continue
        for j in pdf.itertuples():
            if j.T_obs > i.T_obs or (j.T_obs == i.T_obs and not j.is_event):
                w = 1 / g[i.T_obs] ** 2
                den += w
                num += w * ((j.r < i.r) + 0.5 * (j.r == i.r))
    assert SU.ipcw_concordance(df, df, "r").first()[0] == pytest.approx(num / den)


def test_woe_lists_an_empty_missing_row(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(100)], "x double, is_bad int")
    rows = {(r["bin"], r["key"]): r["Count"] for r in woe_table(df, ["x"]).collect()}
    assert rows[(None, "<missing>")] == 0 and sum(rows.values()) == 100 and len(rows) == 11


def test_few_values_stay_groups(spark):
    df = spark.createDataFrame([(i % 3, 0) for i in range(30)], "x int, is_bad int")
    assert {r["key"] for r in binned(df, ["x"], "is_bad")[0].collect()} == {"0.0", "1.0", "2.0"}


def test_ewm_with_gaps_equals_pandas(spark):
    x = [None, 4.0, 5.0, None, 7.0, 6.5, 3.0]
    df = spark.createDataFrame([(f"2000-{i + 1:02d}", v) for i, v in enumerate(x)], "ym string, x double")
    got = [r["x_ewma"] for r in OV.smooth(df, "x", [], ("2000-01", "2000-12")).orderBy("ym").collect()]
    want = pd.Series(x).ewm(halflife=6).mean()
    assert got[0] is None and got[1:] == pytest.approx(want[1:].tolist())


def test_latest_row_falls_back(spark):
    df = spark.createDataFrame([("2000-01", None), ("2000-02", None)], "ym string, v double")
    assert OV.latest_row(df, ["v"]).first()["ym"] == "2000-02"
    assert OV.latest_row(df.union(spark.createDataFrame([("1999-01", 1.0)], "ym string, v double")), ["v"]).first()["ym"] == "1999-01"


def test_nearest_rank(spark):
    df = spark.createDataFrame([(i, float(i // 3)) for i in range(31)], "loan_id long, s double")
    got = {r["tenth"]: r["loan_id"] for r in nearest_rank_picks(df, "s", "loan_id", [1, 5, 9]).collect()}
    assert got == {1: 3, 5: 15, 9: 27}


def test_totals_before_keeps_null_keys_and_levels(spark):
    rows = [(None if i % 3 == 0 else i % 2, None if i % 10 == 0 else i % 7, i) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, d int, id int")
    levels = [F.col("d"), F.shiftright("id", 3)]
    both = [totals_before(df, "k", ["d", "id"], levels, {"n": F.lit(1)}, hot_rows=h).toPandas().sort_values("id") for h in (20, 10_000)]
    assert len(both[0]) == 200 and both[0].n.tolist() == both[1].n.tolist()


def test_bins_above_a_thousand(spark):
    from lossbook.operators.binning import bin_edges
    df = spark.range(1500).select(F.lit("f").alias("feature"), F.col("id").cast("double").alias("value"))
    assert bin_edges(df, 2000).count() == 0 and bin_edges(df, 1000).count() == 1


def test_one_class_cohorts_are_null(spark):
    from lossbook.operators.metrics import ranking_metrics
    df = spark.createDataFrame([(1, 0.1, 0), (1, 0.2, 0), (2, 0.3, 1), (3, 0.1, 0), (3, 0.9, 1)], "v int, s double, y int")
    got = {r.v: r for r in ranking_metrics(df, F.col("s"), F.col("y"), ["v"]).collect()}
    assert got[1].AUC is None and got[1].KS is None and got[1].PR_AUC is None and got[2].AUC is None and got[3].AUC == 1.0


def test_null_stratum_is_split(spark):
    from lossbook.operators.splits import stratified_split
    df = spark.range(400).select(F.col("id").alias("loan_id"), F.when(F.col("id") % 2 == 0, 1).alias("y"))
    got = stratified_split(df, stratum="y").filter("y is null").groupBy("split").count().collect()
    assert {r.split for r in got} == {"train", "test"}


def test_csv_by_header(spark, tmp_path):
    from pyspark.sql import types as T
    from lossbook.sources.tables import read_loans_csv
    (tmp_path / "l.csv").write_text("more,when,Term\nx,2007-08-26 18:41:46.780000000,36\ny,never,n/a\n")
    schema = T.StructType([T.StructField("Term", T.IntegerType()), T.StructField("at", T.TimestampType())])
    got = read_loans_csv(spark, str(tmp_path), schema, {"when": "at"}).orderBy(F.col("Term").asc_nulls_last()).collect()
    assert got[0].Term == 36 and got[0].at.microsecond == 780000 and got[1].Term is None and got[1].at is None
    with pytest.raises(ValueError):
        read_loans_csv(spark, str(tmp_path), T.StructType([T.StructField("gone", T.IntegerType())]))


def test_folds_of_tiny_and_null_strata(spark):
    df = spark.createDataFrame([(1, 1), *[(i, 0) for i in range(2, 9)], *[(i, None) for i in range(9, 14)]], "loan_id long, is_bad int")
    got = {(r["is_bad"], r["fold"]): r["n"] for r in SP.stratified_folds(df, folds=4).groupBy("is_bad", "fold").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, 0): 1, (0, 0): 2, (0, 1): 2, (0, 2): 2, (0, 3): 1, (None, 0): 2, (None, 1): 1, (None, 2): 1, (None, 3): 1}


def test_fills_with_constants_only(spark):
    from lossbook.operators.profile import Fill, fill_missing, learn_fills
    df = spark.createDataFrame([(1, None), (2, 3.0)], "k int, x double")
    rules = [Fill("x", "constant", value=7.0), Fill("gone", "constant", value=1.0)]
    assert sorted(map(tuple, fill_missing(df, rules, learn_fills(df, rules)).collect())) == [(1, 7.0), (2, 3.0)]
    learned = learn_fills(df, [Fill("x", "median")])
    assert fill_missing(df.drop("x"), [Fill("x", "median", flag=True)], learned).columns == ["k"]


def test_ranking_goes_on_past_failing_columns(spark):
    df = spark.createDataFrame([(float(i), [i], {"a": i}, "a" if i % 3 else None, int(i > 60)) for i in range(100)],
                               "x double, l array<int>, m map<string,int>, t string, is_bad int")
    for rounded in (True, False):
        got = [(r.feature, r.IV is None, r.band) for r in iv_ranking(df, ["l", "x", "absent", "t", "m"], rounded=rounded).collect()]
        assert got[0][:2] == ("x", False) and got[1][:2] == ("t", False) and got[2:] == [(n, True, "?") for n in ("absent", "l", "m")]
    assert [(r.feature, r.IV) for r in iv_ranking(df, ["l"]).collect()] == [("l", None)]
    assert iv_ranking(df.limit(0), ["x"]).collect() == []


def test_one_scan_makes_the_tally(spark, tmp_path):
    spark.range(4000).selectExpr("double(id % 37) x", "int(id % 5) z", "if(id % 7 = 0, null, string(id % 3)) t", "int(id % 2) is_bad").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    rows = tally(df, ["x", "z", "t"], "is_bad")
    assert {(r.feature, r.c, r.s, r.b) for r in rows.groupBy("feature").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.sum("bads").alias("b")).collect()} == {
        ("x", 37, 4000, 2000), ("z", 5, 4000, 2000), ("t", 4, 4000, 2000)}
    counts, edges = binned(df, ["x", "z", "t"], "is_bad")
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert f"{tmp_path}/t" not in plan and len(counts.inputFiles()) > 0 and not any("/t/" in f and str(tmp_path) in f for f in counts.inputFiles())
    pdf = df.toPandas()
    want = pd.cut(pdf.x, np.unique(np.quantile(pdf.x, np.linspace(0, 1, 11))), include_lowest=True, labels=False).value_counts().to_dict()
    assert {r.bin: r.n for r in counts.filter("feature = 'x'").groupBy("bin").agg(F.sum("n").alias("n")).collect()} == want
