"""Curves and pricing: invariants and a month-by-month loop."""

import math

import pytest
from pyspark.sql import functions as F

from lossbook.functions import curves as C
from lossbook.operators import pricing as PX
from lossbook.operators import profile as PR
from lossbook.operators import validate as VA


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def loop(amount, apr, n, marg, lgd, e=PX.Economics()):
    c, bal, dead, out = apr / 12, amount, 0.0, {"ecl": 0.0, "profit": 0.0}
    pay = amount / n if c <= 1e-9 else amount * c / (1 - (1 + c) ** -n)
    for k in range(1, n + 1):
        d, alive = (1 + c) ** -k, 1 - dead
        loss = marg[k - 1] * lgd * bal * d
        out["ecl"] += loss
        out["profit"] += alive * bal * d * (c - (e.funding_rate + e.servicing_rate) / 12) - loss
        bal -= min(pay - bal * c, bal)
        dead += marg[k - 1]
    return out


def test_marginals_sum_to_lifetime_pd(spark):
    h = F.array(*[F.lit(x) for x in (0.01, 0.0, 0.3, 1.0)])
    assert one(spark, C.total(C.marginal_curve(h))) == pytest.approx(one(spark, C.lifetime_pd(h)))
    assert one(spark, C.lifetime_pd(F.array().cast("array<double>"))) == 0.0


@pytest.mark.parametrize("term", [1, 10, 12, 36, 60])
def test_timing_weights_sum_to_one(spark, term):
    w = one(spark, C.timing_weights(F.lit(term), C.density_literal(C.fallback_timing()), 20))
    assert len(w) == term and math.fsum(w) == pytest.approx(1.0)
    flat = one(spark, C.timing_weights(F.lit(term), C.density_literal([0.0] * 20), 20))
    assert flat == pytest.approx([1 / term] * term)


def test_conform(spark):
    c = F.array(F.lit(0.1), F.lit(0.2))
    assert one(spark, C.conform(c, F.lit(3))) == [0.1, 0.2, 0.0] and one(spark, C.conform(c, F.lit(1))) == [0.1]


def test_zero_rate_schedule(spark):
    rows = PX.amortization(spark.createDataFrame([(1, 1200.0, 0.0, 12)], "loan_id long, a double, r double, Term long"), "a", "r").orderBy("t").collect()
    assert [r["principal"] for r in rows] == pytest.approx([100.0] * 12) and rows[-1]["balance_start"] == pytest.approx(100.0)


@pytest.mark.parametrize("apr", [0.0, 0.08, 0.25])
def test_projection_and_price_equal_the_loop(spark, apr):
    n, lgd = 36, 0.7
    marg = [0.2 * (k + 1) / 666 for k in range(n)]
    df = spark.createDataFrame([(5000.0, apr, n, marg, lgd)], "a double, r double, n long, m array<double>, l double")
    got = PX.project(df, F.col("a"), F.col("r"), F.col("n"), F.col("m"), F.col("l")).first()
    want = loop(5000.0, apr, n, marg, lgd)
    assert got["lifetime_ecl"] == pytest.approx(want["ecl"]) and got["expected_profit"] == pytest.approx(want["profit"])
    p = PX.price(df, F.col("n"), F.col("m"), F.col("l")).first()
    assert loop(5000.0, p["breakeven_apr"], n, marg, lgd)["profit"] == pytest.approx(0.0, abs=1e-6)
    assert loop(5000.0, p["target_raroc_apr"], n, marg, lgd)["profit"] == pytest.approx(0.15 * 0.08 * 5000 * 3, abs=1e-6)


def test_price_of_a_hopeless_loan_is_the_ceiling(spark):
    df = spark.createDataFrame([(12, [0.08] * 12, 1.0)], "n long, m array<double>, l double")
    assert PX.price(df, F.col("n"), F.col("m"), F.col("l")).first()["breakeven_apr"] == pytest.approx(0.6)


def test_expected_loss_example(spark):
    assert one(spark, PX.expected_loss(F.lit(0.05), F.lit(0.60), F.lit(8000.0))) == pytest.approx(240.0)
    assert one(spark, PX.expected_loss(F.lit(0.5), F.lit(2.0), F.lit(-1.0))) == 0.0


def test_default_at_term_is_in_the_last_bin(spark):
    rows = spark.createDataFrame([("2000-01-01", "2003-01-01", 12)], "o string, c string, Term long").select(
        F.to_timestamp("o").alias("LoanOriginationDate"), F.to_timestamp("c").alias("ClosedDate"), "Term")
    curve = {r["bin"]: r["n"] for r in VA.default_timing(rows).collect()}
    assert len(curve) == 20 and curve[19] == 1 and sum(curve.values()) == 1


def test_imputation(spark):
    train = spark.createDataFrame([("b", 1.0, "x", None), ("a", 3.0, "x", None), ("a", None, "y", None), ("b", 9.0, "y", None)],
                                  "m string, n double, g string, e double")
    plan = [PR.Fill("e", "median"), PR.Fill("m", "mode"), PR.Fill("n", "median", within="g", flag=True)]
    with pytest.warns(UserWarning, match="'e'"):
        stats = PR.learn_fills(train, plan)
    test = spark.createDataFrame([(None, None, "x", None), (None, None, "new", 1.0)], train.schema)
    got = [(r["m"], r["n"], r["e"], r["n_was_missing"]) for r in PR.fill_missing(test, plan, stats).orderBy("n").collect()]
    assert got == [("a", 2.0, None, 1), ("a", 3.0, 1.0, 1)]
    with pytest.raises(KeyError):
        PR.learn_fills(train, [PR.Fill("nope", "median")])


def test_curves_equal_the_loop(spark):
    curves = [[0.01, 0.2, 0.05], [], None, [0.0], [1.0, 0.5], [None, 0.1, float("nan")], [0.003] * 360]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(curves)], "i long, h array<double>").repartition(3)
    got = {r.i: (r.s, r.m) for r in df.select("i", C.survival_curve(F.col("h")).alias("s"), C.marginal_curve(F.col("h")).alias("m")).collect()}
    for i, curve in enumerate(curves):
        if curve is None:
            assert got[i] == (None, None)
            continue
        alive, s, m = 1.0, [], []
        for h in curve:
            h = 1e-6 if h is None else 1 - 1e-6 if math.isnan(h) else min(max(h, 1e-6), 1 - 1e-6)
            m.append(alive * h)
            alive *= 1 - h
            s.append(alive)
        assert got[i] == (s, m)


def test_price_keeps_columns_and_nulls(spark):
    marg = [0.001 * (k + 1) for k in range(24)]
    rows = [(1, 24, marg, 0.5, "x"), (2, 12, marg[:12], 0.9, None), (3, 24, None, 0.5, "x"), (4, 24, marg, None, "x"), (5, 24, [None, *marg[1:]], 0.5, "x")]
    df = spark.createDataFrame(rows, "id long, n long, m array<double>, l double, breakeven_text string")
    out = PX.price(df, F.col("n"), F.col("m"), F.col("l"))
    got = {r.id: r for r in out.collect()}
    assert [got[i].breakeven_apr is None for i in range(1, 6)] == [False, False, True, True, False] and got[2].breakeven_text is None
    for i, n, m, lgd in ((1, 24, marg, 0.5), (2, 12, marg[:12], 0.9), (5, 24, [0.0, *marg[1:]], 0.5)):
        assert loop(1000.0, got[i].breakeven_apr, n, m, lgd)["profit"] == pytest.approx(0.0, abs=1e-6)


def test_curves_of_hazards_with_fields_of_a_bound_struct(spark):
    bound = C.let(F.struct((F.col("id") / 100).alias("p"), F.lit(4).alias("n")), lambda x: F.transform(F.sequence(F.lit(1), x["n"]), lambda k: x["p"] / k))
    df = spark.range(1, 4).withColumn("h", bound).withColumn("m", C.marginal_curve(F.col("h")))
    out = PX.price(df.select("id", "m"), F.lit(4), F.col("m"), F.lit(0.6))
    for r in out.collect():
        p = r.id / 100
        assert r.m[:2] == pytest.approx([p, (1 - p) * p / 2]) and 0 < r.breakeven_apr < 0.6
