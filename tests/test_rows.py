"""Edge rows: features, labels, filters and durations."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lossbook.operators import features as FE
from lossbook.operators import labels as LB
from lossbook.operators import panel as PA
from lossbook.operators import population as PO
from lossbook.operators.features import income_outside_band, utilization_bucket
from lossbook.functions.expr import flag, nan_to_null, whole_days

COLUMNS = """CreditScoreRangeLower double, CreditScoreRangeUpper double, DateCreditPulled timestamp, FirstRecordedCreditLine timestamp,
LoanOriginalAmount double, StatedMonthlyIncome double, PriorLoans double, IncomeVerifiable boolean, DebtToIncomeRatio double,
BankcardUtilization double, Term long, RevolvingCreditBalance double, AvailableBankcardCredit double, OpenCreditLines double,
CurrentCreditLines double, InquiriesLast6Months double, TotalInquiries double, CurrentDelinquencies double,
DelinquenciesLast7Years double, PriorPaymentsOnTime double, PriorPaymentsBilled double, PriorPrincipalOutstanding double,
PriorPrincipalBorrowed double, IncomeRange string, PriorPaymentsLateUnderMonth double, PriorPaymentsLateOverMonth double, ScoreChange double"""
NAMES = [c.split()[0] for c in COLUMNS.replace("\n", " ").split(",")]


def loan(spark, **values):
    row = dict.fromkeys(NAMES) | {"LoanOriginalAmount": 1000.0, "Term": 12, "StatedMonthlyIncome": 2000.0} | values
    return FE.all_features(spark.createDataFrame([tuple(row[n] for n in NAMES)], COLUMNS)).first()


def test_one_score_bound_missing(spark):
    assert loan(spark, CreditScoreRangeLower=600.0)["credit_score_mid"] == 600.0


def test_zero_income(spark):
    r = loan(spark, StatedMonthlyIncome=0.0)
    assert r["loan_to_income"] is None and r["ReferencePTI"] == -1.0 and r["Income_Undefined"] == 1


def test_missing_income(spark):
    r = loan(spark, StatedMonthlyIncome=None, DebtToIncomeRatio=0.2, IncomeRange="$1-24,999")
    assert (r["Income_Undefined"], r["IncomeBand_Mismatch"]) == (0, 0)
    assert r["ResidualIncome"] == r["DisposableIncome"] == r["EstMonthlyDebtObligation"] == -1.0


@pytest.mark.parametrize("dti,want", [(10.01, 1), (10.0, 0), (None, 0)])
def test_dti_cap(spark, dti, want):
    assert loan(spark, DebtToIncomeRatio=dti)["dti_capped_flag"] == want


def test_utilization_edges(spark):
    rows = spark.createDataFrame([(x,) for x in (0.30, 0.3000001, 1.00, 1.01, None)], "u double")
    got = [r[0] for r in rows.select(utilization_bucket(F.col("u"))).collect()]
    assert got == ["<=30%", "30-50%", "75-100%", ">100%", "Missing"]


@pytest.mark.parametrize("open_,all_,want", [(0.0, 0.0, 0.0), (3.0, 0.0, -1.0), (None, 5.0, 0.0)])
def test_open_line_share(spark, open_, all_, want):
    assert loan(spark, OpenCreditLines=open_, CurrentCreditLines=all_)["OpenToTotalLineRatio"] == want


def test_total_utilization_zero_limit(spark):
    assert loan(spark, RevolvingCreditBalance=0.0, AvailableBankcardCredit=0.0)["TotalUtilization"] == 0.0
    assert loan(spark, RevolvingCreditBalance=900.0, AvailableBankcardCredit=-900.0)["TotalUtilization"] == 2.0


def test_band_gap_is_a_mismatch(spark):
    row = spark.range(1).select(income_outside_band(F.lit(24_999.5 / 12), F.lit("$1-24,999")), income_outside_band(F.lit(5.0), F.lit("other")))
    assert tuple(row.first()) == (1, 0)


@pytest.mark.parametrize("prior,repeat", [(None, 0), (0.0, 1), (2.0, 1)])
def test_prior_loans(spark, prior, repeat):
    r = loan(spark, PriorLoans=prior, PriorPaymentsOnTime=9.0, PriorPaymentsBilled=10.0)
    assert r["is_repeat_borrower"] == repeat and r["OnTimeRate"] == (0.9 if prior == 2.0 else -1.0)


def test_elapsed_days_round_down(spark):
    a, b = dt.datetime(2001, 1, 2, 1), dt.datetime(2001, 1, 1, 2)
    assert spark.createDataFrame([(a, b)], "a timestamp, b timestamp").select(whole_days(F.col("a"), F.col("b"))).first()[0] == 0


def test_labels(spark):
    rows = spark.createDataFrame([(100.0, 120.0, 5.0), (100.0, 60.0, 80.0)],
                                 "LoanOriginalAmount double, LP_CustomerPrincipalPayments double, LP_NetPrincipalLoss double")
    got = rows.select(LB.ead_label().alias("e"), LB.lgd_label().alias("l")).collect()
    assert [tuple(r) for r in got] == [(0.0, None), (40.0, 1.0)]


def test_nan_counts_as_missing(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"),)], "x double"))
    assert df.select(flag(F.col("x") >= 10.01)).first()[0] == 0


def test_leaking_columns_are_refused():
    with pytest.raises(ValueError):
        LB.check_features(["Term", "LP_NetPrincipalLoss"])
    with pytest.raises(ValueError):
        LB.check_features(["IncumbentScore"])


BOOK = "loan_id long, LoanOriginationDate timestamp, ClosedDate timestamp, LoanStatus string, Term long, LoanMonthsSinceOrigination long"


def test_panel_scope_and_durations(spark):
    d = dt.datetime
    rows = [(1, d(2000, 1, 1), d(2000, 1, 1), "Defaulted", 12, 20), (2, d(2000, 1, 1), d(2003, 1, 1), "Completed", 12, 20),
            (3, d(2000, 1, 1), None, "Current", 36, 7), (4, d(2000, 1, 1), None, "Cancelled", 36, 7),
            (5, d(2000, 1, 1), None, None, 36, 7), (6, d(1990, 1, 1), None, "Current", 36, 7)]
    loans = PA.durations(spark.createDataFrame(rows, BOOK), "1996-01-01")
    assert {r["loan_id"]: (r["T_obs"], r["is_event"]) for r in loans.collect()} == {1: (1, True), 2: (12, False), 3: (7, False), 5: (7, False)}
    panel = PA.loan_months(loans)
    assert panel.count() == 27 and panel.agg(F.sum(PA.EVENT)).first()[0] == 1
    PA.assert_panel(PA.panel_checks(loans))
    with pytest.raises(AssertionError):
        PA.assert_panel(PA.panel_checks(loans), min_events=2)


def test_unknown_population_mode(spark):
    with pytest.raises(NotImplementedError):
        PO.resolved(spark.createDataFrame([], BOOK), "1996-01-01", "seasoned")


def test_loans_do_not_depend_on_the_columns_asked(spark, tmp_path):
    from lossbook.sources.book import loan_book
    tables = "/root/testdata/sf0.001"
    for name in ("orders", "nation", "customer"):
        rows = spark.read.parquet(f"{tables}/{name}.parquet")
        if name == "customer":
            rows = rows.filter("c_custkey % 3 = 0")         # loans of the others have no customer
        if name == "nation":
            rows = rows.filter("n_nationkey > 4")
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    n = spark.read.parquet(f"{tables}/orders.parquet").count()
    assert loan_book(spark, str(tmp_path), ["Term"]).count() == n
    assert loan_book(spark, str(tmp_path), ["Term", "StatedMonthlyIncome"]).dropna(subset=["loan_id"]).count() == n
    assert loan_book(spark, str(tmp_path), ["BorrowerState"]).dropna(subset=["loan_id"]).count() == n
