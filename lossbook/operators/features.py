"""Borrower features: derived (P1-P9) and engineered (P10-P22) columns of a loan table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossbook import fixed_values as V
from lossbook.functions.expr import DAYS_PER_MONTH, clip, flag, ratio, whole_days


def utilization_bucket(util: Column) -> Column:
    out = F.when(util.isNull(), V.UTILIZATION_MISSING)
    for edge, label in V.UTILIZATION_BINS:
        out = out.when(util <= edge, label)
    return out.otherwise(V.UTILIZATION_TOP)


def _derived(c) -> dict[str, Column]:
    low, high = c("CreditScoreRangeLower"), c("CreditScoreRangeUpper")
    income = c("StatedMonthlyIncome")
    return {
        "credit_score_mid": (F.coalesce(low, high) + F.coalesce(high, low)) / 2,
        "credit_history_months": whole_days(c("DateCreditPulled"), c("FirstRecordedCreditLine")) / DAYS_PER_MONTH,
        "loan_to_income": ratio(c("LoanOriginalAmount"), income * 12),
        "stated_income_log": F.log1p(clip(income, lo=0)),
        "is_repeat_borrower": c("PriorLoans").isNotNull().cast("int"),
        "income_unverified": F.coalesce(~c("IncomeVerifiable"), F.lit(True)).cast("int"),
        "dti_capped_flag": flag(c("DebtToIncomeRatio") >= V.DTI_CAP),
        "bankcard_util_bucket": utilization_bucket(c("BankcardUtilization")),
    }


def add_derived(loans: DataFrame) -> DataFrame:
    """P1-P9. Flags read the raw nulls; the prior-history columns are filled with 0 afterwards."""
    new = _derived(F.col)
    filled = {n: F.coalesce(F.col(n), F.lit(0)).alias(n) for n in V.PRIOR_HISTORY}
    kept = [filled.get(n, F.col(n)) for n in loans.columns]
    return loans.select(*kept, *[e.alias(n) for n, e in new.items()])


def reference_payment(amount: Column, term: Column) -> Column:
    monthly = V.REFERENCE_APR / 12
    return amount * monthly / (1 - F.pow(F.lit(1 + monthly), -term))


def _total_utilization(balance: Column, available: Column) -> Column:
    limit = balance + available
    share = clip(balance / F.when(limit != 0, limit), 0, 2)
    return (F.when(limit.isNull(), 0.0)
            .when(limit == 0, F.when(balance > 0, 2.0).otherwise(0.0))
            .otherwise(share))


def _open_line_share(open_lines: Column, all_lines: Column) -> Column:
    return (F.when(open_lines.isNull() | all_lines.isNull(), 0.0)
            .when(all_lines == 0, F.when(open_lines == 0, 0.0).otherwise(V.UNDEFINED))
            .otherwise(ratio(open_lines, all_lines)))


def income_outside_band(income: Column, band: Column) -> Column:
    annual = income * 12
    outside = F.lit(None).cast("boolean")
    for name, (lo, hi) in V.INCOME_BANDS.items():
        below = annual < lo
        outside = F.when(band == name, below if hi is None else below | (annual > hi)).otherwise(outside)
    return flag(outside)


def _engineered(c) -> dict[str, Column]:
    income = c("StatedMonthlyIncome")
    debt = c("DebtToIncomeRatio") * income
    left = income - debt
    payment = reference_payment(c("LoanOriginalAmount"), c("Term"))
    repeat = c("PriorLoans") > 0

    def known(e: Column) -> Column:
        return F.coalesce(e, F.lit(V.UNDEFINED))

    def for_repeat(num: str, den: str) -> Column:
        return F.when(repeat, ratio(c(num), c(den), V.UNDEFINED)).otherwise(V.UNDEFINED)

    return {
        "EstMonthlyDebtObligation": known(debt),
        "DisposableIncome": known(left),
        "ResidualIncome": known(left - payment),
        "ReferencePTI": ratio(payment, income, V.UNDEFINED),
        "TotalUtilization": _total_utilization(c("RevolvingCreditBalance"), c("AvailableBankcardCredit")),
        "OpenToTotalLineRatio": _open_line_share(c("OpenCreditLines"), c("CurrentCreditLines")),
        "InquiryVelocity": ratio(c("InquiriesLast6Months"), c("TotalInquiries") + 1, V.UNDEFINED),
        "RecentDelinquencyShare": ratio(c("CurrentDelinquencies"), c("DelinquenciesLast7Years") + 1, V.UNDEFINED),
        "OnTimeRate": for_repeat("PriorPaymentsOnTime", "PriorPaymentsBilled"),
        "OutstandingDebtRatio": for_repeat("PriorPrincipalOutstanding", "PriorPrincipalBorrowed"),
        "IncomeBand_Mismatch": income_outside_band(income, c("IncomeRange")),
        "Income_Undefined": flag(income <= 0),
    }


def feature_columns_by_name() -> dict[str, Column]:
    """Every derived and engineered feature as an expression over raw loan columns."""
    return _derived(F.col) | _engineered(F.col)


def add_engineered(loans: DataFrame) -> DataFrame:
    """P10-P22 on a table that has the derived columns. Undefined values become -1."""
    return loans.select("*", *[e.alias(n) for n, e in _engineered(F.col).items()])


def all_features(loans: DataFrame) -> DataFrame:
    return add_engineered(add_derived(loans))
