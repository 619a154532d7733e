"""Loan book derived from the star-schema test tables: every order is one loan.

Only the joins that the asked columns need are part of the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lossbook.operators.prefix import totals_before

SNAPSHOT = "2001-11-30"
CUTOFF = "1996-01-01"
OOT_CUTOFF = "2000-01-01"
LONG_RUN = ("1995-01", "1999-12")
FIXED_LGD = 0.725
FIXED_EAD_SHARE = 0.5
HELPERS = ["risk_band", "life"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hit(key: Column, modulus: int, rest: int = 0) -> Column:
    return key % modulus == rest


def _unless(null_when: Column, value: Column) -> Column:
    return F.when(~null_when, value)


def cents(c: Column) -> Column:
    """Two-decimal values as whole numbers, so that their sums are exact in any order."""
    return F.round(c * 100).cast("long")


def line_totals(lineitem: DataFrame) -> DataFrame:
    """One row per order with the bureau-like counts and sums of its lines."""
    def n(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return lineitem.groupBy(F.col("l_orderkey").alias("loan_id")).agg(
        F.count("*").alias("lines"),
        F.sum(cents(F.col("l_discount"))).alias("discount_cents"),
        F.sum(cents(F.col("l_tax"))).alias("tax_cents"),
        F.sum(cents(F.col("l_extendedprice"))).alias("price_cents"),
        n(status == "O").alias("open_lines"),
        n(flag == "R").alias("lines_r"),
        n(flag.isin("R", "A")).alias("lines_ra"),
        n((flag == "A") & (status == "F")).alias("lines_af"),
        n(flag == "A").alias("lines_a"),
    )


def _orders(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return orders.select(
        k.alias("loan_id"), F.col("o_custkey").alias("cust"),
        F.col("o_orderdate").cast("timestamp").alias("LoanOriginationDate"),
        F.col("o_orderstatus").alias("order_status"),
        cents(F.col("o_totalprice")).alias("price_cents_o"),
        (F.col("o_totalprice") / 10).alias("LoanOriginalAmount"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("risk_band"),
        F.when(_hit(k, 3), 12).when(_hit(k, 3, 1), 36).otherwise(60).cast("long").alias("Term"),
    )


def _with_prior(base: DataFrame) -> DataFrame:
    """Number and amount of the same customer's earlier loans."""
    day = F.to_date("LoanOriginationDate")
    chunk = F.shiftright(F.col("loan_id"), 20)      # at most 2**20 unique ids per chunk
    return totals_before(base, "cust", ["LoanOriginationDate", "loan_id"], [day, chunk],
                         {"prior_n": F.lit(1), "prior_cents": F.col("price_cents_o")})


def _column_rules() -> dict[str, tuple[Column, str]]:
    """Loan column -> (expression, parts it needs: c customer, n nation, l lines, p prior loans)."""
    k, c, p = F.col("loan_id"), F.col("cust"), F.col("risk_band")
    term, amount = F.col("Term"), F.col("LoanOriginalAmount")
    life = F.lit(1) + (k * 7) % term
    bal = F.col("c_acctbal")
    orig = F.col("LoanOriginationDate")
    age_days = F.datediff(F.lit(SNAPSHOT).cast("date"), orig)
    bad = (F.col("order_status") == "F") & (p <= 3)
    is_open = F.col("order_status") == "O"
    status = (F.when(is_open & _hit(k, 10), "Past Due (1-15 days)")
              .when(is_open & _hit(k, 10, 5), "Cancelled")
              .when(is_open & _hit(k, 10, 7), "FinalPaymentInProgress")
              .when(is_open, "Current")
              .when(bad & _hit(k, 2), "Chargedoff").when(bad, "Defaulted")
              .otherwise("Completed"))
    paid = F.when(is_open, F.lit(0.0)).when(
        bad, amount * F.least(life, term) / term).otherwise(amount)
    net_loss = F.when(bad, (amount - paid) * (0.5 + 0.05 * (k % 10))).otherwise(F.lit(0.0))
    income = F.when(_hit(c, 29), None).when(bal < 0, F.lit(0.0)).otherwise(bal)
    annual = bal * 12
    band = (F.when(bal <= 0, 0).when(annual < 25_000, 1).when(annual < 50_000, 2)
            .when(annual < 75_000, 3).when(annual < 100_000, 4).otherwise(5))
    shifted = F.when(_hit(k, 11), F.least(band + 1, F.lit(5))).otherwise(band)
    band_names = F.array(*[F.lit(s) for s in (
        "Not employed", "$1-24,999", "$25,000-49,999", "$50,000-74,999", "$75,000-99,999", "$100,000+")])
    jobs = F.array(*[F.lit(s) for s in (
        "Employed", "Full-time", "Part-time", "Self-employed", "Retired")])
    lines = F.col("lines")
    n_lines = F.coalesce(lines, F.lit(0))
    mean_discount = F.col("discount_cents") / (F.lit(100.0) * lines)
    mean_tax = F.col("tax_cents") / (F.lit(100.0) * lines)
    prior = F.col("prior_n") > 0
    borrowed = F.col("prior_cents") / 1000.0
    billed = F.when(_hit(k, 89), 0).otherwise(F.col("prior_n") * 12)
    no_card = _hit(c, 13)
    score = 520 + 40 * p + c % 20

    def count_of(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    return {
        "loan_id": (k, ""), "LoanOriginationDate": (orig, ""), "LoanOriginalAmount": (amount, ""),
        "Term": (term, ""), "LoanStatus": (status, ""),
        "ClosedDate": (F.when(~is_open, F.date_add(orig.cast("date"), F.least(30 * life, age_days).cast("int"))
                              .cast("timestamp")), ""),
        "LoanMonthsSinceOrigination": (F.floor(age_days / 30.44).cast("long"), ""),
        "CreditScoreRangeLower": (score.cast("double"), ""),
        "CreditScoreRangeUpper": (_unless(_hit(k, 53), (score + 19).cast("double")), ""),
        "DateCreditPulled": (orig - F.expr("INTERVAL 10 DAYS"), ""),
        "FirstRecordedCreditLine": (_unless(_hit(c, 31), F.date_sub(
            orig.cast("date"), (365 * (1 + c % 25)).cast("int")).cast("timestamp")), ""),
        "StatedMonthlyIncome": (income, "c"),
        "IncomeRange": (_unless(_hit(c, 37), F.element_at(band_names, shifted + 1)), "c"),
        "IncomeVerifiable": (_unless(_hit(c, 41), c % 5 != 0), ""),
        "DebtToIncomeRatio": (F.when(lines.isNull(), None).when(_hit(k, 97), F.lit(10.01))
                              .otherwise(mean_discount * 4 + (5 - p) * 0.05), "l"),
        "BankcardUtilization": (mean_tax * 16, "l"),
        "RevolvingCreditBalance": (F.when(no_card, F.lit(0.0)).otherwise(F.col("price_cents") / 1000.0), "l"),
        "AvailableBankcardCredit": (F.when(no_card, F.lit(0.0)).otherwise(F.abs(bal)), "c"),
        "CurrentCreditLines": (F.when(_hit(k, 101), 0).otherwise(n_lines).cast("double"), "l"),
        "OpenCreditLines": (count_of("open_lines").cast("double"), "l"),
        "InquiriesLast6Months": (count_of("lines_r").cast("double"), "l"),
        "TotalInquiries": (count_of("lines_ra").cast("double"), "l"),
        "CurrentDelinquencies": (count_of("lines_af").cast("double"), "l"),
        "DelinquenciesLast7Years": (count_of("lines_a").cast("double"), "l"),
        "PriorLoans": (F.when(prior, F.col("prior_n").cast("double")), "p"),
        "PriorPrincipalBorrowed": (F.when(prior, borrowed), "p"),
        "PriorPrincipalOutstanding": (F.when(prior, borrowed * ((k % 10) / 10.0)), "p"),
        "PriorPaymentsBilled": (F.when(prior, billed.cast("double")), "p"),
        "PriorPaymentsOnTime": (F.when(prior, F.greatest(billed - k % 5, F.lit(0)).cast("double")), "p"),
        "PriorPaymentsLateUnderMonth": (F.when(prior, (k % 3).cast("double")), "p"),
        "PriorPaymentsLateOverMonth": (F.when(prior, (k % 2).cast("double")), "p"),
        "ScoreChange": (F.when(prior, (k % 41 - 20).cast("double")), "p"),
        "BorrowerState": (_unless(_hit(c, 20), F.col("n_name")), "cn"),
        "Occupation": (F.col("c_mktsegment"), "c"),
        "EmploymentStatus": (F.element_at(jobs, p), ""),
        "ListingCategory": (k % 21, ""),
        "TotalCreditLinespast7years": (_unless(_hit(k, 47), ((k * 3) % 17 + 5).cast("double")), ""),
        "TotalTrades": (_unless(_hit(k, 59), ((k * 5) % 31 + 1).cast("double")), ""),
        "TradesNeverDelinquent": (((k * 7) % 21) / 20.0, ""),
        "TradesOpenedLast6Months": (((k * 11) % 4).cast("double"), ""),
        "OpenRevolvingAccounts": (((k * 13) % 12).cast("double"), ""),
        "OpenRevolvingMonthlyPayment": (((k * 17) % 800).cast("double"), ""),
        "AmountDelinquent": (_unless(_hit(k, 61), F.when((k * 19) % 10 < 8, F.lit(0.0))
                                     .otherwise(((k * 23) % 5000).cast("double"))), ""),
        "PublicRecordsLast10Years": (((k * 29) % 3).cast("double"), ""),
        "PublicRecordsLast12Months": (((k * 31) % 2).cast("double"), ""),
        "EmploymentStatusDuration": (_unless(_hit(k, 67), ((k * 37) % 240).cast("double")), ""),
        "IsBorrowerHomeowner": (c % 2 == 0, ""),
        "CurrentlyInGroup": (c % 7 == 0, ""),
        "LP_CustomerPrincipalPayments": (paid, ""),
        "LP_NetPrincipalLoss": (net_loss, ""),
        "LP_GrossPrincipalLoss": (F.when(bad, amount - paid).otherwise(F.lit(0.0)), ""),
        "LP_NonPrincipalRecoverypayments": (F.when(bad, (amount - paid) * 0.05).otherwise(F.lit(0.0)), ""),
        "IncumbentScore": (_unless(_hit(k, 43), 2 * p - (k % 2).cast("int")).cast("long"), ""),
        "IncumbentRating": (p.cast("long"), ""),
        "risk_band": (p, ""), "life": (life, ""),
    }


def loan_columns() -> list[str]:
    """All columns of the loan table."""
    return list(_column_rules())


def loan_book(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None,
              orders: DataFrame | None = None) -> DataFrame:
    """The loan table, or the asked columns of it (always with `loan_id`).

    `orders` replaces the stored orders, for example by a stream of arriving ones.
    """
    rules = _column_rules()
    wanted = list(rules) if columns is None else list(dict.fromkeys(["loan_id", *columns]))
    parts = set("".join(rules[n][1] for n in wanted))
    book = _orders(table(spark, sf_dir, "orders") if orders is None else orders)
    if "p" in parts:
        book = _with_prior(book)
    if "l" in parts:
        book = book.join(line_totals(table(spark, sf_dir, "lineitem")), "loan_id", "left")
    if "c" in parts:
        customer = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "cust")
        if "n" in parts:
            nation = table(spark, sf_dir, "nation").select(
                F.col("n_nationkey").alias("c_nationkey"), "n_name")
            customer = customer.join(nation, "c_nationkey", "left")
        book = book.join(customer, "cust", "left")      # the loans never depend on the columns asked
    return book.select(*[rules[n][0].alias(n) for n in wanted])


def fixed_pd(book: DataFrame) -> Column:
    """Stand-in default probability: a logistic form with known coefficients."""
    capped = F.coalesce(F.least(F.col("DebtToIncomeRatio"), F.lit(1.0)), F.lit(0.0))
    capped = F.when(F.col("DebtToIncomeRatio").isNull(), F.lit(0.0)).otherwise(capped)
    return 1 / (1 + F.exp(-(-0.7 - 0.5 * (F.col("risk_band") - 1) + 2 * capped)))


def monthly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """National monthly series (`ym`, two levels) from the months of the shipped lines."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("ym"))
            .agg(F.count("*").alias("n"), F.sum(cents(F.col("l_tax"))).alias("t"),
                 F.sum(cents(F.col("l_discount"))).alias("d"))
            .select("ym", (4 + F.col("t") / F.col("n")).alias("macro_unemployment"),
                    (F.col("d") / F.col("n")).alias("macro_fedfunds")))


def state_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State monthly series (`ym`, `state`, level) by the supplier's nation."""
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("state"))
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_tax")
    per_supplier = (li.groupBy("l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("ym"))
                    .agg(F.count("*").alias("n"), F.sum(cents(F.col("l_tax"))).alias("t")))
    return (per_supplier.join(supplier.join(nation, "n_nationkey"), "l_suppkey")
            .groupBy("ym", "state").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
            .select("ym", "state", (4 + F.col("t") / F.col("n")).alias("state_unemployment")))


def fixed_hazard(pd_: Column, month: Column, term: Column) -> Column:
    """Stand-in monthly hazard: rises with the PD, peaks at 30 % of the term."""
    off = month / term - 0.3
    return 1 / (1 + F.exp(-(-5.5 + 2.5 * pd_ - 3 * off * off)))


FORM_COLUMNS = ["LoanOriginalAmount", "Term", "ListingCategory", "StatedMonthlyIncome", "IncomeRange", "EmploymentStatus",
                "EmploymentStatusDuration", "IncomeVerifiable", "IsBorrowerHomeowner", "CreditScoreRangeLower",
                "DebtToIncomeRatio", "BankcardUtilization", "RevolvingCreditBalance", "AvailableBankcardCredit",
                "OpenCreditLines", "InquiriesLast6Months", "DelinquenciesLast7Years", "CurrentDelinquencies",
                "PublicRecordsLast10Years", "AmountDelinquent"]


def applications(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Loan applications as a form delivers them: every order is one, some answers are missing."""
    k = F.col("loan_id")
    form = loan_book(spark, sf_dir, FORM_COLUMNS, orders)
    return form.select(
        "loan_id", *[c for c in FORM_COLUMNS if c != "CreditScoreRangeLower"],
        (F.col("CreditScoreRangeLower") + 10).alias("credit_score_mid"),
        (1 + k % 25).cast("double").alias("credit_history_years"),
        (k % 4).cast("double").alias("PriorLoans"), ((k % 4) * 10).cast("double").alias("PriorPaymentsOnTime"),
        ((k % 25) * 0.010371).alias("offered_apr"))


def application_pd() -> Column:
    """The stand-in PD of a filled model row."""
    band = F.floor((F.col("CreditScoreRangeLower") - 520) / 40)
    return 1 / (1 + F.exp(-(-0.7 - 0.5 * (band - 1) + 2 * F.least(F.col("DebtToIncomeRatio"), F.lit(1.0)))))
