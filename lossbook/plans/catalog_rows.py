"""Queries on rows: sources and sinks, filters, features, labels and joins (S, F, P, L, J)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lossbook import fixed_values as V
from lossbook.operators import features as FE
from lossbook.operators import labels as LB
from lossbook.operators import overlay as OV
from lossbook.operators import population as PO
from lossbook.operators import profile as PR
from lossbook.operators import results as RE
from lossbook.operators.splits import calibration_loans, stratified_split
from lossbook.plans import jobs
from lossbook.plans import oracle_book as O
from lossbook.plans.registry import query
from lossbook.session import new_path, stage
from lossbook.sources import book as B
from lossbook.sources import series as SE
from lossbook.sources import tables as TB
from lossbook.sources.keyed import KeyedTable

POP = ["LoanOriginationDate", "LoanStatus"]

# ---- sources and sinks ---------------------------------------------------------------------
S1_COLUMNS = ["loan_id", "LoanOriginalAmount", "Term", "LoanStatus", "LoanOriginationDate", "ClosedDate",
              "StatedMonthlyIncome", "IncomeRange", "IncomeVerifiable", "DebtToIncomeRatio"]
_S1_SQL = O.book("""SELECT loan_id, LoanOriginalAmount, Term, LoanStatus,
  strftime(LoanOriginationDate,'%Y-%m-%d') AS LoanOriginationDate, strftime(ClosedDate,'%Y-%m-%d') AS ClosedDate,
  StatedMonthlyIncome, IncomeRange, IncomeVerifiable, DebtToIncomeRatio FROM book""")


def _dates_as_text(df):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("LoanOriginationDate", "ClosedDate") if c in df.columns})


@query("s01_loan_table_scan", _S1_SQL, {"DebtToIncomeRatio": 9})
def _(spark, d):
    src = B.loan_book(spark, d, S1_COLUMNS)
    path = new_path(spark, "loans-csv")
    TB.write_csv(src, path)
    return _dates_as_text(TB.read_loans_csv(spark, path, src.schema))


@query("s02_column_subset_scan", O.book("""SELECT loan_id, LoanStatus, Term,
  strftime(LoanOriginationDate,'%Y-%m-%d') AS LoanOriginationDate, strftime(ClosedDate,'%Y-%m-%d') AS ClosedDate FROM book"""))
def _(spark, d):
    path = new_path(spark, "loans")
    B.loan_book(spark, d, [*S1_COLUMNS]).write.parquet(path)
    return _dates_as_text(TB.read_loans(spark, path, ["loan_id", "LoanStatus", "LoanOriginationDate", "ClosedDate", "Term"]))


@query("s03_keyed_lookup_scan", O.macro("SELECT ym, state, state_unemployment FROM sta"), {"state_unemployment": 9})
def _(spark, d):
    path = new_path(spark, "state-csv")
    TB.write_csv(B.state_series(spark, d), path)
    return TB.read_lookup(spark, path, ["state_unemployment"], ["ym", "state"])


_DIRTY = "CASE WHEN substr(ym,6,2)='03' THEN 'n/a' ELSE x END"


def _raw_text(spark, d):
    """Series as text with unreadable months and numbers, as downloaded files have them."""
    month = F.substring("ym", 6, 2)
    return B.monthly_series(spark, d).select(
        F.when(month == "07", F.lit("unknown")).otherwise(F.concat("ym", F.lit("-01"))).alias("date"),
        F.when(month == "03", F.lit(".")).otherwise(F.col("macro_unemployment").cast("string")).alias("value"))


_S4_SQL = O.macro("SELECT ym, macro_unemployment AS level FROM nat WHERE substr(ym,6,2) NOT IN ('03','07')")


@query("s04_monthly_series", _S4_SQL, {"level": 9})
def _(spark, d):
    path = new_path(spark, "series-csv")
    TB.write_csv(_raw_text(spark, d), path)
    return SE.read_csv_series(spark, path, "level")


@query("s05_json_observations", _S4_SQL, {"level": 9})
def _(spark, d):
    path = new_path(spark, "series-json")
    _raw_text(spark, d).agg(F.collect_list(F.struct("date", "value")).alias("observations")).write.json(path)
    return SE.read_json_series(spark, path, "level")


_SPLIT_SQL = """
hashed AS MATERIALIZED (SELECT *, ((loan_id%1000003)*2654435761+42)%1000003 AS h FROM pop),
split AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY is_bad ORDER BY h, loan_id)
   <= ceil(count(*) OVER (PARTITION BY is_bad)*0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM hashed)"""


def split_sql(select: str) -> str:
    return O.features("SELECT 1").rsplit("SELECT 1", 1)[0].rstrip() + "," + _SPLIT_SQL + "\n" + select


@query("s06_split_writer", split_sql("SELECT loan_id, is_bad, split FROM split"))
def _(spark, d):
    pop = LB.with_target(PO.resolved(B.loan_book(spark, d, POP), B.CUTOFF)).select("loan_id", "is_bad")
    path = new_path(spark, "splits")
    TB.write_splits(stratified_split(stage(pop, "population")), path)
    return spark.read.parquet(path).select("loan_id", "is_bad", "split")


@query("s07_panel_write_read", O.panel("""SELECT year(LoanOriginationDate) AS vintage, count(*) AS loan_months,
  count(DISTINCT loan_id) AS loans, sum(defaulted_this_month)::BIGINT AS events FROM panel GROUP BY 1"""))
def _(spark, d):
    path = new_path(spark, "panel")
    TB.write_panel(jobs.panel(spark, d).select("loan_id", "LoanOriginationDate", "t", "t_frac", "defaulted_this_month"), path)
    return spark.read.parquet(path).groupBy("vintage").agg(
        F.count("*").alias("loan_months"), F.count(F.when(F.col("t") == 1, 1)).alias("loans"),
        F.sum("defaulted_this_month").alias("events"))


def _results(spark, d, shift: float = 0.0, versions=("v1", "v2")):
    """A keyed result table from the data: mean default flag per (version, model)."""
    b = LB.with_target(PO.resolved(B.loan_book(spark, d, [*POP, "EmploymentStatus"]), B.CUTOFF))
    per = b.groupBy(F.col("EmploymentStatus").alias("model")).agg((F.avg("is_bad") + shift).alias("value"))
    return per.withColumn("version", F.explode(F.array(*[F.lit(v) for v in versions])))


_RES = "res AS (SELECT EmploymentStatus AS model, avg(is_bad) AS value FROM pop GROUP BY 1)"


def results_sql(select: str) -> str:
    return O.features("SELECT 1").rsplit("SELECT 1", 1)[0].rstrip() + ",\n" + _RES + "\n" + select


@query("s08_result_upsert", results_sql("""SELECT 'v1' AS version, model, value FROM res
  UNION ALL SELECT 'v2', model, value+1 FROM res UNION ALL SELECT 'v3', model, value+2 FROM res"""), {"value": 9})
def _(spark, d):
    """A stored table after two upserts; the second repeats each of its keys."""
    results = KeyedTable(spark, new_path(spark, "results"), ["version", "model"], buckets=4)
    results.upsert(_results(spark, d).withColumn("run", F.lit(0)))
    results.upsert(_results(spark, d, 1.0, ("v2", "v3")).withColumn("run", F.lit(1)))
    again = _results(spark, d, 5.0, ("v3",)).withColumn("run", F.lit(2))
    results.upsert(again.unionByName(_results(spark, d, 2.0, ("v3",)).withColumn("run", F.lit(3))), ["run"])
    return results.read().select("version", "model", "value")


@query("s09_result_append", results_sql("""SELECT 'v1' AS version, model, value FROM res
  UNION ALL SELECT 'v2', model, value FROM res UNION ALL SELECT 'v3', model, value+1 FROM res"""), {"value": 9})
def _(spark, d):
    path = new_path(spark, "results")
    _results(spark, d).write.parquet(path)
    return RE.append_missing(path, _results(spark, d, 1.0, ("v2", "v3")), ["version", "model"]).select("version", "model", "value")


@query("s10_named_snapshot", results_sql("SELECT model, value FROM res"), {"value": 9})
def _(spark, d):
    table = _results(spark, d, versions=("v1",)).select("model", "value")
    path = TB.save_snapshot(table, new_path(spark, "snapshots"), "bad rate / by job", "target_rate")
    return spark.read.schema(table.schema).option("header", True).csv(path)


_TIMING_SQL = """
timed AS (SELECT least(floor(least(greatest(floor(epoch_us(ClosedDate-LoanOriginationDate)/86400000000)/30.44::DOUBLE/Term,0),1)*20),19)::INT AS bin
  FROM feat WHERE LoanStatus IN ('Chargedoff','Defaulted') AND ClosedDate IS NOT NULL
    AND LoanOriginationDate>=TIMESTAMP '1996-01-01' AND Term>0),
timing AS (SELECT r.bin::INT AS bin, coalesce(c.n,0)::BIGINT AS n, coalesce(c.n,0)::DOUBLE/(SELECT count(*) FROM timed) AS density
  FROM range(20) r(bin) LEFT JOIN (SELECT bin, count(*) AS n FROM timed GROUP BY 1) c ON c.bin=r.bin)"""


def timing_sql(select: str) -> str:
    return O.features("SELECT 1").rsplit("SELECT 1", 1)[0].rstrip() + "," + _TIMING_SQL + "\n" + select


@query("s11_json_artifact", timing_sql("SELECT bin, n, density FROM timing"), {"density": 9})
def _(spark, d):
    curve = jobs.default_timing(spark, d)
    path = new_path(spark, "timing-json")
    TB.write_artifact(curve, path)
    return spark.read.schema(curve.schema).json(path)


@query("s13_series_to_one_table", O.macro("""SELECT a.ym, macro_unemployment, macro_fedfunds, capital_state
  FROM nat a FULL JOIN (SELECT ym, avg(state_unemployment) AS capital_state FROM sta WHERE ym>='1995-06' GROUP BY 1) b USING (ym)"""),
       {"macro_unemployment": 9, "macro_fedfunds": 9, "capital_state": 9})
def _(spark, d):
    nat = B.monthly_series(spark, d)
    state = B.state_series(spark, d).filter(F.col("ym") >= "1995-06").groupBy("ym").agg(
        F.avg("state_unemployment").alias("capital_state"))
    return OV.outer_on_month([nat.select("ym", "macro_unemployment"), nat.select("ym", "macro_fedfunds"), state])


# ---- filters ---------------------------------------------------------------------------------
@query("f1_resolved_population", O.features("SELECT loan_id, LoanStatus FROM pop"))
def _(spark, d):
    return PO.resolved(B.loan_book(spark, d, POP), B.CUTOFF).select("loan_id", "LoanStatus")


@query("f2_panel_population", O.panel("SELECT loan_id, LoanStatus, T_obs FROM dur WHERE T_obs>=1"))
def _(spark, d):
    return jobs.panel_loans(spark, d).select("loan_id", "LoanStatus", "T_obs")


@query("f3_defaulted_only", O.features("SELECT loan_id, LoanStatus FROM pop WHERE is_bad=1"))
def _(spark, d):
    return PO.defaulted(jobs.population(spark, d, POP)).select("loan_id", "LoanStatus")


@query("f4_label_known", O.features("SELECT loan_id, lgd_label FROM pop WHERE is_bad=1 AND lgd_label IS NOT NULL"), {"lgd_label": 9})
def _(spark, d):
    pop = jobs.population(spark, d, [*POP, "LoanOriginalAmount", "LP_CustomerPrincipalPayments", "LP_NetPrincipalLoss"])
    return PO.label_known(PO.defaulted(pop).select("loan_id", LB.lgd_label().alias("lgd_label")), "lgd_label")


@query("f5_naive_target", O.features("SELECT loan_id, is_bad FROM feat WHERE LoanStatus IS NOT NULL"))
def _(spark, d):
    return PO.naive_target(B.loan_book(spark, d, ["LoanStatus"])).select("loan_id", "is_bad")


@query("f6_complete_cases", O.features(f"""SELECT loan_id FROM pop WHERE {' AND '.join(c + ' IS NOT NULL' for c in V.CLUSTER_FEATURES)}
  AND BorrowerState IS NOT NULL AND IncomeRange IS NOT NULL"""))
def _(spark, d):
    return PO.complete_cases(jobs.feature_table(spark, d), [*V.CLUSTER_FEATURES, "BorrowerState", "IncomeRange"]).select("loan_id")


@query("f7_default_timing_scope", O.features("""SELECT loan_id, strftime(ClosedDate,'%Y-%m-%d') AS ClosedDate FROM feat
  WHERE LoanStatus IN ('Chargedoff','Defaulted') AND ClosedDate IS NOT NULL AND LoanOriginationDate>=TIMESTAMP '1996-01-01' AND Term>0"""))
def _(spark, d):
    b = B.loan_book(spark, d, [*POP, "ClosedDate", "Term"])
    return _dates_as_text(PO.default_timing_scope(b, B.CUTOFF).select("loan_id", "ClosedDate"))


@query("f8_minimum_volume", O.features("""SELECT BorrowerState, count(*) AS "Count" FROM pop GROUP BY 1 HAVING count(*)>=330"""))
def _(spark, d):
    g = jobs.population(spark, d, [*POP, "BorrowerState"]).groupBy("BorrowerState").agg(F.count("*").alias("Count"))
    return PO.minimum_volume(g, 330)


# ---- derived and engineered features ---------------------------------------------------------
_PRIOR = ["PriorLoans", "PriorPaymentsOnTime", "PriorPaymentsBilled", "PriorPrincipalOutstanding", "PriorPrincipalBorrowed"]
P_FEATURES = {
    "p01_credit_score_mid": ("credit_score_mid", ["CreditScoreRangeLower", "CreditScoreRangeUpper"]),
    "p02_credit_history_months": ("credit_history_months", ["DateCreditPulled", "FirstRecordedCreditLine"]),
    "p03_loan_to_income": ("loan_to_income", ["LoanOriginalAmount", "StatedMonthlyIncome"]),
    "p04_stated_income_log": ("stated_income_log", ["StatedMonthlyIncome"]),
    "p05_is_repeat_borrower": ("is_repeat_borrower", ["PriorLoans"]),
    "p06_income_unverified": ("income_unverified", ["IncomeVerifiable"]),
    "p07_dti_capped_flag": ("dti_capped_flag", ["DebtToIncomeRatio"]),
    "p08_bankcard_util_bucket": ("bankcard_util_bucket", ["BankcardUtilization"]),
    "p10_est_monthly_debt": ("EstMonthlyDebtObligation", ["DebtToIncomeRatio", "StatedMonthlyIncome"]),
    "p11_disposable_income": ("DisposableIncome", ["DebtToIncomeRatio", "StatedMonthlyIncome"]),
    "p13_reference_pti": ("ReferencePTI", ["LoanOriginalAmount", "Term", "StatedMonthlyIncome"]),
    "p14_residual_income": ("ResidualIncome", ["LoanOriginalAmount", "Term", "StatedMonthlyIncome", "DebtToIncomeRatio"]),
    "p15_total_utilization": ("TotalUtilization", ["RevolvingCreditBalance", "AvailableBankcardCredit"]),
    "p16_open_to_total_line_ratio": ("OpenToTotalLineRatio", ["OpenCreditLines", "CurrentCreditLines"]),
    "p17_inquiry_velocity": ("InquiryVelocity", ["InquiriesLast6Months", "TotalInquiries"]),
    "p18_recent_delinquency_share": ("RecentDelinquencyShare", ["CurrentDelinquencies", "DelinquenciesLast7Years"]),
    "p19_on_time_rate": ("OnTimeRate", _PRIOR),
    "p20_outstanding_debt_ratio": ("OutstandingDebtRatio", _PRIOR),
    "p21_income_band_mismatch": ("IncomeBand_Mismatch", ["StatedMonthlyIncome", "IncomeRange"]),
    "p22_income_undefined": ("Income_Undefined", ["StatedMonthlyIncome"]),
}
_WHOLE = {"is_repeat_borrower", "income_unverified", "dti_capped_flag", "bankcard_util_bucket",
          "IncomeBand_Mismatch", "Income_Undefined"}


def _register_feature(name: str, feature: str, needs: list[str]) -> None:
    @query(name, O.features(f"SELECT loan_id, {feature} FROM feat"), {} if feature in _WHOLE else {feature: 7})
    def _(spark, d):
        return B.loan_book(spark, d, needs).select("loan_id", FE.feature_columns_by_name()[feature].alias(feature))


for _name, (_feature, _needs) in P_FEATURES.items():
    _register_feature(_name, _feature, _needs)


@query("p09_prior_history_fill", O.features(f"SELECT loan_id, {', '.join(V.PRIOR_HISTORY)} FROM feat"),
       {"PriorPrincipalBorrowed": 4, "PriorPrincipalOutstanding": 5})
def _(spark, d):
    return B.loan_book(spark, d, V.PRIOR_HISTORY).na.fill(0, V.PRIOR_HISTORY)


@query("p12_reference_payment", O.features("SELECT loan_id, ref_payment FROM feat"), {"ref_payment": 7})
def _(spark, d):
    return B.loan_book(spark, d, ["LoanOriginalAmount", "Term"]).select(
        "loan_id", FE.reference_payment(F.col("LoanOriginalAmount"), F.col("Term")).alias("ref_payment"))


# ---- labels, casts and feature sets ------------------------------------------------------------
@query("l1_pd_target", O.features("SELECT loan_id, is_bad FROM feat"))
def _(spark, d):
    return LB.with_target(B.loan_book(spark, d, ["LoanStatus"])).select("loan_id", "is_bad")


_LABELS = ["LoanOriginalAmount", "LP_CustomerPrincipalPayments", "LP_NetPrincipalLoss"]


@query("l2_ead_label", O.features("SELECT loan_id, ead_label FROM feat"), {"ead_label": 7})
def _(spark, d):
    return B.loan_book(spark, d, _LABELS).select("loan_id", LB.ead_label().alias("ead_label"))


@query("l3_lgd_label", O.features("SELECT loan_id, lgd_label FROM feat"), {"lgd_label": 9})
def _(spark, d):
    return B.loan_book(spark, d, _LABELS).select("loan_id", LB.lgd_label().alias("lgd_label"))


@query("l4_categorical_cast", O.features("""SELECT loan_id, IncomeRange, IncomeVerifiable::VARCHAR AS IncomeVerifiable, EmploymentStatus,
  Occupation, BorrowerState, ListingCategory::VARCHAR AS ListingCategory, IsBorrowerHomeowner::VARCHAR AS IsBorrowerHomeowner,
  CurrentlyInGroup::VARCHAR AS CurrentlyInGroup FROM feat"""))
def _(spark, d):
    return LB.categoricals_as_text(B.loan_book(spark, d, V.APPLICATION_CATEGORICAL))


_L5_SETS = [("base", False, None), ("engineered", True, None), *[("engineered", True, m) for m in ("raw", "ttc", "robust", "state", "ttc_geo")]]


def _l5_sql(layer: str, engineered: bool, macro: str | None) -> str:
    cols = LB.feature_columns(engineered, False, macro)
    return f"""SELECT '{layer}' AS layer, '{macro or 'none'}' AS macro, {len(cols)} AS n_features, count(*) AS n,
      count(*) FILTER (WHERE {' AND '.join(c + ' IS NOT NULL' for c in cols)}) AS complete FROM prep"""


@query("l5_feature_sets", O.overlay("SELECT 1").rsplit("SELECT 1", 1)[0].rstrip() + """,
prep AS MATERIALIZED (SELECT * FROM pop LEFT JOIN (SELECT * RENAME (ym AS mym) FROM macro) m ON m.mym=strftime(LoanOriginationDate,'%Y-%m')
  LEFT JOIN (SELECT * RENAME (ym AS sym) FROM stm) s ON s.sym=strftime(LoanOriginationDate,'%Y-%m') AND s.state=BorrowerState)
""" + " UNION ALL ".join(_l5_sql(*s) for s in _L5_SETS))
def _(spark, d):
    frame = stage(jobs.prepared(spark, d), "prepared")
    out = None
    for layer, engineered, macro in _L5_SETS:
        cols = LB.check_features(LB.feature_columns(engineered, False, macro))
        known = F.least(*[F.col(c).isNotNull().cast("int") for c in cols])
        row = frame.select(*cols).agg(F.count("*").alias("n"), F.sum(known).alias("complete")).select(
            F.lit(layer).alias("layer"), F.lit(macro or "none").alias("macro"), F.lit(len(cols)).alias("n_features"), "n", "complete")
        out = row if out is None else out.unionByName(row)
    return out


@query("l6_training_tables", O.features("""SELECT 'pd' AS metric, count(*) AS n, avg(is_bad) AS mean_label FROM pop
  UNION ALL SELECT 'ead', count(*), avg(ead_label) FROM pop WHERE is_bad=1 AND ead_label IS NOT NULL
  UNION ALL SELECT 'lgd', count(*), avg(lgd_label) FROM pop WHERE is_bad=1 AND lgd_label IS NOT NULL"""), {"mean_label": 5})
def _(spark, d):
    frame = jobs.feature_table(spark, d)
    out = None
    for metric in ("pd", "ead", "lgd"):
        t = LB.training_table(frame, metric, LB.feature_columns()).agg(
            F.count("*").alias("n"), F.avg("label").alias("mean_label")).select(F.lit(metric).alias("metric"), "n", "mean_label")
        out = t if out is None else out.unionByName(t)
    return out


_L7 = [*V.ENGINEERED_NUMERIC, *V.DERIVED_NUMERIC, "bankcard_util_bucket", "is_bad", "PriorLoans"]
_L7_MACRO = [*V.MACRO_TTC, "macro_unemployment_yoy", *V.STATE_TTC]


@query("l7_full_preparation", O.overlay(f"""SELECT loan_id, strftime(LoanOriginationDate,'%Y-%m-%d') AS LoanOriginationDate,
  ListingCategory::VARCHAR AS ListingCategory, {', '.join(_L7)}, {', '.join(_L7_MACRO)}
  FROM pop LEFT JOIN macro m ON m.ym=strftime(LoanOriginationDate,'%Y-%m')
  LEFT JOIN stm s ON s.ym=strftime(LoanOriginationDate,'%Y-%m') AND s.state=BorrowerState"""),
       {c: 6 for c in [*V.ENGINEERED_NUMERIC[:10], *V.DERIVED_NUMERIC[:4], *_L7_MACRO]})
def _(spark, d):
    frame = jobs.prepared(spark, d)
    return _dates_as_text(frame.select("loan_id", "LoanOriginationDate", "ListingCategory", *_L7, *_L7_MACRO))


_PURPOSE_SQL = "CASE ListingCategory " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in V.PURPOSES.items()) + " END"
_RATING_SQL = "CASE IncumbentRating " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in V.RATINGS.items()) + " END"


@query("l8_category_decode", O.book(f"SELECT loan_id, {_PURPOSE_SQL} AS purpose, {_RATING_SQL} AS rating FROM book"))
def _(spark, d):
    return B.loan_book(spark, d, ["ListingCategory", "IncumbentRating"]).select(
        "loan_id", LB.decode(F.col("ListingCategory"), V.PURPOSES).alias("purpose"),
        LB.decode(F.col("IncumbentRating"), V.RATINGS).alias("rating"))


# ---- joins -----------------------------------------------------------------------------------
_J1 = ["macro_unemployment", "macro_fedfunds", *V.MACRO_TTC, "macro_unemployment_yoy"]


@query("j1_loans_macro", O.overlay(f"""SELECT loan_id, {', '.join(_J1)} FROM book
  LEFT JOIN macro m ON m.ym=strftime(LoanOriginationDate,'%Y-%m')"""), {c: 8 for c in _J1})
def _(spark, d):
    return OV.attach_macro(B.loan_book(spark, d, ["LoanOriginationDate"]), jobs.macro_table(spark, d), _J1).drop("LoanOriginationDate")


_J2 = [*V.STATE_RAW, *V.STATE_TTC]


@query("j2_loans_state", O.overlay(f"""SELECT loan_id, BorrowerState, {', '.join(_J2)} FROM book
  LEFT JOIN stm s ON s.ym=strftime(LoanOriginationDate,'%Y-%m') AND s.state=BorrowerState"""), {c: 8 for c in _J2})
def _(spark, d):
    loans = B.loan_book(spark, d, ["LoanOriginationDate", "BorrowerState"])
    return OV.attach_state(loans, jobs.state_table(spark, d)).drop("LoanOriginationDate")


@query("j3_series_outer_join", O.macro("""SELECT ym, a.macro_unemployment, b.macro_fedfunds FROM
  (SELECT * FROM nat WHERE ym<'2000-01') a FULL JOIN (SELECT * FROM nat WHERE ym>='1996-01') b USING (ym)"""),
       {"macro_unemployment": 9, "macro_fedfunds": 9})
def _(spark, d):
    nat = B.monthly_series(spark, d)
    return OV.outer_on_month([nat.filter("ym < '2000-01'").select("ym", "macro_unemployment"),
                              nat.filter("ym >= '1996-01'").select("ym", "macro_fedfunds")])


@query("j4_group_statistic", O.features("""SELECT loan_id, coalesce(DebtToIncomeRatio, g.m, (SELECT median(DebtToIncomeRatio) FROM pop)) AS dti
  FROM pop LEFT JOIN (SELECT IncomeRange, median(DebtToIncomeRatio) AS m FROM pop GROUP BY 1) g USING (IncomeRange)"""), {"dti": 8})
def _(spark, d):
    pop = stage(jobs.population(spark, d, [*POP, "DebtToIncomeRatio", "IncomeRange"]), "population")
    fills = [PR.Fill("DebtToIncomeRatio", "median", within="IncomeRange")]
    return PR.fill_missing(pop, fills, PR.learn_fills(pop, fills)).select("loan_id", F.col("DebtToIncomeRatio").alias("dti"))


_CAL_SQL = """cal AS (SELECT loan_id FROM (SELECT loan_id, row_number() OVER (ORDER BY ((loan_id%1000003)*2654435761+42)%1000003, loan_id) AS rn,
  count(*) OVER () AS n FROM pop) WHERE rn<=greatest(floor(n*0.15::DOUBLE),1))"""


def cal_sql(select: str) -> str:
    return O.features("SELECT 1").rsplit("SELECT 1", 1)[0].rstrip() + ",\n" + _CAL_SQL + "\n" + select


@query("j5_semi_anti_by_ids", cal_sql("""SELECT 'cal' AS side, count(*) AS loans, sum(is_bad)::BIGINT AS bads FROM pop SEMI JOIN cal USING (loan_id)
  UNION ALL SELECT 'fit', count(*), sum(is_bad)::BIGINT FROM pop ANTI JOIN cal USING (loan_id)"""))
def _(spark, d):
    pop = stage(jobs.population(spark, d, POP).select("loan_id", "is_bad"), "population")
    ids = calibration_loans(pop).filter("is_cal").select("loan_id")
    sides = [("cal", "left_semi"), ("fit", "left_anti")]
    parts = [pop.join(ids, "loan_id", how).agg(F.count("*").alias("loans"), F.sum("is_bad").alias("bads"))
             .select(F.lit(n).alias("side"), "loans", "bads") for n, how in sides]
    return parts[0].unionByName(parts[1])


@query("j6_anti_by_key", results_sql("SELECT 'v1' AS version, model, value FROM res"), {"value": 9})
def _(spark, d):
    old, new = _results(spark, d), _results(spark, d, 1.0, ("v2", "v3"))
    return RE.todo(old, new, ["version", "model"]).select("version", "model", "value")


@query("j7_baseline_row", results_sql("""SELECT model, value FROM res UNION ALL
  SELECT 'automl_baseline', value+1 FROM res WHERE model='Retired'"""), {"value": 9})
def _(spark, d):
    results = _results(spark, d, versions=("v1",)).select("model", "value")
    base = _results(spark, d, 1.0, ("v0",)).select("model", "value")
    return RE.with_baseline(results, base, "Retired", "automl_baseline")


@query("j8_year_quarter_lookup", O.macro("""SELECT ym, x AS macro_unemployment, annual_change AS macro_unemployment_annual_change,
  quarterly_change AS macro_unemployment_quarterly_change FROM smooth WHERE series='macro_unemployment'"""),
       {"macro_unemployment": 8, "macro_unemployment_annual_change": 8, "macro_unemployment_quarterly_change": 8})
def _(spark, d):
    s = B.monthly_series(spark, d).select("ym", "macro_unemployment")
    s = OV.calendar_means(s, "macro_unemployment", [], OV.year_key(), "annual")
    return OV.calendar_means(s, "macro_unemployment", [], OV.quarter_key(), "quarterly").select(
        "ym", "macro_unemployment", "macro_unemployment_annual_change", "macro_unemployment_quarterly_change")


@query("j9_latest_row_lookup", O.macro("""SELECT state, ym, state_unemployment_ttc, state_unemployment_gap FROM (
  SELECT *, row_number() OVER (PARTITION BY state ORDER BY ym DESC) AS rn FROM stm
  WHERE state_unemployment_ttc IS NOT NULL AND state_unemployment_gap IS NOT NULL) WHERE rn=1"""),
       {"state_unemployment_ttc": 8, "state_unemployment_gap": 8})
def _(spark, d):
    return OV.latest_by_state(jobs.state_table(spark, d))
