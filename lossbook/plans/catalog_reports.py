"""Queries on aggregates, ordered series, panels, splits and picks (A, W, T, X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lossbook import fixed_values as V
from lossbook.operators import binning as BI
from lossbook.operators import collinear as CO
from lossbook.operators import overlay as OV
from lossbook.operators import panel as PA
from lossbook.operators import pricing as PX
from lossbook.operators import profile as PR
from lossbook.operators import results as RE
from lossbook.operators import risk_tables as RT
from lossbook.operators import splits as SP
from lossbook.operators import validate as VA
from lossbook.operators.features import all_features
from lossbook.operators.labels import with_target
from lossbook.operators.ranking import unpivot
from lossbook.plans import jobs
from lossbook.plans import oracle_book as O
from lossbook.plans.catalog_rows import POP, cal_sql, split_sql, timing_sql
from lossbook.plans.registry import query
from lossbook.session import stage
from lossbook.sources import book as B

NUMBERS = ["DebtToIncomeRatio", "BankcardUtilization", "StatedMonthlyIncome", "LoanOriginalAmount", "Term",
           "InquiriesLast6Months", "RevolvingCreditBalance", "credit_score_mid", "TotalUtilization", "OnTimeRate"]
TEXTS = ["IncomeRange", "EmploymentStatus", "BorrowerState", "bankcard_util_bucket"]
ALL_NUMERIC = [c for c in V.MODEL_FEATURES + V.ENGINEERED_NUMERIC if c not in V.CATEGORICAL_FEATURES]
ALL_TEXT = [c for c in V.MODEL_FEATURES if c in V.CATEGORICAL_FEATURES]


def _features(spark, d, columns=None):
    """The feature table as a stage: reports read it more than once, column by column."""
    frame = jobs.feature_table(spark, d)
    return stage(frame.select(*columns) if columns else frame, "features")


# ---- bins as SQL: exact rank arithmetic, right-closed bins ---------------------------------
def bin_sql(select: str, numbers=NUMBERS, texts=TEXTS, bins: int = 10) -> str:
    num = ", ".join(f"{c}::DOUBLE AS {c}" for c in numbers)
    txt = ", ".join(f"{c}::VARCHAR AS {c}" for c in texts)
    return O.features("SELECT 1").rsplit("SELECT 1", 1)[0].rstrip() + f""",
num AS MATERIALIZED (SELECT feature, value, y FROM (SELECT is_bad AS y, {num} FROM pop)
  UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(numbers)}))),
txt AS MATERIALIZED (SELECT feature, value, y FROM (SELECT is_bad AS y, {txt} FROM pop)
  UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(texts)}))),
ranked AS MATERIALIZED (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value)-1 AS r,
  count(*) OVER (PARTITION BY feature) AS n FROM num WHERE value IS NOT NULL),
many AS MATERIALIZED (SELECT feature, max(n) AS n FROM ranked GROUP BY 1 HAVING count(DISTINCT value)>{bins}),
want AS MATERIALIZED (SELECT feature, n, j.j AS j, hl.hl AS hl, (j.j*(n-1)+hl.hl*{bins - 1})//{bins} AS r
  FROM many CROSS JOIN range({bins + 1}) j(j) CROSS JOIN range(2) hl(hl)),
found AS MATERIALIZED (SELECT w.feature, w.j, max(w.n) AS n, max(value) FILTER (WHERE hl=0) AS lo, max(value) FILTER (WHERE hl=1) AS hi
  FROM want w JOIN ranked k ON k.feature=w.feature AND k.r=w.r GROUP BY 1,2),
grid AS MATERIALIZED (SELECT feature, j, lo+(hi-lo)*(((j*(n-1))%{bins})/{bins}.0::DOUBLE) AS q FROM found),
edges AS MATERIALIZED (SELECT feature, list(q ORDER BY q) AS es FROM (SELECT DISTINCT feature, q FROM grid) GROUP BY 1),
binned AS MATERIALIZED (
  SELECT num.feature, CASE WHEN es IS NOT NULL AND value IS NOT NULL
      THEN greatest(len(list_filter(es, lambda e: e<value))-1,0)::INT END AS bin,
    CASE WHEN value IS NULL THEN '<missing>' WHEN es IS NULL THEN value::VARCHAR END AS key, y
  FROM num LEFT JOIN edges USING (feature)
  UNION ALL SELECT feature, NULL, coalesce(value,'<missing>'), y FROM txt),
counts AS MATERIALIZED (SELECT feature, bin, key, count(*) AS "Count", sum(y)::BIGINT AS "Bads" FROM binned GROUP BY 1,2,3),
slots AS (SELECT feature, unnest(range(len(es)-1))::INT AS bin, NULL::VARCHAR AS key FROM edges
  UNION ALL SELECT feature, NULL, '<missing>' FROM edges),
padded AS (SELECT feature, bin, key, sum("Count")::BIGINT AS "Count", sum("Bads")::BIGINT AS "Bads" FROM
  (SELECT * FROM counts UNION ALL SELECT feature, bin, key, 0, 0 FROM slots) GROUP BY 1,2,3),
ev AS (SELECT *, "Count"-"Bads" AS "Goods", ("Bads"+0.5::DOUBLE)/sum("Bads") OVER w AS db,
  ("Count"-"Bads"+0.5::DOUBLE)/sum("Count"-"Bads") OVER w AS dg FROM padded WINDOW w AS (PARTITION BY feature)),
woe AS (SELECT feature, bin, key, "Count", "Bads", "Goods", round_even(ln(dg/db),4) AS "WOE",
  round_even((dg-db)*round_even(ln(dg/db),4),4) AS "IV", round_even("Bads"*100.0::DOUBLE/nullif("Count",0),2) AS bad_rate_pct FROM ev),
ev0 AS (SELECT *, ("Bads"+0.5::DOUBLE)/sum("Bads") OVER w AS db,
  ("Count"-"Bads"+0.5::DOUBLE)/sum("Count"-"Bads") OVER w AS dg FROM counts WINDOW w AS (PARTITION BY feature)),
iv0 AS (SELECT feature, sum((dg-db)*ln(dg/db)) AS iv FROM ev0 GROUP BY 1)
""" + select


_BAND = "CASE WHEN {0} IS NULL THEN '?' WHEN {0}<0.02 THEN 'useless' WHEN {0}<0.1 THEN 'weak' WHEN {0}<0.3 THEN 'medium' WHEN {0}<0.5 THEN 'strong' ELSE 'suspicious' END"
_TYPES_1 = {c: "double" for c in NUMBERS} | {"Term": "bigint"} | {c: "string" for c in TEXTS}


def _type_case(types: dict[str, str]) -> str:
    return "CASE feature " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in types.items()) + " END"


@query("a01_column_overview", bin_sql(f"""SELECT feature, {_type_case(_TYPES_1)} AS dtype, (count(*)-count(value))::BIGINT AS missing,
  count(DISTINCT value) AS "unique", count(value) AS "count", avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
  quantile_cont(value,0.25) AS q25, quantile_cont(value,0.5) AS q50, quantile_cont(value,0.75) AS q75, max(value) AS max,
  NULL::VARCHAR AS top, NULL::BIGINT AS freq FROM num GROUP BY 1
  UNION ALL SELECT feature, 'string', (count(*)-count(value))::BIGINT, count(DISTINCT value), count(value), NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  (SELECT value FROM txt t WHERE t.feature=x.feature AND value IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, value LIMIT 1),
  (SELECT count(*) FROM txt t WHERE t.feature=x.feature AND value IS NOT NULL GROUP BY value ORDER BY count(*) DESC, value LIMIT 1)
  FROM txt x GROUP BY 1"""), {c: 5 for c in ("mean", "std", "min", "q25", "q50", "q75", "max")})
def _(spark, d):
    return PR.column_overview(_features(spark, d, NUMBERS + TEXTS))


_BOOK_TYPES = {
    "loan_id": "bigint", "LoanOriginationDate": "timestamp", "Term": "bigint", "LoanStatus": "string", "ClosedDate": "timestamp",
    "StatedMonthlyIncome": "double", "IncomeRange": "string", "IncomeVerifiable": "boolean", "DebtToIncomeRatio": "double",
    "BankcardUtilization": "double", "CreditScoreRangeUpper": "double", "FirstRecordedCreditLine": "timestamp",
    "BorrowerState": "string", "PriorLoans": "double", "AmountDelinquent": "double", "TotalTrades": "double", "IncumbentScore": "bigint"}


@query("a02_missing_report", O.book("SELECT feature, missing, missing_pct, dtype, u AS \"unique\" FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, (count(*)-count({c}))::BIGINT AS missing, round_even((count(*)-count({c}))*100.0::DOUBLE/count(*),2) AS missing_pct,
    '{t}' AS dtype, count(DISTINCT {c}) AS u FROM book""" for c, t in _BOOK_TYPES.items()) + ")"))
def _(spark, d):
    return PR.missing_report(stage(B.loan_book(spark, d, list(_BOOK_TYPES)), "book"))


@query("a03_target_rate", bin_sql("""SELECT feature, bin, key, "Count", "Bads", round_even("Bads"*100.0::DOUBLE/"Count",2) AS bad_rate_pct,
  round_even("Count"*100.0::DOUBLE/sum("Count") OVER (PARTITION BY feature),2) AS share_pct FROM counts""", ALL_NUMERIC, ALL_TEXT))
def _(spark, d):
    return RT.target_rate(_features(spark, d, [*ALL_NUMERIC, *ALL_TEXT, V.TARGET]), ALL_NUMERIC + ALL_TEXT)


@query("a04_woe_iv", bin_sql("""SELECT *, round_even(sum("IV") OVER (PARTITION BY feature),4) AS "IV_total" FROM woe""", ALL_NUMERIC, ALL_TEXT))
def _(spark, d):
    return RT.woe_table(_features(spark, d, [*ALL_NUMERIC, *ALL_TEXT, V.TARGET]), ALL_NUMERIC + ALL_TEXT)


@query("a05_equal_frequency_bins", bin_sql("""SELECT feature, (i-1)::INT AS pos, es[i] AS edge FROM
  (SELECT feature, es, unnest(range(1,len(es)+1)) AS i FROM edges)""", ALL_NUMERIC, ALL_TEXT), {"edge": 6})
def _(spark, d):
    edges = BI.bin_edges(unpivot(_features(spark, d, ALL_NUMERIC), ALL_NUMERIC), 10)
    return edges.select("feature", F.posexplode("edges").alias("pos", "edge"))


@query("a06_iv_unrounded", bin_sql("SELECT feature, iv AS \"IV\" FROM iv0", ALL_NUMERIC, ALL_TEXT), {"IV": 7})
def _(spark, d):
    return RT.information_value(_features(spark, d, [*ALL_NUMERIC, *ALL_TEXT, V.TARGET]), ALL_NUMERIC + ALL_TEXT)


@query("a07_iv_ranking", bin_sql(f"""SELECT feature, "IV", {_BAND.format('"IV"')} AS band FROM
  (SELECT feature, round_even(sum("IV"),4) AS "IV" FROM woe GROUP BY 1)""", ALL_NUMERIC, ALL_TEXT))
def _(spark, d):
    return RT.iv_ranking(_features(spark, d, [*ALL_NUMERIC, *ALL_TEXT, V.TARGET]), ALL_NUMERIC + ALL_TEXT)


MEDIAN_COLUMNS = ["BankcardUtilization", "RevolvingCreditBalance", "AmountDelinquent", "EmploymentStatusDuration"]
MODE_COLUMNS = ["EmploymentStatus", "BorrowerState", "IncomeRange"]
ZERO_COLUMNS = ["PriorLoans", "PriorPrincipalBorrowed"]
FLAGGED = ["DebtToIncomeRatio", "PriorLoans", "EmploymentStatusDuration"]
FILLS = [*[PR.Fill(c, "median", flag=c in FLAGGED) for c in MEDIAN_COLUMNS], *[PR.Fill(c, "mode") for c in MODE_COLUMNS],
         PR.Fill("DebtToIncomeRatio", "median", within="IncomeRange", flag=True),
         *[PR.Fill(c, "constant", value=0.0, flag=c in FLAGGED) for c in ZERO_COLUMNS]]
_PLAN_COLUMNS = [f.column for f in FILLS]


def _plan_frame(spark, d):
    return stage(jobs.population(spark, d, _PLAN_COLUMNS).select("loan_id", V.TARGET, *_PLAN_COLUMNS), "population")


def _raw(select: str) -> str:
    """Population with unfilled prior-history columns, split in train and test."""
    return split_sql("SELECT 1").rsplit("SELECT 1", 1)[0].rstrip() + f""",
raw AS MATERIALIZED (SELECT b.loan_id, s.split, {', '.join('b.' + c for c in _PLAN_COLUMNS)} FROM book b JOIN split s USING (loan_id))
{select}"""


def _stats_sql(where: str) -> str:
    med = " UNION ALL ".join(f"SELECT 'median' AS rule, '{c}' AS feature, NULL::VARCHAR AS grp, median({c}) AS number, NULL::VARCHAR AS text FROM raw {where}"
                             for c in [*MEDIAN_COLUMNS, "DebtToIncomeRatio"])
    mode = " UNION ALL ".join(f"""SELECT 'mode', '{c}', NULL, NULL, (SELECT {c} FROM raw {where or 'WHERE true'} AND {c} IS NOT NULL
      GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1)""" for c in MODE_COLUMNS)
    grp = f"""SELECT 'grouped', 'DebtToIncomeRatio', IncomeRange, median(DebtToIncomeRatio), NULL FROM raw {where or 'WHERE true'}
      AND IncomeRange IS NOT NULL GROUP BY 3 HAVING count(DebtToIncomeRatio)>0"""
    return f"{med} UNION ALL {mode} UNION ALL {grp}"


@query("a08_impute_statistics", _raw(_stats_sql("")), {"number": 6})
def _(spark, d):
    return PR.learn_fills(_plan_frame(spark, d), FILLS)


def _apply_sql(where: str, rows: str) -> str:
    stats = _stats_sql(where)
    def one(c: str, kind: str, rule: str) -> str:
        return f"(SELECT max({kind}) FROM st WHERE rule='{rule}' AND feature='{c}')"
    med = ", ".join(f"coalesce({c}, {one(c, 'number', 'median')}) AS {c}" for c in MEDIAN_COLUMNS)
    mode = ", ".join(f"coalesce({c}, {one(c, 'text', 'mode')}) AS {c}" for c in MODE_COLUMNS)
    const = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ZERO_COLUMNS)
    flags = ", ".join(f"({c} IS NULL)::INT AS {c}_was_missing" for c in FLAGGED)
    return _raw("")[:-1].rstrip() + f""",
st AS MATERIALIZED ({stats})
SELECT loan_id, split, {med}, {mode}, {const}, {flags},
  coalesce(DebtToIncomeRatio, (SELECT max(number) FROM st WHERE rule='grouped' AND grp=raw.IncomeRange),
    {one('DebtToIncomeRatio', 'number', 'median')}) AS DebtToIncomeRatio FROM raw {rows}"""


_FILLED_DIGITS = {c: 6 for c in [*MEDIAN_COLUMNS, "DebtToIncomeRatio", *ZERO_COLUMNS]}


@query("a09_impute_apply", "SELECT * EXCLUDE (split) FROM (" + _apply_sql("", "") + ")", _FILLED_DIGITS)
def _(spark, d):
    frame = _plan_frame(spark, d)
    return PR.fill_missing(frame, FILLS, PR.learn_fills(frame, FILLS)).drop(V.TARGET)


@query("a10_fit_train_apply_both", _apply_sql("WHERE split='train'", ""), _FILLED_DIGITS)
def _(spark, d):
    frame = stage(SP.stratified_split(_plan_frame(spark, d)), "split")
    train, test, _stats = PR.clean(frame.filter("split = 'train'"), FILLS, frame.filter("split = 'test'"))
    return train.unionByName(test).drop(V.TARGET)


_DEFAULT_TEXT = ["IncomeRange", "EmploymentStatus", "BorrowerState", "bankcard_util_bucket", "Occupation"]
_DEFAULT_NUM = [c for c in NUMBERS if c not in ("TotalUtilization", "OnTimeRate")]


@query("a11_feature_defaults", bin_sql("""SELECT feature, median(value) AS number, NULL::VARCHAR AS text FROM num GROUP BY 1
  UNION ALL SELECT feature, NULL, (SELECT value FROM txt t WHERE t.feature=x.feature AND value IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, value LIMIT 1)
  FROM txt x GROUP BY 1""", _DEFAULT_NUM, _DEFAULT_TEXT), {"number": 6})
def _(spark, d):
    return PR.feature_defaults(_features(spark, d, _DEFAULT_NUM + _DEFAULT_TEXT), _DEFAULT_NUM, _DEFAULT_TEXT)


# ---- calibration, backtest, timing -----------------------------------------------------------
_PD_BINS = """SELECT bin AS bucket, count(*) AS n, avg(p) AS pred_PD, avg(y) AS actual_PD, avg(p)-avg(y) AS gap FROM (
  SELECT p, y, greatest(len(list_filter(es, lambda e: e<p))-1,0)::INT AS bin FROM (
    SELECT pd AS p, is_bad AS y, (SELECT list(DISTINCT q) FROM g) AS es FROM pop)) GROUP BY 1"""


def pd_bins(select: str = _PD_BINS) -> str:
    return O.features("SELECT 1").rsplit("SELECT 1", 1)[0].rstrip() + f""",
r AS MATERIALIZED (SELECT pd AS v, row_number() OVER (ORDER BY pd)-1 AS r, count(*) OVER () AS n FROM pop),
g AS MATERIALIZED (SELECT lo.v+(hi.v-lo.v)*(((j.j*(lo.n-1))%10)/10.0::DOUBLE) AS q FROM range(11) j(j)
  JOIN r lo ON lo.r=(j.j*(lo.n-1))//10 JOIN r hi ON hi.r=(j.j*(hi.n-1)+9)//10)
{select}"""


_CAL_DIGITS = {"pred_PD": 8, "actual_PD": 8, "gap": 8}


def _scored(spark, d):
    return stage(jobs.scored_population(spark, d).select("loan_id", "LoanOriginationDate", V.TARGET, "pd", "risk_band"), "scored")


@query("a12_calibration_decile", pd_bins(), _CAL_DIGITS)
def _(spark, d):
    return VA.calibration_by_bucket(_scored(spark, d), "pd")


@query("a13_calibration_vintage", O.features("""SELECT year(LoanOriginationDate)::INT AS year, count(*) AS n, avg(pd) AS pred_PD,
  avg(is_bad) AS actual_PD, avg(pd)-avg(is_bad) AS gap FROM pop GROUP BY 1"""), _CAL_DIGITS)
def _(spark, d):
    return VA.calibration_by_vintage(jobs.scored_population(spark, d), "pd")


@query("a14_weighted_calibration_error", pd_bins(f"SELECT sum(abs(gap)*n)/sum(n) AS weighted_error FROM ({_PD_BINS})"), {"weighted_error": 9})
def _(spark, d):
    return VA.weighted_calibration_error(VA.calibration_by_bucket(_scored(spark, d), "pd"))


@query("a15_ecl_backtest", O.features("""SELECT coalesce(y::VARCHAR,'ALL') AS year, n, n_default, predicted_el, realized_loss,
  predicted_el/nullif(realized_loss,0) AS ratio, CASE WHEN y IS NULL THEN '' WHEN y>=2000 THEN 'true' ELSE 'false' END AS is_oot FROM (
  SELECT year(LoanOriginationDate) AS y, count(*) AS n, sum(is_bad)::BIGINT AS n_default,
    sum(pd*0.725::DOUBLE*LoanOriginalAmount*0.5::DOUBLE) AS predicted_el, sum(greatest(coalesce(LP_NetPrincipalLoss,0),0)) AS realized_loss
  FROM pop GROUP BY ROLLUP(year(LoanOriginationDate)))"""), {"predicted_el": 2, "realized_loss": 2, "ratio": 8})
def _(spark, d):
    return jobs.ecl_backtest(spark, d)


@query("a16_default_timing", timing_sql("SELECT bin, n, density FROM timing"), {"density": 9})
def _(spark, d):
    return jobs.default_timing(spark, d)


@query("a16_default_timing_peak", timing_sql("""SELECT (min_by(bin, (-n, bin))+0.5::DOUBLE)/20 AS peak, sum(n)::BIGINT AS n FROM timing"""), {"peak": 6})
def _(spark, d):
    return VA.timing_peak(jobs.default_timing(spark, d))


@query("a17_segment_bad_rate", O.features("""SELECT bankcard_util_bucket, Term, count(*) AS n, avg(is_bad) AS bad_rate FROM pop GROUP BY 1,2"""), {"bad_rate": 8})
def _(spark, d):
    return VA.segment_rates(jobs.feature_table(spark, d), ["bankcard_util_bucket", "Term"])


@query("a18_loan_level_collapse", O.panel("""SELECT loan_id, T_obs, is_event, Term FROM panel WHERE t=1"""))
def _(spark, d):
    return PA.first_rows(jobs.panel(spark, d)).select("loan_id", "T_obs", "is_event", "Term")


_HAZARD = "1/(1+exp(-(-5.5::DOUBLE+2.5::DOUBLE*pd-3*((t::DOUBLE/Term-0.3::DOUBLE)*(t::DOUBLE/Term-0.3::DOUBLE)))))"


def hazard_sql(select: str) -> str:
    return O.features("SELECT 1").rsplit("SELECT 1", 1)[0].rstrip() + f""",
hz AS MATERIALIZED (SELECT loan_id, Term, t, {_HAZARD} AS h FROM (SELECT loan_id, Term, pd, unnest(generate_series(1,Term)) AS t FROM pop)),
sv AS MATERIALIZED (SELECT *, exp(sum(ln(1-h)) OVER (PARTITION BY loan_id ORDER BY t)) AS s FROM hz),
mg AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY loan_id ORDER BY t),1)*h AS m FROM sv)
{select}"""


@query("a19_grouped_product", hazard_sql("SELECT loan_id, 1-exp(sum(ln(1-h))) AS lifetime_pd FROM hz GROUP BY 1"), {"lifetime_pd": 8})
def _(spark, d):
    return PX.lifetime_from_rows(jobs.hazard_rows(spark, d))


_GRID = """grid_r AS (SELECT EmploymentStatus AS model, CASE WHEN LoanOriginationDate<TIMESTAMP '2000-01-01' THEN 'random' ELSE 'oot' END AS split,
  CASE WHEN Term=12 THEN 'base' WHEN Term=36 THEN 'raw' ELSE 'ttc' END AS macro, avg(is_bad) AS value FROM pop GROUP BY 1,2,3)"""


def grid_sql(select: str) -> str:
    return O.features("SELECT 1").rsplit("SELECT 1", 1)[0].rstrip() + ",\n" + _GRID + "\n" + select


def _grid_results(spark, d):
    """A (model, split, macro) result table taken from the data."""
    pop = jobs.population(spark, d, ["EmploymentStatus", "Term"])
    split = F.when(F.col("LoanOriginationDate") < F.lit(B.OOT_CUTOFF).cast("timestamp"), "random").otherwise("oot")
    macro = F.when(F.col("Term") == 12, "base").when(F.col("Term") == 36, "raw").otherwise("ttc")
    return pop.groupBy(F.col("EmploymentStatus").alias("model"), split.alias("split"), macro.alias("macro")).agg(F.avg(V.TARGET).alias("value"))


_CONDS = ["random+raw", "random+ttc", "oot+raw", "oot+ttc"]


@query("a20_results_pivot", grid_sql("SELECT model, " + ", ".join(
    f"""avg(value) FILTER (WHERE split||'+'||macro='{c}') AS "{c}" """ for c in _CONDS) + " FROM grid_r GROUP BY 1"))
def _(spark, d):
    pivot = RE.condition_pivot(_grid_results(spark, d), _CONDS, "value")
    return pivot


@query("a21_crosstabs", O.features("""SELECT IncomeRange, avg(is_bad) FILTER (WHERE IsBorrowerHomeowner) AS rate_owner,
  avg(is_bad) FILTER (WHERE NOT IsBorrowerHomeowner) AS rate_other,
  count(*) FILTER (WHERE IsBorrowerHomeowner)::DOUBLE/count(*) AS share_owner FROM pop WHERE IncomeRange IS NOT NULL GROUP BY 1"""),
       {"rate_owner": 8, "rate_other": 8, "share_owner": 8})
def _(spark, d):
    pop = jobs.population(spark, d, ["IncomeRange", "IsBorrowerHomeowner"]).filter(F.col("IncomeRange").isNotNull())
    rates = PR.bad_rate_crosstab(pop, "IncomeRange", "IsBorrowerHomeowner", [True, False], V.TARGET).withColumnsRenamed(
        {"true": "rate_owner", "false": "rate_other"})
    shares = PR.share_crosstab(pop, "IncomeRange", "IsBorrowerHomeowner", [True]).withColumnRenamed("True", "share_owner")
    return rates.join(shares, "IncomeRange")


_AT = "list_position([" + ",".join(f"'{c}'" for c in ALL_NUMERIC) + "], {}.feature)"


@query("a22_spearman_pairs", O.features(f""", long AS (UNPIVOT (SELECT loan_id, {",".join(f"{c}::DOUBLE AS {c}" for c in ALL_NUMERIC)} FROM pop)
  ON {",".join(ALL_NUMERIC)} INTO NAME feature VALUE v)
SELECT * FROM (SELECT a, b, corr(ra, rb) AS rho FROM (
  SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY va)+(count(*) OVER (PARTITION BY a, b, va)-1)/2.0::DOUBLE AS ra,
         rank() OVER (PARTITION BY a, b ORDER BY vb)+(count(*) OVER (PARTITION BY a, b, vb)-1)/2.0::DOUBLE AS rb
  FROM (SELECT x.feature AS a, y.feature AS b, x.v AS va, y.v AS vb FROM long x JOIN long y
        ON x.loan_id=y.loan_id AND {_AT.format("x")}<{_AT.format("y")}))
  GROUP BY a, b) WHERE abs(rho)>=0.3 AND NOT isnan(rho)"""), {"rho": 8})
def _(spark, d):
    return CO.strong_pairs(CO.spearman_pairs(jobs.feature_table(spark, d), "loan_id", ALL_NUMERIC), 0.3)


@query("a23_vif")
def _(spark, d):
    return CO.variance_inflation(jobs.feature_table(spark, d), ALL_NUMERIC, V.ENGINEERED_NUMERIC)


@query("a24_book_summary", split_sql("""SELECT (SELECT count(*) FROM book) AS raw_rows, count(*) AS population, sum(is_bad)::BIGINT AS bads,
  avg(is_bad) AS bad_rate, count(*) FILTER (WHERE split='train') AS train_rows, count(*) FILTER (WHERE split='test') AS test_rows FROM split"""), {"bad_rate": 9})
def _(spark, d):
    book = B.loan_book(spark, d, POP)
    pop = stage(jobs.population(spark, d, []).select("loan_id", V.TARGET), "population")
    return VA.book_summary(book, SP.stratified_split(pop))


@query("a25_panel_checks", O.panel("""SELECT count(*) AS loans, count(*) FILTER (WHERE is_event) AS events,
  count(*) FILTER (WHERE LoanStatus='Current') AS current, sum(T_obs)::BIGINT AS loan_months,
  count(*) FILTER (WHERE T_obs NOT BETWEEN 1 AND Term) AS out_of_bounds, count(ClosedDate) AS closed,
  median(abs(round_even(epoch_us(ClosedDate-LoanOriginationDate)/86400000000*(12.0::DOUBLE/365.25::DOUBLE),0)-LoanMonthsSinceOrigination)) AS median_age_gap
  FROM dur WHERE T_obs>=1"""), {"median_age_gap": 3})
def _(spark, d):
    loans = stage(jobs.panel_loans(spark, d), "durations")
    checks = PA.panel_checks(loans)
    PA.assert_panel(checks)
    return checks.select("*", jobs.age_gap_median(loans).scalar().alias("median_age_gap"))


@query("a26_class_weight", O.features("SELECT (count(*)-sum(is_bad))/greatest(sum(is_bad),1)::DOUBLE AS class_weight FROM pop"), {"class_weight": 9})
def _(spark, d):
    return VA.class_weight(jobs.population(spark, d, []))


# ---- windows and ordered series ----------------------------------------------------------------
_W = {"w1_trailing_mean": ("ma12", "ma12"), "w2_ewm": ("ewma", "ewma"), "w3_long_run_mean": ("longrun", "longrun"),
      "w4_ttc_anchor": ("ttc", "ttc"), "w5_gap": ("gap", "gap"), "w6_year_over_year": ("yoy", "yoy"), "w7_natural_log": ("ln", "ln_x")}


def _register_smooth(name: str, suffix: str, column: str) -> None:
    @query(name, O.macro(f"SELECT series, unit, ym, {column} AS value FROM smooth"), {"value": 8})
    def _(spark, d):
        nat = OV.smooth_all(B.monthly_series(spark, d), V.MACRO_RAW, [], B.LONG_RUN)
        sta = OV.smooth_all(B.state_series(spark, d), V.STATE_RAW, ["state"], B.LONG_RUN)
        out = None
        for frame, series in [(nat, s) for s in V.MACRO_RAW] + [(sta, V.STATE_RAW[0])]:
            unit = F.col("state") if "state" in frame.columns else F.lit("")
            part = frame.select(F.lit(series).alias("series"), unit.alias("unit"), "ym", F.col(f"{series}_{suffix}").alias("value"))
            out = part if out is None else out.unionByName(part)
        return out


for _n, (_s, _c) in _W.items():
    _register_smooth(_n, _s, _c)

_CAL_W = {"w8_annual_mean": ("annual_avg", OV.year_key, "annual"), "w9_annual_change": ("annual_change", OV.year_key, "annual")}


def _register_calendar(name: str, column: str, key, prefix: str) -> None:
    @query(name, O.macro(f"SELECT series, ym, {column} AS value FROM smooth WHERE unit=''"), {"value": 8})
    def _(spark, d):
        nat = B.monthly_series(spark, d)
        out = None
        for s in V.MACRO_RAW:
            part = OV.calendar_means(nat, s, [], key(), prefix).select(
                F.lit(s).alias("series"), "ym", F.col(f"{s}_{column}").alias("value"))
            out = part if out is None else out.unionByName(part)
        return out


for _n, (_c, _k, _p) in _CAL_W.items():
    _register_calendar(_n, _c, _k, _p)


@query("w10_quarter_mean_change", O.macro("""SELECT ym, quarterly_avg AS avg_q, quarterly_change AS change_q FROM smooth WHERE series='macro_fedfunds'"""),
       {"avg_q": 8, "change_q": 8})
def _(spark, d):
    out = OV.calendar_means(B.monthly_series(spark, d), "macro_fedfunds", [], OV.quarter_key(), "quarterly")
    return out.select("ym", F.col("macro_fedfunds_quarterly_avg").alias("avg_q"), F.col("macro_fedfunds_quarterly_change").alias("change_q"))


@query("w11_month_counter", O.panel("SELECT loan_id, min(t) AS first_month, max(t) AS last_month, count(*) AS months FROM panel GROUP BY 1"))
def _(spark, d):
    return jobs.panel(spark, d).groupBy("loan_id").agg(
        F.min("t").alias("first_month"), F.max("t").alias("last_month"), F.count("*").alias("months"))


@query("w12_running_survival", hazard_sql("SELECT loan_id, t, s AS survival FROM sv"), {"survival": 8})
def _(spark, d):
    return PX.survival_rows(jobs.hazard_rows(spark, d)).select("loan_id", "t", "survival")


@query("w13_running_marginal_mass", hazard_sql("""SELECT Term, t, count(*) AS n, avg(a) AS mean_alive, min(a) AS min_alive FROM (
  SELECT Term, t, 1-coalesce(sum(m) OVER (PARTITION BY loan_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS a FROM mg) GROUP BY 1,2"""),
       {"mean_alive": 8, "min_alive": 8})
def _(spark, d):
    rows = PX.alive_at_start(PX.survival_rows(jobs.hazard_rows(spark, d)))
    return rows.groupBy("Term", "t").agg(F.count("*").alias("n"), F.avg("alive_start").alias("mean_alive"), F.min("alive_start").alias("min_alive"))


# ---- sort, top-k, set operations, row generation -------------------------------------------------
@query("t1_sorted_report", O.features("""SELECT BorrowerState, count(*) AS n, avg(is_bad) AS bad_rate FROM pop GROUP BY 1"""), {"bad_rate": 9})
def _(spark, d):
    return VA.segment_rates(jobs.population(spark, d, ["BorrowerState"]), "BorrowerState").orderBy(
        F.col("bad_rate").desc_nulls_last(), "BorrowerState")


@query("t2_top_n", bin_sql("""SELECT feature, round_even(iv,4) AS "IV" FROM iv0 ORDER BY iv DESC, feature LIMIT 5"""))
def _(spark, d):
    iv = RT.information_value(_features(spark, d, [*NUMBERS, *TEXTS, V.TARGET]), NUMBERS + TEXTS)
    return RE.top_n(iv, 5, [F.desc("IV"), F.asc("feature")]).withColumn("IV", F.bround("IV", 4))


_T3 = {"DebtToIncomeRatio": 2.0, "BankcardUtilization": 0.5, "OnTimeRate": -0.7, "TotalUtilization": 0.31, "InquiryVelocity": 0.9}


@query("t3_top_k_per_row", O.features("SELECT loan_id, rank, feature, value FROM (SELECT loan_id, feature, value, "
       "row_number() OVER (PARTITION BY loan_id ORDER BY abs(value) DESC, feature) AS rank FROM ("
       + " UNION ALL ".join(f"SELECT loan_id, '{c}' AS feature, {c}*{w}::DOUBLE AS value FROM pop" for c, w in _T3.items())
       + ") WHERE value IS NOT NULL) WHERE rank<=3"), {"value": 8})
def _(spark, d):
    frame = jobs.feature_table(spark, d)
    return RE.top_k_by_size(frame, {c: F.col(c) * w for c, w in _T3.items()}, 3)


@query("t4_nearest_rank_picks", O.features("""SELECT tenth, loan_id, pd FROM (SELECT loan_id, pd, row_number() OVER (ORDER BY pd, loan_id)-1 AS r,
  count(*) OVER () AS n FROM pop) JOIN (VALUES (1),(5),(9)) q(tenth) ON r=(tenth*(n-1))//10"""), {"pd": 9})
def _(spark, d):
    return RE.nearest_rank_picks(_scored(spark, d).select("loan_id", "pd"), "pd", "loan_id", [1, 5, 9]).select("tenth", "loan_id", "pd")


@query("t5_union_of_parts", split_sql("SELECT loan_id, split, is_bad FROM split"))
def _(spark, d):
    frame = stage(SP.stratified_split(stage(jobs.population(spark, d, []).select("loan_id", V.TARGET), "population")), "split")
    return frame.filter("split = 'train'").unionByName(frame.filter("split = 'test'")).select("loan_id", "split", V.TARGET)


@query("t6_keep_last", """SELECT o_custkey AS cust, o_orderkey AS loan_id, o_totalprice AS price FROM (SELECT *, row_number() OVER
  (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn=1""")
def _(spark, d):
    orders = B.table(spark, d, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("at"),
                                                F.col("o_orderkey").alias("loan_id"), F.col("o_totalprice").alias("price"))
    return RE.keep_last(orders, ["cust"], ["at", "loan_id"]).select("cust", "loan_id", "price")


@query("t7_person_period_panel", O.panel("SELECT loan_id, t, t_frac, defaulted_this_month FROM panel"), {"t_frac": 9})
def _(spark, d):
    return jobs.panel(spark, d).select("loan_id", "t", "t_frac", "defaulted_this_month")


@query("t8_full_term_expansion", hazard_sql("SELECT loan_id, t, t::DOUBLE/Term AS t_frac FROM hz"), {"t_frac": 9})
def _(spark, d):
    loans = jobs.population(spark, d, ["Term"]).select("loan_id", "Term")
    return PA.expand(loans, "Term").select("loan_id", "t", "t_frac")


@query("t9_observed_duration", O.panel("SELECT loan_id, T_obs, is_event FROM dur WHERE T_obs>=1"))
def _(spark, d):
    return jobs.panel_loans(spark, d).select("loan_id", "T_obs", "is_event")


# ---- splits and samples ----------------------------------------------------------------------
def _pop_stage(spark, d):
    return stage(jobs.population(spark, d, []).select("loan_id", V.TARGET, "LoanOriginationDate"), "population")


@query("x1_stratified_split", split_sql("SELECT loan_id, is_bad, split FROM split"))
def _(spark, d):
    return SP.stratified_split(_pop_stage(spark, d)).select("loan_id", V.TARGET, "split")


@query("x2_out_of_time_split", O.features("""SELECT loan_id, CASE WHEN LoanOriginationDate<TIMESTAMP '2000-01-01' THEN 'train' ELSE 'test' END AS split
  FROM pop WHERE LoanOriginationDate IS NOT NULL"""))
def _(spark, d):
    return SP.out_of_time(jobs.population(spark, d, []), B.OOT_CUTOFF).select("loan_id", "split")


@query("x3_group_disjoint_split", cal_sql("SELECT loan_id, loan_id IN (SELECT loan_id FROM cal) AS is_cal FROM pop"))
def _(spark, d):
    return SP.calibration_loans(_pop_stage(spark, d))


_X4 = """keyed AS (SELECT loan_id, t, defaulted_this_month AS y, loan_id*1000+t AS rk, (((loan_id*1000+t)%1000003)*2654435761+42)%1000003 AS h FROM panel),
neg AS (SELECT *, row_number() OVER (ORDER BY h, rk) AS rn FROM keyed WHERE y=0)
SELECT loan_id, t, y AS defaulted_this_month FROM keyed WHERE y=1
UNION ALL SELECT loan_id, t, y FROM neg WHERE rn<=20*(SELECT count(*) FROM keyed WHERE y=1)"""


@query("x4_negative_downsampling", O.panel("SELECT 1").rsplit("SELECT 1", 1)[0].rstrip() + ",\n" + _X4)
def _(spark, d):
    rows = jobs.panel(spark, d).select("loan_id", "t", PA.EVENT, (F.col("loan_id") * 1000 + F.col("t")).alias("row_key"))
    return SP.downsample_negatives(stage(rows, "panel"), PA.EVENT, "row_key").select("loan_id", "t", PA.EVENT)


@query("x5_stratified_folds", split_sql("""SELECT loan_id, is_bad, CASE WHEN rn<=ceil(n*(1/3.0::DOUBLE)) THEN 0
  WHEN rn<=ceil(n*(2/3.0::DOUBLE)) THEN 1 ELSE 2 END AS fold FROM (SELECT loan_id, is_bad,
  row_number() OVER (PARTITION BY is_bad ORDER BY h, loan_id) AS rn, count(*) OVER (PARTITION BY is_bad) AS n FROM hashed)"""))
def _(spark, d):
    return SP.stratified_folds(_pop_stage(spark, d)).select("loan_id", V.TARGET, "fold")


@query("x6_fixed_size_sample", split_sql("SELECT loan_id, is_bad FROM (SELECT *, row_number() OVER (ORDER BY h, loan_id) AS rn FROM hashed) WHERE rn<=4000"))
def _(spark, d):
    return SP.fixed_size_sample(_pop_stage(spark, d), 4000).select("loan_id", V.TARGET)
