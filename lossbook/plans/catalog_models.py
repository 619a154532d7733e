"""Queries on metrics, term structures, pricing, scoring and the stream (M, N, L9, L10, R1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lossbook import fixed_values as V
from lossbook.functions import curves as C
from lossbook.operators import features as FE
from lossbook.operators import labels as LB
from lossbook.operators import metrics as ME
from lossbook.operators import overlay as OV
from lossbook.operators import panel as PA
from lossbook.operators import pricing as PX
from lossbook.operators import profile as PR
from lossbook.operators import results as RE
from lossbook.operators import splits as SP
from lossbook.operators import survival as SU
from lossbook.operators.labels import ead_label, lgd_label
from lossbook.operators.population import complete_cases, defaulted, label_known
from lossbook.plans import jobs
from lossbook.plans import oracle_book as O
from lossbook.plans.bundle import SCORED, ScoringBundle, fit_bundle
from lossbook.plans.catalog_reports import _grid_results, _scored, grid_sql, hazard_sql
from lossbook.plans.catalog_rows import timing_sql
from lossbook.plans.registry import query
from lossbook.plans.scoring import form_to_row, fill_defaults, score_applications
from lossbook.session import new_path, stage
from lossbook.sources import book as B
from lossbook.streaming.score_stream import read_arrivals, score_stream

# ---- metrics -----------------------------------------------------------------------------------
_RANK = """cnt AS MATERIALIZED (SELECT {by} AS cohort, {score} AS sc, sum(is_bad)::DOUBLE AS b, sum(1-is_bad)::DOUBLE AS g FROM {src} GROUP BY 1,2),
cum AS MATERIALIZED (SELECT *, coalesce(sum(b) OVER w,0) AS b0, coalesce(sum(g) OVER w,0) AS g0, sum(b) OVER v AS nb, sum(g) OVER v AS ng FROM cnt
  WINDOW w AS (PARTITION BY cohort ORDER BY sc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY cohort)),
met AS MATERIALIZED (SELECT cohort, (max(nb)+max(ng))::BIGINT AS n, sum(b*(g0+g/2))/(max(nb)*max(ng)) AS auc, max(abs((b0+b)/nb-(g0+g)/ng)) AS ks,
  sum(b/nb*((nb-b0)/(nb-b0+ng-g0))) AS pr_auc, max(nb)/(max(nb)+max(ng)) AS base_rate FROM cum GROUP BY 1)
"""


def _after(sql: str, more: str) -> str:
    return sql.rsplit("SELECT 1", 1)[0].rstrip() + ",\n" + more


def rank_sql(select: str, score: str = "pd", src: str = "pop", by: str = "0") -> str:
    return _after(O.features("SELECT 1"), _RANK.format(score=score, src=src, by=by) + select)


@query("m1_auc_gini", rank_sql("""SELECT cohort AS year, n, auc AS "AUC", 2*auc-1 AS "Gini" FROM met""", by="year(LoanOriginationDate)::INT"), {"AUC": 9, "Gini": 9})
def _(spark, d):
    s = _scored(spark, d).withColumn("year", F.year("LoanOriginationDate"))
    return ME.ranking_metrics(s, F.col("pd"), F.col(V.TARGET), ["year"]).select("year", "n", "AUC", "Gini")


@query("m2_ks", rank_sql('SELECT ks AS "KS" FROM met'), {"KS": 9})
def _(spark, d):
    return ME.ranking_metrics(_scored(spark, d), F.col("pd"), F.col(V.TARGET)).select("KS")


@query("m3_average_precision", rank_sql('SELECT pr_auc AS "PR_AUC", base_rate AS "BaseRate" FROM met'), {"PR_AUC": 9, "BaseRate": 9})
def _(spark, d):
    return ME.ranking_metrics(_scored(spark, d), F.col("pd"), F.col(V.TARGET)).select("PR_AUC", "BaseRate")


@query("m4_brier_logloss", O.features("""SELECT avg((pd-is_bad)*(pd-is_bad)) AS "Brier",
  avg(-(is_bad*ln(pd)+(1-is_bad)*ln(1-pd))) AS "LogLoss" FROM pop"""), {"Brier": 9, "LogLoss": 9})
def _(spark, d):
    return ME.calibration_metrics(jobs.scored_population(spark, d), F.col("pd"), F.col(V.TARGET))


_PD_DIGITS = {"AUC": 9, "Gini": 9, "KS": 9, "PR_AUC": 9, "BaseRate": 9}


@query("m4_pd_metrics", rank_sql("""SELECT n, auc AS "AUC", 2*auc-1 AS "Gini", ks AS "KS", pr_auc AS "PR_AUC", base_rate AS "BaseRate",
  (SELECT avg((pd-is_bad)*(pd-is_bad)) FROM pop) AS "Brier", (SELECT avg(-(is_bad*ln(pd)+(1-is_bad)*ln(1-pd))) FROM pop) AS "LogLoss" FROM met"""),
       _PD_DIGITS | {"Brier": 9, "LogLoss": 9})
def _(spark, d):
    return ME.pd_metrics(_scored(spark, d), F.col("pd"), F.col(V.TARGET))


_REG = """SELECT '{0}' AS model, count(*) AS n, avg(abs(y-{1})) AS "MAE", sqrt(avg((y-{1})*(y-{1}))) AS "RMSE",
  1-avg((y-{1})*(y-{1}))/nullif(var_pop(y),0) AS "R2" FROM d"""
_REG_DIGITS = {"MAE": 5, "RMSE": 5, "R2": 7}


@query("m5_regression_metrics", _after(O.features("SELECT 1"), "d AS (SELECT ead_label AS y, LoanOriginalAmount*0.5::DOUBLE AS p FROM pop WHERE is_bad=1)\n"
                                       + _REG.format("fixed_ead", "p")), _REG_DIGITS)
def _(spark, d):
    pop = defaulted(jobs.population(spark, d, ["LoanOriginalAmount", "LP_CustomerPrincipalPayments"]))
    return ME.reg_metrics(pop, ead_label(), F.col("LoanOriginalAmount") * (1 - B.FIXED_EAD_SHARE)).select(F.lit("fixed_ead").alias("model"), "*")


@query("m6_champion_benchmark", rank_sql("""SELECT n, auc AS "AUC", 2*auc-1 AS "Gini", ks AS "KS", pr_auc AS "PR_AUC", base_rate AS "BaseRate" FROM met WHERE n>100""",
                                         "-IncumbentScore", "(SELECT * FROM pop WHERE IncumbentScore IS NOT NULL)"), _PD_DIGITS)
def _(spark, d):
    return ME.champion_metrics(jobs.population(spark, d, ["IncumbentScore"]), "IncumbentScore", F.col(V.TARGET))


@query("m7_naive_baselines", _after(O.features("SELECT 1"), """tr AS (SELECT avg(lgd_label) AS m FROM pop WHERE is_bad=1 AND LoanOriginationDate<TIMESTAMP '2000-01-01'),
d1 AS (SELECT ead_label AS y, LoanOriginalAmount AS p FROM pop WHERE is_bad=1 AND LoanOriginationDate>=TIMESTAMP '2000-01-01'),
d2 AS (SELECT lgd_label AS y, (SELECT m FROM tr) AS p FROM pop WHERE is_bad=1 AND lgd_label IS NOT NULL AND LoanOriginationDate>=TIMESTAMP '2000-01-01')
""" + _REG.format("full_exposure", "p").replace("FROM d", "FROM d1") + " UNION ALL " + _REG.format("mean_lgd", "p").replace("FROM d", "FROM d2")), _REG_DIGITS)
def _(spark, d):
    pop = defaulted(jobs.population(spark, d, ["LoanOriginalAmount", "LP_CustomerPrincipalPayments", "LP_NetPrincipalLoss"]))
    pop = stage(pop.select("LoanOriginationDate", "LoanOriginalAmount", ead_label().alias("ead"), lgd_label().alias("lgd")), "defaults")
    cut = F.lit(B.OOT_CUTOFF).cast("timestamp")
    train, test = pop.filter(F.col("LoanOriginationDate") < cut), pop.filter(F.col("LoanOriginationDate") >= cut)
    mean = train.agg(F.avg("lgd")).scalar()
    ead = ME.reg_metrics(test, F.col("ead"), F.col("LoanOriginalAmount")).select(F.lit("full_exposure").alias("model"), "*")
    lgd = ME.reg_metrics(label_known(test, "lgd").withColumn("p", mean), F.col("lgd"), F.col("p")).select(F.lit("mean_lgd").alias("model"), "*")
    return ead.unionByName(lgd)


# ---- survival metrics: loans before the out-of-time cutoff train the censoring curve -------------
_SURV = """lv AS MATERIALIZED (SELECT loan_id, T_obs AS t, is_event AS e, pd AS r, Term, LoanOriginationDate>=TIMESTAMP '2000-01-01' AS test FROM dur WHERE T_obs>=1),
tr AS MATERIALIZED (SELECT * FROM lv WHERE NOT test), te AS MATERIALIZED (SELECT * FROM lv WHERE test),
per AS (SELECT t, count(*)::DOUBLE AS n, count(*) FILTER (WHERE e)::DOUBLE AS d FROM tr GROUP BY 1),
rk AS (SELECT *, sum(n) OVER (ORDER BY t DESC) AS ar FROM per),
km AS MATERIALIZED (SELECT t, product(coalesce(1-(n-d)/nullif(ar-d,0),1)) OVER (ORDER BY t) AS g FROM rk),
gt AS MATERIALIZED (SELECT x.t, coalesce((SELECT max_by(g, km.t) FROM km WHERE km.t<=x.t),1) AS g FROM (SELECT DISTINCT t FROM te) x),
tw AS MATERIALIZED (SELECT te.*, CASE WHEN e AND g>0 THEN 1/g END AS w FROM te JOIN gt USING (t)),
times AS MATERIALIZED (SELECT unnest(range(greatest((SELECT min(t) FROM tr),(SELECT min(t) FROM te))+2,
   least((SELECT max(t) FROM tr),(SELECT max(t) FROM te))-1, 6)) AS g_t),
auc AS MATERIALIZED (SELECT g_t AS t, sum(a.w*CASE WHEN b.r<a.r THEN 1 WHEN b.r=a.r THEN 0.5::DOUBLE ELSE 0 END)/sum(a.w) AS auc
  FROM times JOIN tw a ON a.e AND a.t<=g_t JOIN tw b ON b.t>g_t GROUP BY 1),
sper AS (SELECT t, count(*)::DOUBLE AS n, count(*) FILTER (WHERE e)::DOUBLE AS d FROM te GROUP BY 1),
srk AS (SELECT *, sum(n) OVER (ORDER BY t DESC) AS ar FROM sper),
skm AS MATERIALIZED (SELECT t, product(1-d/ar) OVER (ORDER BY t) AS s FROM srk),
st AS (SELECT x.g_t AS t, coalesce((SELECT max_by(s, skm.t) FROM skm WHERE skm.t<=x.g_t),1) AS s FROM times x),
hzs AS MATERIALIZED (SELECT loan_id, k, 1/(1+exp(-(-5.5::DOUBLE+2.5::DOUBLE*r-3*((k::DOUBLE/Term-0.3::DOUBLE)*(k::DOUBLE/Term-0.3::DOUBLE))))) AS h
  FROM (SELECT loan_id, r, Term, unnest(generate_series(1,Term)) AS k FROM te)),
sx AS MATERIALIZED (SELECT loan_id, g_t, exp(sum(ln(1-h))) AS s FROM hzs JOIN times ON k<=g_t GROUP BY 1,2),
brier AS (SELECT g_t AS t, avg(CASE WHEN e AND t<=g_t THEN s*s*w ELSE 0 END + CASE WHEN t>g_t THEN (1-s)*(1-s)/(
    SELECT coalesce(max_by(g, km.t),1) FROM km WHERE km.t<=g_t) ELSE 0 END) AS brier FROM tw JOIN sx USING (loan_id) GROUP BY 1)
"""


def surv_sql(select: str) -> str:
    return _after(O.panel("SELECT 1"), _SURV + select)


def _survival_sides(spark, d, hazards: bool = False):
    loans = jobs.panel_loans(spark, d, ["DebtToIncomeRatio", "risk_band"])
    loans = loans.withColumn("pd", B.fixed_pd(loans))
    loans = stage(loans.select("loan_id", "LoanOriginationDate", "Term", "T_obs", "is_event", "pd"), "durations")
    cut = F.lit(B.OOT_CUTOFF).cast("timestamp")
    train, test = loans.filter(F.col("LoanOriginationDate") < cut), loans.filter(F.col("LoanOriginationDate") >= cut)
    return train, jobs.hazard_array(test) if hazards else test


@query("m8_ipcw_concordance", surv_sql("""SELECT sum(a.w*a.w*CASE WHEN b.r<a.r THEN 1 WHEN b.r=a.r THEN 0.5::DOUBLE ELSE 0 END)/sum(a.w*a.w) AS concordance_ipcw
  FROM tw a JOIN tw b ON a.e AND (b.t>a.t OR (b.t=a.t AND NOT b.e))"""), {"concordance_ipcw": 9})
def _(spark, d):
    train, test = _survival_sides(spark, d)
    return SU.ipcw_concordance(train, test, "pd")


@query("m9_dynamic_auc", surv_sql("SELECT t, auc FROM auc"), {"auc": 9})
def _(spark, d):
    train, test = _survival_sides(spark, d)
    return SU.dynamic_auc(train, test, "pd", SU.evaluation_times(train, test))


@query("m9_dynamic_auc_mean", surv_sql("""SELECT sum(auc*dd)/sum(dd) AS mean_auc FROM (
  SELECT t, coalesce(lag(s) OVER (ORDER BY t),1)-s AS dd FROM st) JOIN auc USING (t)"""), {"mean_auc": 9})
def _(spark, d):
    train, test = _survival_sides(spark, d)
    auc = SU.dynamic_auc(train, test, "pd", SU.evaluation_times(train, test))
    return SU.mean_dynamic_auc(stage(auc, "auc"), test)


@query("m10_integrated_brier", surv_sql("""SELECT sum(a)/(max(t)-min(t)) AS integrated_brier FROM (SELECT t,
  (t-lag(t) OVER (ORDER BY t))*(brier+lag(brier) OVER (ORDER BY t))/2 AS a FROM brier)"""), {"integrated_brier": 9})
def _(spark, d):
    train, test = _survival_sides(spark, d, hazards=True)
    return SU.integrated_brier(SU.brier_by_time(train, test, "hazards", SU.evaluation_times(train, test)))


@query("m12_macro_lift", grid_sql("""SELECT model, split, a.macro, a.value-b.value AS lift FROM grid_r a JOIN
  (SELECT model, split, value FROM grid_r WHERE macro='base') b USING (model, split) WHERE a.macro<>'base'"""), {"lift": 9})
def _(spark, d):
    return RE.lift_over(_grid_results(spark, d), "base")


# ---- term structure ------------------------------------------------------------------------------
@query("n1_hazard_curve", hazard_sql("SELECT loan_id, t, h FROM hz"), {"h": 9})
def _(spark, d):
    return jobs.hazard_rows(spark, d).select("loan_id", "t", C.clip_hazard(F.col("h")).alias("h"))


def _curves(spark, d):
    return jobs.hazard_array(jobs.scored_population(spark, d).select("loan_id", "Term", "pd"))


@query("n2_survival_curve", hazard_sql("SELECT loan_id, t, s AS survival FROM sv"), {"survival": 9})
def _(spark, d):
    curve = C.survival_curve(F.col("hazards"))
    return _curves(spark, d).select("loan_id", F.posexplode(curve).alias("t", "survival")).withColumn("t", F.col("t") + 1)


@query("n3_marginal_pd", hazard_sql("SELECT loan_id, t, m AS marginal_pd FROM mg"), {"marginal_pd": 9})
def _(spark, d):
    curve = C.marginal_curve(F.col("hazards"))
    return _curves(spark, d).select("loan_id", F.posexplode(curve).alias("t", "marginal_pd")).withColumn("t", F.col("t") + 1)


@query("n4_lifetime_pd", hazard_sql("SELECT loan_id, 1-exp(sum(ln(1-h))) AS lifetime_pd FROM hz GROUP BY 1"), {"lifetime_pd": 9})
def _(spark, d):
    return _curves(spark, d).select("loan_id", C.lifetime_pd(F.col("hazards")).alias("lifetime_pd"))


_FALLBACK = "fb AS MATERIALIZED (SELECT bin::INT AS bin, exp(-pow((bin+0.5::DOUBLE)/20-0.30::DOUBLE,2)/(2*pow(0.18::DOUBLE,2))) AS raw FROM range(20) r(bin))"


@query("n5_timing_weights", timing_sql("""SELECT Term, t, sum(w) AS weight FROM (SELECT Term, t, density/sum(density) OVER (PARTITION BY Term) AS w FROM
  (SELECT Term, unnest(generate_series(1,Term)) AS t FROM (SELECT DISTINCT Term FROM pop)) JOIN timing ON bin=least(((2*t-1)*20)//(2*Term),19)) GROUP BY 1,2"""), {"weight": 9})
def _(spark, d):
    curve = stage(jobs.default_timing(spark, d), "timing")
    density = curve.agg(F.array_sort(F.collect_list(F.struct("bin", "density")))["density"].alias("d"))
    terms = jobs.population(spark, d, ["Term"]).select("Term").distinct().withColumn("d", density.scalar())
    weights = C.timing_weights(F.col("Term"), F.col("d"), V.TIMING_BINS)
    return terms.select("Term", F.posexplode(weights).alias("t", "weight")).withColumn("t", F.col("t") + 1)


@query("n6_fallback_timing", _after(O.features("SELECT 1"), _FALLBACK + """
SELECT loan_id, t, pd*raw/sum(raw) OVER (PARTITION BY loan_id) AS marginal_pd FROM (SELECT loan_id, Term, pd, unnest(generate_series(1,Term)) AS t FROM pop)
JOIN fb ON bin=least(((2*t-1)*20)//(2*Term),19)"""), {"marginal_pd": 9})
def _(spark, d):
    loans = jobs.scored_population(spark, d)
    weights = C.timing_weights(F.col("Term"), C.density_literal(C.fallback_timing()), V.TIMING_BINS)
    rows = loans.select("loan_id", "pd", F.posexplode(weights).alias("t", "w"))
    return rows.select("loan_id", (F.col("t") + 1).alias("t"), (F.col("pd") * F.col("w")).alias("marginal_pd"))


# balance at the start of month t; c is the monthly rate
_BAL = "CASE WHEN c<=1e-9 THEN amount*(Term-t+1)/Term ELSE amount*(pow(1+c,Term)-pow(1+c,t-1))/(pow(1+c,Term)-1) END"
_PAY = "CASE WHEN c<=1e-9 THEN amount/Term ELSE amount*c/(1-pow(1+c,-Term)) END"
_ECON = """offer AS MATERIALIZED (SELECT loan_id, Term, pd, LoanOriginalAmount AS amount, (loan_id%25)*0.010371::DOUBLE/12 AS c FROM pop),
mon AS MATERIALIZED (SELECT *, {bal} AS bal, {pay} AS pay FROM (SELECT *, unnest(generate_series(1,Term)) AS t FROM offer)),
{fb},
mw AS MATERIALIZED (SELECT *, pd*raw/sum(raw) OVER (PARTITION BY loan_id) AS m FROM mon JOIN fb ON bin=least(((2*t-1)*20)//(2*Term),19)),
al AS MATERIALIZED (SELECT *, 1-coalesce(sum(m) OVER (PARTITION BY loan_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS s FROM mw),
eco AS MATERIALIZED (SELECT loan_id, max(Term) AS Term, max(amount) AS amount, max(pay) AS monthly_payment, sum(m*0.725::DOUBLE*bal/pow(1+c,t)) AS lifetime_ecl, sum(s*bal*c/pow(1+c,t)) AS interest_income_pv,
  sum(s*bal*(0.04::DOUBLE/12)/pow(1+c,t)) AS funding_cost_pv, sum(s*bal*(0.01::DOUBLE/12)/pow(1+c,t)) AS servicing_cost_pv FROM al GROUP BY 1)
""".format(bal=_BAL, pay=_PAY, fb=_FALLBACK)


def econ_sql(select: str) -> str:
    return _after(O.features("SELECT 1"), _ECON + select)


def _offers(spark, d):
    loans = jobs.scored_population(spark, d).select("loan_id", "Term", "pd", "lgd", "ead", F.col("LoanOriginalAmount").alias("amount"),
                                                    ((F.col("loan_id") % 25) * 0.010371).alias("apr"))
    weights = C.timing_weights(F.col("Term"), C.density_literal(C.fallback_timing()), V.TIMING_BINS)
    return loans.withColumn("marginal", C.spread(F.col("pd"), weights))


@query("n7_amortization", econ_sql("""SELECT loan_id, t, bal AS balance_start, bal*c AS interest, least(pay-bal*c, bal) AS principal, pay AS payment FROM mon"""),
       {"balance_start": 5, "interest": 5, "principal": 5, "payment": 5})
def _(spark, d):
    return PX.amortization(_offers(spark, d).drop("marginal"), "amount", "apr").select(
        "loan_id", "t", "balance_start", "interest", "principal", "payment")


def _projected(spark, d):
    o = _offers(spark, d)
    return PX.project(o, F.col("amount"), F.col("apr"), F.col("Term"), F.col("marginal"), F.col("lgd"))


@query("n8_lifetime_ecl", econ_sql("SELECT loan_id, lifetime_ecl FROM eco"), {"lifetime_ecl": 5})
def _(spark, d):
    return _projected(spark, d).select("loan_id", "lifetime_ecl")


@query("n9_income_and_cost_pv", econ_sql("SELECT loan_id, interest_income_pv, funding_cost_pv, servicing_cost_pv FROM eco"),
       {"interest_income_pv": 5, "funding_cost_pv": 5, "servicing_cost_pv": 5})
def _(spark, d):
    return _projected(spark, d).select("loan_id", "interest_income_pv", "funding_cost_pv", "servicing_cost_pv")


@query("n10_profit_raroc", econ_sql("""SELECT loan_id, monthly_payment, interest_income_pv-lifetime_ecl-funding_cost_pv-servicing_cost_pv AS expected_profit,
  0.08::DOUBLE*amount AS capital, (interest_income_pv-lifetime_ecl-funding_cost_pv-servicing_cost_pv)/(0.08::DOUBLE*amount)/(Term/12.0::DOUBLE) AS raroc FROM eco"""),
       {"monthly_payment": 5, "expected_profit": 5, "capital": 5, "raroc": 8})
def _(spark, d):
    return _projected(spark, d).select("loan_id", "monthly_payment", "expected_profit", "capital", "raroc")


@query("n11_term_conform", hazard_sql("""SELECT loan_id, k AS t, coalesce(m,0) AS marginal_pd FROM (SELECT loan_id, unnest(generate_series(1,36)) AS k FROM pop)
  LEFT JOIN mg USING (loan_id) WHERE false UNION ALL SELECT q.loan_id, q.k, coalesce(mg.m,0) FROM
  (SELECT loan_id, unnest(generate_series(1,36)) AS k FROM pop) q LEFT JOIN mg ON mg.loan_id=q.loan_id AND mg.t=q.k"""), {"marginal_pd": 9})
def _(spark, d):
    curve = C.conform(C.marginal_curve(F.col("hazards")), F.lit(36))
    return _curves(spark, d).select("loan_id", F.posexplode(curve).alias("t", "marginal_pd")).withColumn("t", F.col("t") + 1)


_SOLVE = """cv AS MATERIALIZED (SELECT loan_id, {n}::INT AS n, list(m ORDER BY t) AS m, list(s ORDER BY t) AS s, sum(m) AS ms, sum(s) AS ss FROM {src} GROUP BY loan_id, {n}),
sol AS (SELECT loan_id, goal, 0.0::DOUBLE AS lo, 0.6::DOUBLE AS hi, 0 AS r FROM cv CROSS JOIN (VALUES (0),(1)) g(goal)
  UNION ALL SELECT loan_id, goal, CASE WHEN p<want THEN mid ELSE lo END, CASE WHEN p<want THEN hi ELSE mid END, r+1 FROM (
    SELECT *, CASE WHEN c<=1e-9 THEN -1e300 ELSE ((c-0.05::DOUBLE/12)*(list_reduce(s, lambda a, x: a*(1+c)+x)-ss/(1+c))
      -0.725::DOUBLE*(list_reduce(m, lambda a, x: a*(1+c)+x)-ms/(1+c)))/(pow(1+c,n)-1) END AS p, goal*0.15::DOUBLE*0.08::DOUBLE*n/12 AS want FROM (
      SELECT sol.*, (lo+hi)/2 AS mid, (lo+hi)/24 AS c, cv.n, cv.m, cv.s, cv.ms, cv.ss FROM sol JOIN cv USING (loan_id) WHERE r<42))),
apr AS MATERIALIZED (SELECT loan_id, max((lo+hi)/2) FILTER (WHERE goal=0) AS breakeven_apr, max((lo+hi)/2) FILTER (WHERE goal=1) AS target_raroc_apr
  FROM sol WHERE r=42 GROUP BY 1)
"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def solve_sql(select: str) -> str:
    return _recursive(econ_sql("SELECT 1").rsplit("SELECT 1", 1)[0].rstrip() + ",\n" + _SOLVE.format(n="Term", src="al") + select)


_APR = {"breakeven_apr": 8, "target_raroc_apr": 8}


@query("n12_break_even_target_apr", solve_sql("SELECT loan_id, breakeven_apr, target_raroc_apr FROM apr"), _APR)
def _(spark, d):
    o = _offers(spark, d).select("loan_id", "Term", "marginal", "lgd")
    return PX.price(o, F.col("Term"), F.col("marginal"), F.col("lgd")).select("loan_id", "breakeven_apr", "target_raroc_apr")


@query("n13_expected_loss", O.features("SELECT loan_id, pd*0.725::DOUBLE*LoanOriginalAmount*0.5::DOUBLE AS el FROM pop"), {"el": 6})
def _(spark, d):
    return jobs.scored_population(spark, d).select("loan_id", PX.expected_loss(F.col("pd"), F.col("lgd"), F.col("ead")).alias("el"))


@query("n14_level_shape_blend", hazard_sql("""SELECT mg.loan_id, t, pop.pd*m/sum(m) OVER (PARTITION BY mg.loan_id) AS blended FROM mg JOIN pop USING (loan_id)"""), {"blended": 9})
def _(spark, d):
    curve = C.level_on_shape(F.col("pd"), C.marginal_curve(F.col("hazards")))
    return _curves(spark, d).select("loan_id", F.posexplode(curve).alias("t", "blended")).withColumn("t", F.col("t") + 1)


_LOSS_RATE = "pd*0.725::DOUBLE*0.5::DOUBLE"
_DECISION = f"CASE WHEN pd<0.15::DOUBLE AND {_LOSS_RATE}<0.05::DOUBLE THEN 'approve' WHEN pd<0.35::DOUBLE THEN 'refer' ELSE 'decline' END"


@query("n15_credit_decision", O.features(f"SELECT loan_id, {_DECISION} AS decision FROM pop"))
def _(spark, d):
    s = jobs.scored_population(spark, d)
    rate = PX.expected_loss(F.col("pd"), F.col("lgd"), F.col("ead")) / F.col("LoanOriginalAmount")
    return s.select("loan_id", PX.decision(F.col("pd"), rate).alias("decision"))


_VERDICT = "CASE WHEN {0}>=target_raroc_apr THEN 'profitable' WHEN {0}>=breakeven_apr THEN 'covers cost' ELSE 'unprofitable' END"


@query("n16_price_verdict", solve_sql(f"SELECT loan_id, {_VERDICT.format('(loan_id%25)*0.010371::DOUBLE')} AS verdict FROM apr"))
def _(spark, d):
    o = PX.price(_offers(spark, d), F.col("Term"), F.col("marginal"), F.col("lgd"))
    return o.select("loan_id", PX.verdict(F.col("apr"), F.col("breakeven_apr"), F.col("target_raroc_apr")).alias("verdict"))


_TIERS = {1: "Low risk", 5: "Median risk", 9: "High risk"}


@query("n17_cumulative_default_by_tier", _after(O.features("SELECT 1"), """pick AS (SELECT tenth, pd FROM (
  SELECT pd, row_number() OVER (ORDER BY pd, loan_id)-1 AS r, count(*) OVER () AS n FROM pop WHERE DebtToIncomeRatio IS NOT NULL)
  JOIN (VALUES (1),(5),(9)) q(tenth) ON r=(tenth*(n-1))//10),
hz AS (SELECT tenth, t, 1/(1+exp(-(-5.5::DOUBLE+2.5::DOUBLE*pd-3*((t/36.0::DOUBLE-0.3::DOUBLE)*(t/36.0::DOUBLE-0.3::DOUBLE))))) AS h
  FROM (SELECT *, unnest(generate_series(1,36)) AS t FROM pick))
SELECT CASE tenth WHEN 1 THEN 'Low risk' WHEN 5 THEN 'Median risk' ELSE 'High risk' END AS tier, t,
  1-exp(sum(ln(1-h)) OVER (PARTITION BY tenth ORDER BY t)) AS cumulative_pd FROM hz"""), {"cumulative_pd": 9})
def _(spark, d):
    scored = jobs.scored_population(spark, d).select("loan_id", "pd", "DebtToIncomeRatio")
    clean = stage(complete_cases(scored, ["DebtToIncomeRatio"]), "scored")
    picks = RE.nearest_rank_picks(clean, "pd", "loan_id", list(_TIERS)).withColumn("Term", F.lit(36))
    pairs = [F.lit(x) for kv in _TIERS.items() for x in kv]
    curves = jobs.hazard_array(picks).withColumn("tier", F.element_at(F.create_map(*pairs), F.col("tenth").cast("int")))
    return (curves.select("tier", F.posexplode(C.survival_curve(F.col("hazards"))).alias("t", "s"))
            .select("tier", (F.col("t") + 1).alias("t"), (1 - F.col("s")).alias("cumulative_pd")))


# ---- applications ----------------------------------------------------------------------------------
_NUMBERS = ["LoanOriginalAmount", "StatedMonthlyIncome", "DebtToIncomeRatio", "BankcardUtilization", "RevolvingCreditBalance",
            "AvailableBankcardCredit", "OpenCreditLines", "CurrentCreditLines", "TotalInquiries", "AmountDelinquent", "EmploymentStatusDuration",
            "loan_to_income", "stated_income_log", "PriorPaymentsBilled", "PriorPrincipalBorrowed", "PriorPrincipalOutstanding"]
_TEXT = ["IncomeRange", "EmploymentStatus", "BorrowerState", "IncomeVerifiable", "bankcard_util_bucket"]
_FORM = """form AS MATERIALIZED (SELECT loan_id, (loan_id%25)*0.010371::DOUBLE AS offered_apr, LoanOriginalAmount, Term, StatedMonthlyIncome, IncomeRange,
  EmploymentStatus, EmploymentStatusDuration, DebtToIncomeRatio, BankcardUtilization, RevolvingCreditBalance, AvailableBankcardCredit, OpenCreditLines,
  CurrentDelinquencies, DelinquenciesLast7Years, InquiriesLast6Months, AmountDelinquent, (loan_id%4)::DOUBLE AS PriorLoans,
  CreditScoreRangeLower, CreditScoreRangeLower+19 AS CreditScoreRangeUpper, (1+loan_id%25)*12.0::DOUBLE AS credit_history_months,
  CASE WHEN StatedMonthlyIncome IS NOT NULL THEN LoanOriginalAmount/greatest(StatedMonthlyIncome*12,1) END AS loan_to_income,
  CASE WHEN DebtToIncomeRatio IS NOT NULL THEN (DebtToIncomeRatio>=10.01::DOUBLE)::INT END AS dti_capped_flag,
  CASE WHEN IncomeVerifiable IS NOT NULL THEN (NOT IncomeVerifiable)::INT END AS income_unverified,
  (loan_id%4>0)::INT AS is_repeat_borrower, CASE WHEN BankcardUtilization IS NOT NULL THEN bankcard_util_bucket END AS bankcard_util_bucket FROM feat)"""
_L9 = ["CreditScoreRangeLower", "CreditScoreRangeUpper", "credit_history_months", "loan_to_income", "dti_capped_flag",
       "income_unverified", "is_repeat_borrower", "bankcard_util_bucket"]


@query("l9_form_mapping", _after(O.features("SELECT 1"), _FORM + f"\nSELECT loan_id, {', '.join(_L9)} FROM form"), {"loan_to_income": 7})
def _(spark, d):
    return form_to_row(B.applications(spark, d)).select("loan_id", *_L9)


def _defaults(spark, d):
    return PR.feature_defaults(stage(jobs.feature_table(spark, d).select(*_NUMBERS, *_TEXT), "features"), _NUMBERS, _TEXT)


def _mode_sql(c: str) -> str:
    return f"(SELECT {c}::VARCHAR FROM pop WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


_FILL = ["StatedMonthlyIncome", "DebtToIncomeRatio", "BankcardUtilization", "RevolvingCreditBalance", "AmountDelinquent", "EmploymentStatusDuration"]


@query("l10_default_fill", _after(O.features("SELECT 1"), _FORM + "\nSELECT loan_id, " + ", ".join(
    f"coalesce({c}, (SELECT median({c}) FROM pop)) AS {c}" for c in _FILL) + f""", coalesce(IncomeRange, {_mode_sql('IncomeRange')}) AS IncomeRange,
  {_mode_sql('BorrowerState')} AS BorrowerState, (SELECT median(CurrentCreditLines) FROM pop) AS CurrentCreditLines FROM form"""), {c: 6 for c in _FILL})
def _(spark, d):
    rows = fill_defaults(form_to_row(B.applications(spark, d)), _defaults(spark, d), _NUMBERS, _TEXT)
    return rows.select("loan_id", *_FILL, "IncomeRange", "BorrowerState", "CurrentCreditLines")


def _stand_in(rows):
    return (rows.withColumn("pd", B.application_pd()).withColumn("lgd", F.lit(B.FIXED_LGD))
            .withColumn("ead", F.col("LoanOriginalAmount") * (1 - B.FIXED_EAD_SHARE)))


_SCORED = ["pd", "el", "decision", "DisposableIncome", "macro_unemployment_ttc", "monthly_payment", "lifetime_ecl", "expected_profit", "raroc",
           "breakeven_apr", "target_raroc_apr", "price_verdict"]
_N18 = _FORM + f""",
filled AS MATERIALIZED (SELECT loan_id, offered_apr, Term, LoanOriginalAmount AS amount, offered_apr/12 AS c,
  coalesce(StatedMonthlyIncome, (SELECT median(StatedMonthlyIncome) FROM pop)) AS inc, coalesce(DebtToIncomeRatio, (SELECT median(DebtToIncomeRatio) FROM pop)) AS dti,
  floor((CreditScoreRangeLower-520)/40) AS band FROM form),
sc AS MATERIALIZED (SELECT *, 1/(1+exp(-(-0.7::DOUBLE-0.5::DOUBLE*(band-1)+2*least(dti,1)))) AS pd FROM filled),
now AS (SELECT macro_unemployment_ttc FROM macro WHERE macro_unemployment_ttc IS NOT NULL ORDER BY ym DESC LIMIT 1),
mon AS MATERIALIZED (SELECT *, {_BAL} AS bal, {_PAY} AS pay, 1/(1+exp(-(-5.5::DOUBLE+2.5::DOUBLE*pd-3*((t::DOUBLE/Term-0.3::DOUBLE)*(t::DOUBLE/Term-0.3::DOUBLE))))) AS h
  FROM (SELECT *, unnest(generate_series(1,Term)) AS t FROM sc)),
sv AS (SELECT *, exp(sum(ln(1-h)) OVER (PARTITION BY loan_id ORDER BY t)) AS s0 FROM mon),
sh AS (SELECT *, coalesce(lag(s0) OVER (PARTITION BY loan_id ORDER BY t),1)*h AS m0 FROM sv),
mw AS MATERIALIZED (SELECT * EXCLUDE (m0), pd*m0/sum(m0) OVER (PARTITION BY loan_id) AS m FROM sh),
al AS MATERIALIZED (SELECT *, 1-coalesce(sum(m) OVER (PARTITION BY loan_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS s FROM mw),
eco AS MATERIALIZED (SELECT loan_id, max(pay) AS monthly_payment, sum(m*0.725::DOUBLE*bal/pow(1+c,t)) AS lifetime_ecl,
  sum(s*bal*(c-0.05::DOUBLE/12)/pow(1+c,t)) AS net_income FROM al GROUP BY 1),
{_SOLVE.format(n='Term', src='al')}
SELECT loan_id, pd, pd*0.725::DOUBLE*amount*0.5::DOUBLE AS el, {_DECISION} AS decision, inc-dti*inc AS DisposableIncome,
  (SELECT macro_unemployment_ttc FROM now) AS macro_unemployment_ttc, monthly_payment, lifetime_ecl, net_income-lifetime_ecl AS expected_profit,
  (net_income-lifetime_ecl)/(0.08::DOUBLE*amount)/(Term/12.0::DOUBLE) AS raroc, breakeven_apr, target_raroc_apr, {_VERDICT.format('offered_apr')} AS price_verdict
FROM sc JOIN eco USING (loan_id) JOIN apr USING (loan_id)"""
_N18_SQL = _recursive(O.overlay("SELECT 1").rsplit("SELECT 1", 1)[0].rstrip() + ",\n" + _N18)
_N18_DIGITS = {"pd": 9, "el": 5, "DisposableIncome": 5, "macro_unemployment_ttc": 8, "monthly_payment": 5, "lifetime_ecl": 4,
               "expected_profit": 4, "raroc": 7} | _APR


def _scoring(spark, d):
    """The batch job with everything it looks up already staged."""
    defaults, macro = _defaults(spark, d), jobs.macro_table(spark, d)

    def score(forms):
        out = score_applications(forms, defaults, macro, _stand_in, jobs.hazard_array, numbers=_NUMBERS, texts=_TEXT,
                                 keep=["DisposableIncome", "macro_unemployment_ttc"])
        return out.select("loan_id", *_SCORED)
    return score


@query("n18_score_book", _N18_SQL, _N18_DIGITS)
def _(spark, d):
    return _scoring(spark, d)(B.applications(spark, d))


@query("n19_economic_context", O.macro(f"""SELECT ym, {', '.join(V.MACRO_TTC)} FROM macro WHERE {' AND '.join(c + ' IS NOT NULL' for c in V.MACRO_TTC)}
  ORDER BY ym DESC LIMIT 1"""), {c: 8 for c in V.MACRO_TTC})
def _(spark, d):
    return OV.latest_row(jobs.macro_table(spark, d), V.MACRO_TTC)


@query("r1_score_stream", _N18_SQL, _N18_DIGITS)
def _(spark, d):
    score = _scoring(spark, d)
    schema = B.table(spark, d, "orders").schema
    arrivals = B.applications(spark, d, read_arrivals(spark, f"{d}/orders*.parquet", schema))
    out, mark = new_path(spark, "scored"), new_path(spark, "stream-progress")
    score_stream(arrivals, score, out, mark).awaitTermination()
    return spark.read.parquet(out).drop("batch")


def _bundle(spark, d):
    """The bundle fitted on the training side of the random split, saved and loaded again."""
    book = SP.stratified_split(stage(jobs.prepared(spark, d), "prepared"))
    train = book.filter("split = 'train'").drop("split")
    loans = LB.categoricals_as_text(FE.all_features(jobs.panel_loans(spark, d, [c for c in B.loan_columns() if c not in jobs.PANEL_COLUMNS])))
    names = list(dict.fromkeys(["loan_id", "LoanOriginationDate", "T_obs", "is_event", *V.MODEL_FEATURES, *V.ENGINEERED_NUMERIC]))
    months = PA.loan_months(stage(SP.out_of_time(loans.select(*names), B.OOT_CUTOFF).filter("split = 'train'").drop("split"), "panel-loans"))
    path = new_path(spark, "bundle")
    fit_bundle(train, months, jobs.macro_table(spark, d)).save(path)
    return ScoringBundle.load(spark, path)


@query("n18_fitted_book")
def _(spark, d):
    """All applications scored by the fitted bundle."""
    return _bundle(spark, d).score(B.applications(spark, d))


@query("r1_fitted_stream")
def _(spark, d):
    """All applications scored in three micro-batches by the same bundle, each row beside the batch job's."""
    bundle = _bundle(spark, d)
    forms = B.applications(spark, d)
    arriving = new_path(spark, "arriving")
    part = F.pmod(F.xxhash64("loan_id"), F.lit(3).cast("long"))
    for k in range(3):
        forms.filter(part == k).coalesce(1).write.mode("append").parquet(arriving)
    out, mark = new_path(spark, "scored"), new_path(spark, "stream-progress")
    score_stream(read_arrivals(spark, arriving, forms.schema, 1), bundle.score, out, mark).awaitTermination()
    stream = spark.read.parquet(out).select("batch", F.struct(*SCORED).alias("streamed"))
    whole = stage(bundle.score(spark.read.schema(forms.schema).parquet(arriving)).select(F.struct(*SCORED).alias("whole")), "whole")
    both = stream.join(whole, F.col("streamed.loan_id") == F.col("whole.loan_id"), "full")
    return both.select("batch", "streamed.*", (F.col("streamed") == F.col("whole")).alias("same_as_batch"))
