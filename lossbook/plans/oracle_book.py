"""Checking SQL for the loan book and the tables derived from it, as chained CTEs."""

from __future__ import annotations

_BOOK = """
ln AS (
  SELECT l_orderkey, count(*) AS lines,
    sum(round(l_discount*100)::BIGINT)::DOUBLE AS dc, sum(round(l_tax*100)::BIGINT)::DOUBLE AS tc,
    sum(round(l_extendedprice*100)::BIGINT)::DOUBLE AS pc,
    count(*) FILTER (WHERE l_linestatus='O') AS n_o, count(*) FILTER (WHERE l_returnflag='R') AS n_r,
    count(*) FILTER (WHERE l_returnflag IN ('R','A')) AS n_ra,
    count(*) FILTER (WHERE l_returnflag='A' AND l_linestatus='F') AS n_af,
    count(*) FILTER (WHERE l_returnflag='A') AS n_a
  FROM lineitem GROUP BY 1),
base AS MATERIALIZED (
  SELECT o.o_orderkey AS k, o.o_custkey AS c, o.o_orderdate AS od, o.o_orderstatus AS os,
    o.o_totalprice/10.0::DOUBLE AS amount, CAST(substr(o.o_orderpriority,1,1) AS INTEGER) AS p,
    CASE o.o_orderkey % 3 WHEN 0 THEN 12 WHEN 1 THEN 36 ELSE 60 END AS term,
    cu.c_acctbal AS bal, cu.c_mktsegment AS seg, n.n_name AS nname, ln.*,
    (count(*) OVER w)::BIGINT AS pn,
    coalesce(sum(round(o.o_totalprice*100)::BIGINT) OVER w, 0)::DOUBLE AS pcents
  FROM orders o LEFT JOIN customer cu ON cu.c_custkey=o.o_custkey
  LEFT JOIN nation n ON n.n_nationkey=cu.c_nationkey LEFT JOIN ln ON ln.l_orderkey=o.o_orderkey
  WINDOW w AS (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
book1 AS (
  SELECT *, 1 + (k*7) % term AS life_m, date_diff('day', od::DATE, DATE '2001-11-30') AS age_days,
    (os='F' AND p<=3) AS bad, os='O' AS opn FROM base),
book2 AS (
  SELECT *, CASE WHEN opn THEN 0.0::DOUBLE WHEN bad THEN amount*least(life_m,term)/term ELSE amount END AS paid,
    CASE WHEN bal<=0 THEN 0 WHEN bal*12<25000 THEN 1 WHEN bal*12<50000 THEN 2 WHEN bal*12<75000 THEN 3
         WHEN bal*12<100000 THEN 4 ELSE 5 END AS band0 FROM book1),
book AS (
  SELECT k AS loan_id, od AS LoanOriginationDate, amount AS LoanOriginalAmount, term AS Term,
    CASE WHEN opn AND k%10=0 THEN 'Past Due (1-15 days)' WHEN opn AND k%10=5 THEN 'Cancelled'
         WHEN opn AND k%10=7 THEN 'FinalPaymentInProgress' WHEN opn THEN 'Current'
         WHEN bad AND k%2=0 THEN 'Chargedoff' WHEN bad THEN 'Defaulted' ELSE 'Completed' END AS LoanStatus,
    CASE WHEN NOT opn THEN od + to_days(least(30*life_m, age_days)::INTEGER) END AS ClosedDate,
    floor(age_days/30.44::DOUBLE)::BIGINT AS LoanMonthsSinceOrigination,
    (520+40*p+c%20)::DOUBLE AS CreditScoreRangeLower,
    CASE WHEN k%53<>0 THEN (520+40*p+c%20+19)::DOUBLE END AS CreditScoreRangeUpper,
    od - to_days(10) AS DateCreditPulled,
    CASE WHEN c%31<>0 THEN od - to_days((365*(1+c%25))::INTEGER) END AS FirstRecordedCreditLine,
    CASE WHEN c%29=0 THEN NULL WHEN bal<0 THEN 0.0::DOUBLE ELSE bal END AS StatedMonthlyIncome,
    CASE WHEN c%37<>0 THEN
      ['Not employed','$1-24,999','$25,000-49,999','$50,000-74,999','$75,000-99,999','$100,000+']
      [1 + CASE WHEN k%11=0 THEN least(band0+1,5) ELSE band0 END] END AS IncomeRange,
    CASE WHEN c%41<>0 THEN c%5<>0 END AS IncomeVerifiable,
    CASE WHEN lines IS NULL THEN NULL WHEN k%97=0 THEN 10.01::DOUBLE
         ELSE dc/(100.0::DOUBLE*lines)*4 + (5-p)*0.05::DOUBLE END AS DebtToIncomeRatio,
    tc/(100.0::DOUBLE*lines)*16 AS BankcardUtilization,
    CASE WHEN c%13=0 THEN 0.0::DOUBLE ELSE pc/1000.0::DOUBLE END AS RevolvingCreditBalance,
    CASE WHEN c%13=0 THEN 0.0::DOUBLE ELSE abs(bal) END AS AvailableBankcardCredit,
    (CASE WHEN k%101=0 THEN 0 ELSE coalesce(lines,0) END)::DOUBLE AS CurrentCreditLines,
    coalesce(n_o,0)::DOUBLE AS OpenCreditLines, coalesce(n_r,0)::DOUBLE AS InquiriesLast6Months,
    coalesce(n_ra,0)::DOUBLE AS TotalInquiries, coalesce(n_af,0)::DOUBLE AS CurrentDelinquencies,
    coalesce(n_a,0)::DOUBLE AS DelinquenciesLast7Years,
    CASE WHEN pn>0 THEN pn::DOUBLE END AS PriorLoans,
    CASE WHEN pn>0 THEN pcents/1000.0::DOUBLE END AS PriorPrincipalBorrowed,
    CASE WHEN pn>0 THEN pcents/1000.0::DOUBLE*((k%10)/10.0::DOUBLE) END AS PriorPrincipalOutstanding,
    CASE WHEN pn>0 THEN (CASE WHEN k%89=0 THEN 0 ELSE 12*pn END)::DOUBLE END AS PriorPaymentsBilled,
    CASE WHEN pn>0 THEN greatest(CASE WHEN k%89=0 THEN 0 ELSE 12*pn END - k%5, 0)::DOUBLE END AS PriorPaymentsOnTime,
    CASE WHEN pn>0 THEN (k%3)::DOUBLE END AS PriorPaymentsLateUnderMonth,
    CASE WHEN pn>0 THEN (k%2)::DOUBLE END AS PriorPaymentsLateOverMonth,
    CASE WHEN pn>0 THEN (k%41-20)::DOUBLE END AS ScoreChange,
    CASE WHEN c%20<>0 THEN nname END AS BorrowerState, seg AS Occupation,
    ['Employed','Full-time','Part-time','Self-employed','Retired'][p] AS EmploymentStatus,
    k%21 AS ListingCategory,
    CASE WHEN k%47<>0 THEN ((k*3)%17+5)::DOUBLE END AS TotalCreditLinespast7years,
    CASE WHEN k%59<>0 THEN ((k*5)%31+1)::DOUBLE END AS TotalTrades,
    ((k*7)%21)/20.0::DOUBLE AS TradesNeverDelinquent, ((k*11)%4)::DOUBLE AS TradesOpenedLast6Months,
    ((k*13)%12)::DOUBLE AS OpenRevolvingAccounts, ((k*17)%800)::DOUBLE AS OpenRevolvingMonthlyPayment,
    CASE WHEN k%61<>0 THEN CASE WHEN (k*19)%10<8 THEN 0.0::DOUBLE ELSE ((k*23)%5000)::DOUBLE END END AS AmountDelinquent,
    ((k*29)%3)::DOUBLE AS PublicRecordsLast10Years, ((k*31)%2)::DOUBLE AS PublicRecordsLast12Months,
    CASE WHEN k%67<>0 THEN ((k*37)%240)::DOUBLE END AS EmploymentStatusDuration,
    c%2=0 AS IsBorrowerHomeowner, c%7=0 AS CurrentlyInGroup,
    paid AS LP_CustomerPrincipalPayments,
    CASE WHEN bad THEN (amount-paid)*(0.5::DOUBLE+0.05::DOUBLE*(k%10)) ELSE 0.0::DOUBLE END AS LP_NetPrincipalLoss,
    CASE WHEN bad THEN amount-paid ELSE 0.0::DOUBLE END AS LP_GrossPrincipalLoss,
    CASE WHEN bad THEN (amount-paid)*0.05::DOUBLE ELSE 0.0::DOUBLE END AS LP_NonPrincipalRecoverypayments,
    CASE WHEN k%43<>0 THEN 2*p-k%2 END AS IncumbentScore, p AS IncumbentRating, p AS risk_band, life_m AS life
  FROM book2)"""

# Derived and engineered columns (P1-P22), labels and the population, on top of `book`.
_FEAT = """
f1 AS (
  SELECT * EXCLUDE (PriorPaymentsBilled, PriorPaymentsOnTime, PriorPaymentsLateUnderMonth,
                    PriorPaymentsLateOverMonth, PriorPrincipalBorrowed, PriorPrincipalOutstanding, ScoreChange),
    PriorLoans AS raw_prior, coalesce(PriorPaymentsBilled,0) AS PriorPaymentsBilled,
    coalesce(PriorPaymentsOnTime,0) AS PriorPaymentsOnTime,
    coalesce(PriorPaymentsLateUnderMonth,0) AS PriorPaymentsLateUnderMonth,
    coalesce(PriorPaymentsLateOverMonth,0) AS PriorPaymentsLateOverMonth,
    coalesce(PriorPrincipalBorrowed,0) AS PriorPrincipalBorrowed,
    coalesce(PriorPrincipalOutstanding,0) AS PriorPrincipalOutstanding, coalesce(ScoreChange,0) AS ScoreChange,
    (coalesce(CreditScoreRangeLower,CreditScoreRangeUpper)+coalesce(CreditScoreRangeUpper,CreditScoreRangeLower))/2 AS credit_score_mid,
    floor(epoch_us(DateCreditPulled - FirstRecordedCreditLine)/86400000000)/30.44::DOUBLE AS credit_history_months,
    LoanOriginalAmount/nullif(StatedMonthlyIncome*12,0) AS loan_to_income,
    ln(1+CASE WHEN StatedMonthlyIncome IS NULL THEN NULL ELSE greatest(StatedMonthlyIncome,0) END) AS stated_income_log,
    (PriorLoans IS NOT NULL)::INT AS is_repeat_borrower, coalesce(NOT IncomeVerifiable, true)::INT AS income_unverified,
    coalesce(DebtToIncomeRatio>=10.01::DOUBLE,false)::INT AS dti_capped_flag,
    CASE WHEN BankcardUtilization IS NULL THEN 'Missing' WHEN BankcardUtilization<=0.30::DOUBLE THEN '<=30%'
      WHEN BankcardUtilization<=0.50::DOUBLE THEN '30-50%' WHEN BankcardUtilization<=0.75::DOUBLE THEN '50-75%'
      WHEN BankcardUtilization<=1.00::DOUBLE THEN '75-100%' ELSE '>100%' END AS bankcard_util_bucket,
    StatedMonthlyIncome AS inc, DebtToIncomeRatio*StatedMonthlyIncome AS emd,
    LoanOriginalAmount*0.0125::DOUBLE/(1-pow(1.0125::DOUBLE,-Term)) AS ref_payment,
    RevolvingCreditBalance+AvailableBankcardCredit AS lim
  FROM book),
bands(IncomeRange, lo, hi) AS (VALUES ('$0',0,0),('Not employed',0,0),('$1-24,999',1,24999),('$25,000-49,999',25000,49999),
  ('$50,000-74,999',50000,74999),('$75,000-99,999',75000,99999),('$100,000+',100000,1e300::DOUBLE)),
feat AS MATERIALIZED (
  SELECT f1.* EXCLUDE (PriorLoans), coalesce(raw_prior,0) AS PriorLoans,
    coalesce(emd,-1) AS EstMonthlyDebtObligation, coalesce(inc-emd,-1) AS DisposableIncome,
    coalesce(ref_payment/nullif(inc,0),-1) AS ReferencePTI, coalesce(inc-emd-ref_payment,-1) AS ResidualIncome,
    CASE WHEN lim IS NULL THEN 0 WHEN lim=0 THEN CASE WHEN RevolvingCreditBalance>0 THEN 2 ELSE 0 END
         ELSE least(greatest(RevolvingCreditBalance/lim,0),2) END AS TotalUtilization,
    CASE WHEN OpenCreditLines IS NULL OR CurrentCreditLines IS NULL THEN 0
         WHEN CurrentCreditLines=0 THEN CASE WHEN OpenCreditLines=0 THEN 0 ELSE -1 END
         ELSE OpenCreditLines/CurrentCreditLines END AS OpenToTotalLineRatio,
    coalesce(InquiriesLast6Months/(TotalInquiries+1),-1) AS InquiryVelocity,
    coalesce(CurrentDelinquencies/(DelinquenciesLast7Years+1),-1) AS RecentDelinquencyShare,
    CASE WHEN raw_prior>0 THEN coalesce(PriorPaymentsOnTime/nullif(PriorPaymentsBilled,0),-1) ELSE -1 END AS OnTimeRate,
    CASE WHEN raw_prior>0 THEN coalesce(PriorPrincipalOutstanding/nullif(PriorPrincipalBorrowed,0),-1) ELSE -1 END AS OutstandingDebtRatio,
    coalesce(inc*12<lo OR inc*12>hi, false)::INT AS IncomeBand_Mismatch,
    coalesce(inc<=0,false)::INT AS Income_Undefined,
    (LoanStatus IN ('Chargedoff','Defaulted'))::INT AS is_bad,
    greatest(LoanOriginalAmount-LP_CustomerPrincipalPayments,0) AS ead_label,
    CASE WHEN LoanOriginalAmount-LP_CustomerPrincipalPayments>0 THEN
      least(greatest(LP_NetPrincipalLoss/(LoanOriginalAmount-LP_CustomerPrincipalPayments),0),1) END AS lgd_label,
    1/(1+exp(-(-0.7::DOUBLE-0.5::DOUBLE*(risk_band-1)+2*CASE WHEN DebtToIncomeRatio IS NULL THEN 0 ELSE least(DebtToIncomeRatio,1) END))) AS pd
  FROM f1 LEFT JOIN bands USING (IncomeRange)),
pop AS MATERIALIZED (
  SELECT * FROM feat WHERE LoanOriginationDate >= TIMESTAMP '1996-01-01'
    AND LoanStatus IN ('Chargedoff','Defaulted','Completed'))"""

# Monthly national and state series with their smoothed columns.
_MACRO = """
nat AS (
  SELECT strftime(l_shipdate,'%Y-%m') AS ym, 4+sum(round(l_tax*100)::BIGINT)::DOUBLE/count(*) AS macro_unemployment,
    sum(round(l_discount*100)::BIGINT)::DOUBLE/count(*) AS macro_fedfunds FROM lineitem GROUP BY 1),
sta AS (
  SELECT strftime(l_shipdate,'%Y-%m') AS ym, n_name AS state,
    4+sum(round(l_tax*100)::BIGINT)::DOUBLE/count(*) AS state_unemployment
  FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON n_nationkey=s_nationkey GROUP BY 1,2),
ser AS MATERIALIZED (
  SELECT ym, 'macro_unemployment' AS series, '' AS unit, macro_unemployment AS x FROM nat
  UNION ALL SELECT ym, 'macro_fedfunds', '', macro_fedfunds FROM nat
  UNION ALL SELECT ym, 'state_unemployment', state, state_unemployment FROM sta),
numbered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY series,unit ORDER BY ym) AS i FROM ser),
ewm AS (
  SELECT a.series, a.unit, a.ym,
    sum(b.x*pow(0.5::DOUBLE,(a.i-b.i)/6.0::DOUBLE))/sum(pow(0.5::DOUBLE,(a.i-b.i)/6.0::DOUBLE)) AS ewma
  FROM numbered a JOIN numbered b ON a.series=b.series AND a.unit=b.unit AND b.i<=a.i GROUP BY 1,2,3),
longrun AS (
  SELECT series, unit, avg(x) AS lr FROM ser WHERE ym BETWEEN '1995-01' AND '1999-12' GROUP BY 1,2),
yearly AS (
  SELECT series, unit, y, m, (m-lag(m) OVER v)/lag(m) OVER v AS ch FROM (
    SELECT series, unit, substr(ym,1,4) AS y, avg(x) AS m FROM ser GROUP BY 1,2,3) WINDOW v AS (PARTITION BY series,unit ORDER BY y)),
quarterly AS (
  SELECT series, unit, q, m, (m-lag(m) OVER v)/lag(m) OVER v AS ch FROM (
    SELECT series, unit, substr(ym,1,4)||'Q'||((substr(ym,6,2)::INT-1)//3+1) AS q, avg(x) AS m FROM ser GROUP BY 1,2,3)
  WINDOW v AS (PARTITION BY series,unit ORDER BY q)),
smooth AS MATERIALIZED (
  SELECT n.series, n.unit, n.ym, n.x,
    avg(n.x) OVER (PARTITION BY n.series,n.unit ORDER BY n.ym ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS ma12,
    e.ewma, l.lr AS longrun, 0.5::DOUBLE*e.ewma+0.5::DOUBLE*l.lr AS ttc, n.x-l.lr AS gap,
    (n.x-lag(n.x,12) OVER z)/nullif(lag(n.x,12) OVER z,0) AS yoy, ln(n.x) AS ln_x,
    y.m AS annual_avg, y.ch AS annual_change, q.m AS quarterly_avg, q.ch AS quarterly_change
  FROM numbered n JOIN ewm e USING (series,unit,ym) LEFT JOIN longrun l USING (series,unit)
  JOIN yearly y ON y.series=n.series AND y.unit=n.unit AND y.y=substr(n.ym,1,4)
  JOIN quarterly q ON q.series=n.series AND q.unit=n.unit AND q.q=substr(n.ym,1,4)||'Q'||((substr(n.ym,6,2)::INT-1)//3+1)
  WINDOW z AS (PARTITION BY n.series,n.unit ORDER BY n.ym)),
macro AS (
  SELECT u.ym, u.x AS macro_unemployment, f.x AS macro_fedfunds, u.ttc AS macro_unemployment_ttc,
    f.ttc AS macro_fedfunds_ttc, u.gap AS macro_unemployment_gap, f.gap AS macro_fedfunds_gap,
    u.yoy AS macro_unemployment_yoy, f.yoy AS macro_fedfunds_yoy
  FROM smooth u JOIN smooth f ON u.ym=f.ym WHERE u.series='macro_unemployment' AND f.series='macro_fedfunds'),
stm AS (
  SELECT ym, unit AS state, x AS state_unemployment, ttc AS state_unemployment_ttc, gap AS state_unemployment_gap
  FROM smooth WHERE series='state_unemployment')"""

# Observed durations of the panel population.
_PANEL = """
dur AS MATERIALIZED (
  SELECT *, LoanStatus IN ('Chargedoff','Defaulted') AS is_event,
    least(greatest(CASE WHEN ClosedDate IS NOT NULL
      THEN round_even(floor(epoch_us(ClosedDate-LoanOriginationDate)/86400000000)*(12.0::DOUBLE/365.25::DOUBLE),0)
      ELSE LoanMonthsSinceOrigination END, 1), Term)::BIGINT AS T_obs
  FROM feat WHERE LoanOriginationDate >= TIMESTAMP '1996-01-01' AND LoanStatus IS DISTINCT FROM 'Cancelled' AND Term>=1),
panel AS (
  SELECT d.*, t::DOUBLE/Term AS t_frac, (t=T_obs AND is_event)::INT AS defaulted_this_month
  FROM (SELECT *, unnest(generate_series(1,T_obs)) AS t FROM dur) d)"""


def book(select: str) -> str:
    return f"WITH {_BOOK.strip()}\n{select}"


def features(select: str) -> str:
    return f"WITH {_BOOK.strip()},\n{_FEAT.strip()}\n{select}"


def macro(select: str) -> str:
    return f"WITH {_MACRO.strip()}\n{select}"


def overlay(select: str) -> str:
    return f"WITH {_BOOK.strip()},\n{_FEAT.strip()},\n{_MACRO.strip()}\n{select}"


def panel(select: str) -> str:
    return f"WITH {_BOOK.strip()},\n{_FEAT.strip()},\n{_PANEL.strip()}\n{select}"


def everything(select: str) -> str:
    return f"WITH {_BOOK.strip()},\n{_FEAT.strip()},\n{_MACRO.strip()},\n{_PANEL.strip()}\n{select}"
