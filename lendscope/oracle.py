"""DuckDB forms of the logical tables, for the SQL oracle.

Each registered query has an independent SQL statement in
``__spark_entry__.oracle_sql``.  They all start from the physical tables;
this module holds the shared WITH-clause that derives the logical tables
(the same derivations as ``sources.tables``, written in SQL).
"""

from __future__ import annotations

import re

AS_OF = "timestamp '2024-01-31 00:00:00'"

LOANS = """
loans as (
 select o_orderkey as ID,
  case when o_orderkey % 13 = 0 then '$' when o_orderkey % 17 = 0 then null
       else cast(cast(5*(floor(c_acctbal)+900) as bigint) as varchar) end as Client_Income,
  case when o_orderkey % 19 = 0 then null else cast(o_totalprice as double) end as Credit_Amount,
  case when o_orderkey % 23 = 0 then null else o_totalprice / 20 end as Loan_Annuity,
  case when o_orderkey % 29 = 0 then null else -cast(5000 + (o_custkey * 37 + o_orderkey * 11) % 33000 as double) end as Age_Days,
  case when o_orderkey % 31 = 0 then null else cast((o_orderkey * 53) % 20000 as double) end as Employed_Days,
  case when o_orderkey % 7 = 0 then null else cast(o_orderkey % 2 as double) end as Car_Owned,
  cast(o_orderkey % 3 = 0 as int) as Bike_Owned, cast(o_orderkey % 5 < 3 as int) as House_Own,
  1 as Mobile_Tag, cast(o_orderkey % 4 = 0 as int) as Homephone_Tag, cast(o_orderkey % 6 < 2 as int) as Workphone_Working,
  case when o_orderkey % 3 = 1 then null else ((o_orderkey * 7919) % 1000) / 1000.0::double end as Score_Source_1,
  ((o_orderkey * 104729) % 1000) / 1000.0::double as Score_Source_2,
  case when o_orderkey % 9 = 1 then null else ((o_orderkey * 1299709) % 1000) / 1000.0::double end as Score_Source_3,
  case when o_orderkey % 37 = 0 then null else cast(o_orderkey % 7 as int) end as Application_Process_Day,
  case when o_orderkey % 10 = 3 then null else cast(o_orderkey % 2 as int) end as Active_Loan,
  cast(o_orderkey % 5 as int) as Child_Count,
  case when o_orderkey % 11 = 0 then null else c_mktsegment end as Client_Income_Type,
  o_orderpriority as Client_Education,
  cast((o_orderkey * 7919 + o_custkey * 31) % 100 < (case when o_totalprice > 350000 then 14 else 5 end) as int) as "Default"
 from orders join customer on o_custkey = c_custkey)"""

RAW_PREDICTIONS = """
raw_predictions as (
 select event_id as id, ts as "timestamp", concat('customer_', cast(user_id as varchar)) as customer_id,
  least(value / 200.0::double, 1.0::double) as probability,
  cast(least(value / 200.0::double, 1.0::double) >= 0.5::double as int) as prediction,
  case when regexp_extract(props,'([0-9]+)',1) in ('7','77') then null
       else cast(regexp_extract(props,'([0-9]+)',1) as double) * 6 end as processing_time_ms
 from events where event_type in ('view','click','signup'))"""

SCORED = """
scored as (
 select *,
  case when probability <= 0.15 then 'APPROVE' when probability <= 0.25 then 'APPROVE'
       when probability <= 0.40 then 'REVIEW' else 'REJECT' end as decision,
  case when probability <= 0.15 then 'HIGH' when probability <= 0.25 then 'MEDIUM'
       when probability <= 0.40 then 'MEDIUM' else 'HIGH' end as confidence_level
 from raw_predictions)"""

FEEDBACK = """
feedback as (
 select event_id as feedback_id, ts as feedback_ts, concat('customer_', cast(user_id as varchar)) as customer_id,
  cast(event_type = 'error' as int) as actual_outcome
 from events where event_type in ('error','purchase'))"""

LAB = """
label_match as (
 select p.id as pid, min({'t': f.feedback_ts, 'i': f.feedback_id, 'o': f.actual_outcome}) as m
 from raw_predictions p join feedback f on f.customer_id = p.customer_id and f.feedback_ts >= p."timestamp"
 group by p.id),
lab as (
 select s.*, x.m.o as actual_outcome, x.m.t as feedback_date, x.m.i as feedback_id
 from scored s left join label_match x on x.pid = s.id)"""


def with_(*parts: str) -> str:
    return "with " + ",".join(parts) + "\n"


def with_log() -> str:
    return with_(RAW_PREDICTIONS, SCORED, FEEDBACK, LAB)


def _window(days: int) -> str:
    return f"""w as (select * from lab where "timestamp" >= {AS_OF} - interval {days} day)"""


def _auc_cte(src: str) -> str:
    return f"""r as (select actual_outcome y,
   rank() over (order by probability) + (count(*) over (partition by probability) - 1) / 2.0 rk
   from {src} where actual_outcome is not null),
auc as (select (sum(rk) filter (where y = 1) - count(*) filter (where y = 1) * (count(*) filter (where y = 1) + 1) / 2.0)
   / nullif(count(*) filter (where y = 1) * count(*) filter (where y = 0), 0) as auc,
   count(*) filter (where y = 1) as n_pos, count(*) filter (where y = 0) as n_neg from r)"""


def kpis(days: int) -> str:
    return with_log() + f""", {_window(days)},
a as (select count(*) n, avg(probability) ap, avg(processing_time_ms) al,
   count(*) filter (where decision = 'APPROVE') approved, count(*) filter (where decision = 'REJECT') rejected,
   count(*) filter (where decision = 'REVIEW') reviews,
   count(*) filter (where probability <= 0.2) n_low,
   count(*) filter (where probability > 0.2 and probability <= 0.4) n_medium,
   count(*) filter (where probability > 0.4) n_high,
   count(*) filter (where confidence_level = 'HIGH') ch, count(*) filter (where confidence_level = 'MEDIUM') cm,
   count(*) filter (where confidence_level = 'LOW') cl,
   count(*) filter (where actual_outcome is not null) labeled,
   count(*) filter (where actual_outcome = 1 and prediction = 1) tp,
   count(*) filter (where actual_outcome = 0 and prediction = 1) fp,
   count(*) filter (where actual_outcome = 1 and prediction = 0) fn
   from w),
{_auc_cte('w')}
select {days} as period_days, n::bigint as total_predictions, round(ap, 6) as avg_probability,
 round(al, 6) as avg_processing_time_ms,
 round(approved / nullif(n, 0), 6) as approval_rate, round(rejected / nullif(n, 0), 6) as rejection_rate,
 round(reviews / nullif(n, 0), 6) as review_rate,
 round(n_low / nullif(n, 0), 6) as low_risk, round(n_medium / nullif(n, 0), 6) as medium_risk,
 round(n_high / nullif(n, 0), 6) as high_risk,
 round(ch / nullif(n, 0), 6) as conf_high, round(cm / nullif(n, 0), 6) as conf_medium,
 round(cl / nullif(n, 0), 6) as conf_low,
 case when labeled > 0 then round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) end as "precision",
 case when labeled > 0 then round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) end as recall,
 case when labeled > 0 then round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) end as f1_score,
 case when labeled > 0 then round(auc, 6) end as roc_auc,
 labeled::bigint as labeled_samples
from a, auc"""


SQL: dict[str, str] = {}

SQL["monitor_kpis_7d"] = kpis(7)
SQL["monitor_kpis_30d"] = kpis(30)

SQL["label_join"] = with_log() + """
select id, customer_id, actual_outcome, feedback_date, feedback_id from lab"""

SQL["label_join_null_keys"] = with_(RAW_PREDICTIONS, SCORED, FEEDBACK) + """,
p as (select id, "timestamp" t, case when split_part(customer_id, '_', 2)::bigint % 5 <> 0 then customer_id end as customer_id from scored),
f as (select feedback_id, feedback_ts, actual_outcome, case when split_part(customer_id, '_', 2)::bigint % 5 <> 0 then customer_id end as customer_id from feedback),
m as (select p.id, arg_min(struct_pack(a := f.actual_outcome, t := f.feedback_ts, i := f.feedback_id), struct_pack(t := f.feedback_ts, i := f.feedback_id)) as m
   from p join f on f.customer_id = p.customer_id and f.feedback_ts >= p.t group by 1)
select p.id, p.customer_id, m.m.a as actual_outcome, m.m.t as feedback_date, m.m.i as feedback_id from p left join m on m.id = p.id"""

SQL["stream_labels"] = with_log() + """
select id, actual_outcome, feedback_id from lab where feedback_id is not null"""

SQL["unmatched_feedback"] = with_log() + """
select f.* from feedback f
where f.feedback_id not in (select feedback_id from lab where feedback_id is not null)"""

SQL["roc_auc"] = with_log() + "," + _auc_cte("lab") + """
select round(auc, 6) as auc, n_pos::bigint as n_pos, n_neg::bigint as n_neg from auc"""

SQL["roc_curve"] = with_log() + """,
g as (select probability s, count(*) filter (where actual_outcome = 1) pos,
        count(*) filter (where actual_outcome = 0) neg
      from lab where actual_outcome is not null group by 1),
t as (select sum(pos) P, sum(neg) N from g)
select round(s, 6) as threshold,
 round((N - sum(neg) over (order by s rows between unbounded preceding and current row) + neg) / N, 6) as fpr,
 round((P - sum(pos) over (order by s rows between unbounded preceding and current row) + pos) / P, 6) as tpr
from g, t
union all
select 'inf'::double, case when N > 0 then 0.0 end, case when P > 0 then 0.0 end from t"""

SQL["confidence_mix_7d"] = with_log() + f""", {_window(7)}
select confidence_level, count(*)::bigint as n, round(count(*) / (select count(*) from w), 6) as share
from w group by 1"""

SQL["lifetime_stats"] = with_log() + """
select count(*)::bigint as total_predictions, round(coalesce(avg(probability), 0), 6) as avg_probability,
 count(*) filter (where decision = 'APPROVE')::bigint as approvals,
 count(*) filter (where decision = 'REJECT')::bigint as rejections,
 count(*) filter (where decision = 'REVIEW')::bigint as reviews,
 round(coalesce(count(*) filter (where decision = 'APPROVE') / nullif(count(*), 0), 0), 6) as approval_rate,
 round(coalesce(avg(processing_time_ms), 0), 6) as avg_processing_time_ms
from lab"""

SQL["roi_30d"] = with_log() + f""", {_window(30)},
a as (select count(*) n, count(*) filter (where decision = 'APPROVE') approved,
   count(*) filter (where decision = 'REJECT') rejected, count(*) filter (where decision = 'REVIEW') reviews,
   avg(processing_time_ms) al, count(*) filter (where actual_outcome is not null) labeled,
   count(*) filter (where actual_outcome = 1 and prediction = 1) tp,
   count(*) filter (where actual_outcome = 0 and prediction = 1) fp from w),
b as (select *, coalesce(tp / nullif(tp + fp, 0), 0.0) prec, tp * 20000 * 0.60::double prevented,
   fp * 20000 * 0.05::double opp from a)
select 30 as period_days, n::bigint as total_predictions, approved::bigint as approved,
 rejected::bigint as rejected, reviews::bigint as reviews,
 round(n * 0.10::double, 6) as api_processing_cost, round(reviews * 50.0, 6) as manual_review_cost,
 round(n * 0.10::double + reviews * 50.0, 6) as total_operational_cost,
 case when labeled > 0 then tp end::bigint as defaults_prevented,
 case when labeled > 0 then round(prevented, 6) end as default_cost_prevented,
 case when labeled > 0 then fp end::bigint as good_customers_rejected,
 case when labeled > 0 then round(opp, 6) end as opportunity_cost,
 case when labeled > 0 then round(prevented - opp, 6) end as net_savings,
 case when labeled > 0 then labeled end::bigint as labeled_sample_size,
 case when labeled > 0 then round(prec, 6) end as current_precision,
 case when labeled > 0 then round((prec - 0.161::double) / 0.161::double, 6) end as precision_improvement,
 case when labeled > 0 then round((prec - 0.161::double) / 0.161::double * prevented, 6) end
   as estimated_additional_savings,
 round((approved + rejected) / nullif(n, 0), 6) as automation_rate,
 round(reviews / nullif(n, 0), 6) as manual_review_rate,
 round(al, 6) as avg_processing_time_ms,
 round(n / 30.0, 6) as daily_prediction_volume
from b"""

SQL["daily_series_30d"] = with_log() + f""", {_window(30)}
select cast("timestamp" as date) as day, count(*)::bigint as predictions,
 round(avg(processing_time_ms), 6) as avg_processing_time_ms
from w group by 1"""

SQL["roc_points"] = with_log() + """,
g as (select probability s, count(*) filter (where actual_outcome = 1) pos, count(*) filter (where actual_outcome = 0) neg
      from lab where actual_outcome is not null group by 1),
t as (select sum(pos) P, sum(neg) N from g),
c as (select *, sum(pos) over (order by s desc) as tps, sum(neg) over (order by s desc) as fps, row_number() over (order by s desc) as i,
   count(*) over () as n from g),
-- the library's rule: a point stays where the second difference of either count isn't zero, and at both ends
d as (select *, lead(tps) over w - 2 * tps + lag(tps) over w as dt, lead(fps) over w - 2 * fps + lag(fps) over w as df from c window w as (order by i))
select round(s, 6) as threshold, round(fps / t.N, 6) as fpr, round(tps / t.P, 6) as tpr from d, t where i = 1 or i = d.n or dt <> 0 or df <> 0
union all
select 'inf'::double, case when N > 0 then 0.0 end, case when P > 0 then 0.0 end from t"""

SQL["daily_snapshot"] = with_log() + """,
g as (select cast("timestamp" as date) as date, count(*) n,
   count(*) filter (where actual_outcome = 1 and prediction = 1) tp,
   count(*) filter (where actual_outcome = 0 and prediction = 1) fp,
   count(*) filter (where actual_outcome = 1 and prediction = 0) fn,
   count(*) filter (where decision = 'APPROVE') approved,
   avg(greatest(probability, 1 - probability)) conf
   from lab group by 1)
select date, n::bigint as total_predictions,
 round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) as precision_score,
 round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) as recall_score,
 round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) as f1_score,
 round(approved / n, 6) as approval_rate, round(conf, 6) as avg_confidence
from g"""


# ---------------------------------------------------------------- profiling and features

# Column layout of the loan fixture (same order as ``sources.tables.loans``).
LOAN_NUMERIC = ["ID", "Client_Income", "Credit_Amount", "Loan_Annuity", "Age_Days", "Employed_Days", "Car_Owned",
                "Bike_Owned", "House_Own", "Mobile_Tag", "Homephone_Tag", "Workphone_Working", "Score_Source_1",
                "Score_Source_2", "Score_Source_3", "Application_Process_Day", "Active_Loan", "Child_Count"]
LOAN_TEXT = ["Client_Income_Type", "Client_Education"]
LOAN_COLUMNS = LOAN_NUMERIC + LOAN_TEXT + ["Default"]
FEATURE_NUMERIC = ["Age_Years", "Employment_Years", "Income_Credit_Ratio", "Credit_Income_Percentage",
                   "Annuity_Income_Ratio", "Asset_Score", "Contact_Completeness", "Average_External_Score",
                   "Max_External_Score", "Min_External_Score", "Is_Weekend", "Financial_Stress_Score"]
FEATURE_ORDER = ["Age_Years", "Age_Group", "Employment_Years", "Employment_Stability", "Income_Credit_Ratio",
                 "Credit_Income_Percentage", "Annuity_Income_Ratio", "Asset_Score", "Contact_Completeness",
                 "Average_External_Score", "Max_External_Score", "Min_External_Score", "Is_Weekend",
                 "Financial_Stress_Score"]
FEAT_COLUMNS = LOAN_COLUMNS + FEATURE_ORDER
FEAT_TEXT = LOAN_TEXT + ["Age_Group", "Employment_Stability"]
FEAT_NUMERIC = [c for c in FEAT_COLUMNS if c not in FEAT_TEXT]
NUMERIC_RE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def q(c: str) -> str:
    return f'"{c}"'


TYPED = f"""
typed as (select * replace (case when regexp_full_match(Client_Income, '{NUMERIC_RE}')
   then try_cast(trim(Client_Income) as double) end as Client_Income) from loans)"""

_AGE = "abs(coalesce(Age_Days, 0)) / 365.25"
_EMP = "abs(coalesce(Employed_Days, 0)) / 365.25"
_PCT = "Credit_Amount / nullif(Client_Income + 1, 0) * 100"
FEAT = f"""
feat as (select *,
 {_AGE} as Age_Years,
 case when {_AGE} >= 0 and {_AGE} <= 25 then 'Young' when {_AGE} <= 35 then 'Adult' when {_AGE} <= 45 then 'Middle'
      when {_AGE} <= 55 then 'Senior' when {_AGE} <= 100 then 'Elder' end as Age_Group,
 {_EMP} as Employment_Years,
 case when {_EMP} >= 0 and {_EMP} <= 1 then 'New' when {_EMP} <= 5 then 'Stable' when {_EMP} <= 10 then 'Experienced'
      when {_EMP} <= 50 then 'Veteran' end as Employment_Stability,
 Client_Income / nullif(Credit_Amount + 1, 0) as Income_Credit_Ratio,
 {_PCT} as Credit_Income_Percentage,
 Loan_Annuity / nullif(Client_Income + 1, 0) as Annuity_Income_Ratio,
 coalesce(Car_Owned, 0) + coalesce(Bike_Owned, 0) + coalesce(House_Own, 0) as Asset_Score,
 coalesce(Mobile_Tag, 0) + coalesce(Homephone_Tag, 0) + coalesce(Workphone_Working, 0) as Contact_Completeness,
 (coalesce(Score_Source_1, 0) + coalesce(Score_Source_2, 0) + coalesce(Score_Source_3, 0))
   / nullif((Score_Source_1 is not null)::int + (Score_Source_2 is not null)::int + (Score_Source_3 is not null)::int, 0)
   as Average_External_Score,
 greatest(Score_Source_1, Score_Source_2, Score_Source_3) as Max_External_Score,
 least(Score_Source_1, Score_Source_2, Score_Source_3) as Min_External_Score,
 coalesce(Application_Process_Day in (0, 6), false)::int as Is_Weekend,
 (coalesce({_PCT} > 50, false)::int + coalesce(Active_Loan, 0) + coalesce(Child_Count > 2, false)::int)::double
   as Financial_Stress_Score
 from typed)"""


def with_feat() -> str:
    return with_(LOANS, TYPED, FEAT)


SQL["loans_typed"] = with_(LOANS, TYPED) + "select * replace (" + ", ".join(
    f"round({q(c)}, 6) as {q(c)}" for c in ["Client_Income", "Credit_Amount", "Loan_Annuity", "Age_Days",
                                            "Employed_Days", "Car_Owned", "Score_Source_1", "Score_Source_2",
                                            "Score_Source_3"]) + ") from typed"

_FEAT_DOUBLE = ["Age_Years", "Employment_Years", "Income_Credit_Ratio", "Credit_Income_Percentage",
                "Annuity_Income_Ratio", "Asset_Score", "Average_External_Score", "Max_External_Score",
                "Min_External_Score", "Financial_Stress_Score"]
SQL["loan_features"] = with_feat() + "select ID, " + ", ".join(
    f"round({c}, 6) as {c}" if c in _FEAT_DOUBLE else c for c in FEATURE_ORDER) + " from feat"

SQL["profile_shape"] = with_(LOANS, TYPED) + f"""
select count(*)::bigint as n_rows, {len(LOAN_COLUMNS)} as n_columns, {len(LOAN_NUMERIC) + 1} as n_numeric,
 {len(LOAN_TEXT)} as n_text from typed"""

SQL["missing_top10"] = with_(LOANS, TYPED) + ", m as (" + " union all ".join(
    f"select '{c}' as \"column\", count(*) - count({q(c)}) as missing_count, count(*) as n from typed"
    for c in LOAN_COLUMNS) + """)
select "column", missing_count::bigint as missing_count, round(missing_count / n * 100, 6) as missing_percentage,
 row_number() over (order by missing_count desc, "column") as rank
from m where missing_count > 0 qualify rank <= 10"""

SQL["target_balance"] = with_(LOANS, TYPED) + """,
a as (select count(*) n, count(*) filter (where "Default" = 0) n0, count(*) filter (where "Default" = 1) n1 from typed)
select n0::bigint as n_no_default, n1::bigint as n_default, round(n0 / n * 100, 6) as pct_no_default,
 round(n1 / n * 100, 6) as pct_default, round(n0 / nullif(n1, 0), 6) as imbalance_ratio,
 coalesce(n0 / nullif(n1, 0) > 3, false) as needs_balancing, coalesce(n0 / nullif(n1, 0) > 20, false) as severe_imbalance
from a"""

SQL["target_counts"] = with_(LOANS) + """
select "Default", count(*)::bigint as n from loans where "Default" is not null group by 1"""

SQL["duplicate_rows"] = with_(LOANS, TYPED) + """
select coalesce(sum(n - 1), 0)::bigint as duplicate_rows from (select count(*) n from typed group by all_cols)
""".replace("group by all_cols", "group by " + ", ".join(q(c) for c in LOAN_COLUMNS))

_OUT_COLS = [c for c in LOAN_NUMERIC if c != "ID"] + ["Default"]
SQL["iqr_outliers_top10"] = with_(LOANS, TYPED) + ", s as (" + " union all ".join(
    f"select '{c}' as \"column\", quantile_cont({q(c)}, 0.25) q1, quantile_cont({q(c)}, 0.75) q3, "
    f"count({q(c)}) nv, count(*) n, "
    f"count(*) filter (where {q(c)} < q1_ - 1.5 * (q3_ - q1_) or {q(c)} > q3_ + 1.5 * (q3_ - q1_)) o "
    f"from typed, (select quantile_cont({q(c)}, 0.25) q1_, quantile_cont({q(c)}, 0.75) q3_ from typed) b"
    for c in _OUT_COLS) + """)
select "column", round(q1, 6) as q1, round(q3, 6) as q3, o::bigint as outliers, round(o / n * 100, 6) as percentage,
 row_number() over (order by o desc, "column") as rank
from s where nv >= n * 0.1 and q3 - q1 > 0 and o > 0 qualify rank <= 10"""

SQL["consistency_checks"] = with_(LOANS, TYPED) + """
select count(*) filter (where abs(coalesce(Age_Days, 0)) / 365.25 < 18 or abs(coalesce(Age_Days, 0)) / 365.25 > 100)::bigint
   as unrealistic_age,
 count(*) filter (where Age_Days is null)::bigint as missing_age,
 count(*) filter (where Client_Income <= 0)::bigint as non_positive_income,
 count(*) filter (where Client_Income is null)::bigint as missing_income
from typed"""

_CORR_COLS = [c for c in FEAT_NUMERIC if c not in ("ID", "Default")]
SQL["target_corr_top10"] = with_feat() + ", c as (" + " union all ".join(
    f"select '{c}' as \"column\", abs(covar_pop({q(c)}, \"Default\") / "
    f"(stddev_pop({q(c)}) * stddev_pop(\"Default\"::double))) as r from feat "
    f"where {q(c)} is not null and \"Default\" is not null" for c in _CORR_COLS) + """)
select "column", round(r, 6) as abs_corr, row_number() over (order by r desc, "column") as rank
from c where r is not null and not isnan(r) qualify rank <= 10"""

SQL["asset_default_crosstab"] = with_feat() + """
select Asset_Score, round(count(*) filter (where "Default" = 0) / count(*) * 100, 6) as pct_0,
 round(count(*) filter (where "Default" = 1) / count(*) * 100, 6) as pct_1
from feat where Asset_Score is not null and "Default" is not null group by 1"""


def _hist(col: str, bins: int, positive: bool) -> str:
    cond = f"{col} is not null and not isnan({col})" + (f" and {col} > 0" if positive else "")
    return with_feat() + f""",
d as (select {col}::double v from feat where {cond}),
r as (select min(v) lo, max(v) hi from d),
c as (select case when hi > lo then least(floor((v - lo) / (hi - lo) * {bins}), {bins - 1}) else 0 end::int b,
   count(*) n from d, r group by 1)
select bin::int as bin, round(lo + bin * (hi - lo) / {bins}, 6) as bin_start,
 round(case when bin = {bins - 1} then hi else lo + (bin + 1) * (hi - lo) / {bins} end, 6) as bin_end,
 coalesce(n, 0)::bigint as n
from r, range(0, {bins}) t(bin) left join c on c.b = t.bin"""


SQL["hist_age_years"] = _hist("Age_Years", 30, False)
SQL["hist_income_positive"] = _hist("Client_Income", 50, True)


# ---------------------------------------------------------------- preparation

def _mode_cte(c: str) -> str:
    return (f"mode_{c} as (select coalesce((select v from (select {q(c)} v, count(*) n from feat "
            f"where {q(c)} is not null group by 1 order by n desc, v limit 1)), 'Unknown') as v)")


def with_ml() -> str:
    """feat -> filled (median / mode) -> ml (codes), ID and Default kept."""
    med = "med as (select " + ", ".join(f"median({q(c)}::double) as {q(c)}" for c in FEAT_NUMERIC) + " from feat)"
    modes = [_mode_cte(c) for c in FEAT_TEXT]
    fill_cols = []
    for c in FEAT_COLUMNS:
        if c in FEAT_TEXT:
            fill_cols.append(f"coalesce(f.{q(c)}, (select v from mode_{c})) as {q(c)}")
        elif c in ("ID", "Default"):
            fill_cols.append(f"coalesce(f.{q(c)}, med.{q(c)}::bigint) as {q(c)}")
        else:
            fill_cols.append(f"coalesce(f.{q(c)}::double, med.{q(c)}) as {q(c)}")
    filled = "filled as (select " + ", ".join(fill_cols) + " from feat f, med)"
    codes = [f"code_{c} as (select v, (dense_rank() over (order by v) - 1)::int as code "
             f"from (select distinct {q(c)} v from filled))" for c in FEAT_TEXT]
    sel = []
    joins = []
    for c in FEAT_COLUMNS:
        if c in FEAT_TEXT:
            sel.append(f"code_{c}.code as {q(c)}")
            joins.append(f"left join code_{c} on code_{c}.v = filled.{q(c)}")
        else:
            sel.append(f"filled.{q(c)}")
    ml = "ml as (select " + ", ".join(sel) + " from filled " + " ".join(joins) + ")"
    return with_feat() + ", " + ", ".join([med, *modes, filled, *codes, ml]) + "\n"


_ML_FEATURES = [c for c in FEAT_COLUMNS if c not in ("ID", "Default")]
SQL["ml_table"] = with_ml() + "select " + ", ".join(
    q(c) if c in FEAT_TEXT else f"round({q(c)}, 6) as {q(c)}" for c in _ML_FEATURES) + ', "Default" from ml'

SQL["median_fill_values"] = with_feat() + "select * from (" + " union all ".join(
    f"select '{c}' as \"column\", round(median({q(c)}::double), 6) as fill from feat" for c in FEAT_NUMERIC) + ")"

SQL["mode_fill_values"] = with_feat() + ", " + ", ".join(_mode_cte(c) for c in FEAT_TEXT) + "\n" + \
    " union all ".join(f"select '{c}' as \"column\", v as fill from mode_{c}" for c in FEAT_TEXT)

SQL["label_codes"] = with_ml() + " union all ".join(
    f"select '{c}' as \"column\", v as value, code from code_{c}" for c in FEAT_TEXT)

_HASH = "('0x' || substr(md5(concat('42|', ID::varchar)), 1, 8))::bigint"
SQL["stratified_split"] = with_(LOANS) + f"""
select ID, "Default",
 row_number() over (partition by "Default" order by {_HASH}, ID)
   <= round(count(*) over (partition by "Default") * 0.2) as is_test
from loans"""


def with_train() -> str:
    return with_ml() + f""", split as (select *,
 row_number() over (partition by "Default" order by {_HASH}, ID)
   <= round(count(*) over (partition by "Default") * 0.2) as is_test from ml),
train as (select * from split where not is_test),
long as (unpivot (select * exclude (ID, is_test) replace ({", ".join(f"{q(c)}::double as {q(c)}" for c in _ML_FEATURES)})
   from train) on {", ".join(q(c) for c in _ML_FEATURES)} into name "column" value value)
"""


SQL["scaler_stats"] = with_train() + """
select "column", round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std from long group by 1"""

SQL["anova_f_top20"] = with_train() + """,
g as (select "column", "Default", count(value) n, avg(value) m, var_pop(value) v from long group by 1, 2 having count(value) > 0),
o as (select "column", sum(n * m) / sum(n) as all_m from g group by 1),
a as (select "column", sum(n) N, count(*) k, sum(n * v) ssw, sum(n * (m - all_m) * (m - all_m)) ssb from g join o using ("column") group by 1),
f as (select "column", case when k < 2 then null when ssw > 0 then (ssb / (k - 1)) / (ssw / (N - k))
   when ssb > 0 then 'inf'::double end as f from a)
select "column", round(f, 6) as f_score, row_number() over (order by f desc nulls last, "column") as rank,
 f is not null and row_number() over (order by f desc nulls last, "column") <= 20 as selected
from f"""

# Trees: candidate cuts are the values at ranks floor((n - 1) i / 32); every level is a few CTEs.
_UNIT = 16777216
_CUTS = f""",
fx as (select ID, y, list_position({[c for c in _ML_FEATURES]}, "column") as fi, "column" as f, v from
   (unpivot (select ID, "Default" as y, {", ".join(f"{q(c)}::double as {q(c)}" for c in _ML_FEATURES)} from train)
    on {", ".join(q(c) for c in _ML_FEATURES)} into name "column" value v)),
ranked as (select fi, f, v, row_number() over (partition by fi order by v) - 1 as k, count(*) over (partition by fi) as n from fx),
cut_values as (select distinct fi, f, v as cut from ranked join (select unnest(range(1, 33)) as i) on k = floor((n - 1) * (i / 32.0::double))::bigint),
cuts as (select * from cut_values c where cut < (select max(cut) from cut_values d where d.fi = c.fi))"""


def _tree_levels(t: str, stats: str, depth: int, gain: str, allowed: str) -> tuple[str, list[str]]:
    """CTEs that grow tree ``t`` over ``stats`` (ID, s0, s1); gain and allowed are over l0, l1, r0, r1, t0, t1. Returns them and the node tables."""
    sql = f", {t}_a0 as (select ID, 0 as node, s0, s1 from {stats})"
    base, nodes = "1", []
    for d in range(depth):
        sql += f""",
{t}_t{d} as (select node, sum(s0)::bigint as t0, sum(s1)::bigint as t1 from {t}_a{d} group by 1),
{t}_c{d} as (select a.node, c.fi, c.f, c.cut, coalesce(sum(s0) filter (v <= cut), 0)::bigint as l0, coalesce(sum(s1) filter (v <= cut), 0)::bigint as l1
   from {t}_a{d} a join fx on fx.ID = a.ID join cuts c on c.fi = fx.fi group by all),
{t}_g{d} as (select *, {gain} as gain from (select *, t0 - l0 as r0, t1 - l1 as r1 from {t}_c{d} join {t}_t{d} using (node))),
{t}_b{d} as (select *, ({base}) + 2 * (row_number() over (order by node) - 1) as left_node from
   (select * from {t}_g{d} where {allowed} qualify row_number() over (partition by node order by gain desc, fi, cut) = 1)),
{t}_a{d + 1} as (select a.ID, b.left_node + (fx.v > b.cut)::int as node, s0, s1 from {t}_a{d} a join {t}_b{d} b on a.node = b.node
   join fx on fx.ID = a.ID and fx.fi = b.fi),
{t}_n{d} as (select x.node, {d} as depth, b.f as feature, b.cut as threshold, b.left_node, x.t0, x.t1, b.gain
   from {t}_t{d} x left join {t}_b{d} b on b.node = x.node)"""
        base += f" + 2 * (select count(*) from {t}_b{d})"
        nodes.append(f"{t}_n{d}")
    sql += f""",
{t}_n{depth} as (select node, {depth} as depth, null::varchar as feature, null::double as threshold, null::bigint as left_node,
   sum(s0)::bigint as t0, sum(s1)::bigint as t1, null::double as gain from {t}_a{depth} group by 1)"""
    nodes.append(f"{t}_n{depth}")
    sql += f""",
{t} as ({" union all ".join(f"select * from {n}" for n in nodes)})"""
    return sql, nodes


def _boost_value(s0: str, s1: str) -> str:
    return f"(-(sign({s0}) * greatest(abs({s0} / {_UNIT}.0::double) - 0.1, 0)) / ({s1} / {_UNIT}.0::double + 1.0))"


def _boost_score(s0: str, s1: str) -> str:
    return f"(pow(greatest(abs({s0} / {_UNIT}.0::double) - 0.1, 0), 2) / ({s1} / {_UNIT}.0::double + 1.0))"


def boosted_sql(rounds: int, depth: int) -> str:
    """Second-order boosting: rate 0.05, L1 0.1, L2 1, positives weigh 3, least hessian of a child 1."""
    gain = f"0.5 * ({_boost_score('l0', 'l1')} + {_boost_score('r0', 'r1')} - {_boost_score('t0', 't1')})"
    sql = with_train() + _CUTS + ', margin0 as (select ID, "Default" as y, 0.0::double as m from train)'
    for r in range(rounds):
        sql += f""",
grad{r} as (select ID, round(w * (p - y) * {_UNIT})::bigint as s0, round(w * p * (1 - p) * {_UNIT})::bigint as s1
   from (select ID, y, 1 / (1 + exp(-m)) as p, case when y = 1 then 3.0::double else 1.0::double end as w from margin{r}))"""
        sql += _tree_levels(f"tree{r}", f"grad{r}", depth, gain, f"l1 >= {_UNIT} and r1 >= {_UNIT} and gain > 1e-6")[0]
        # a row's leaf is the deepest node it reached
        reached = " union all ".join(f"select ID, node, {d} as d from tree{r}_a{d}" for d in range(depth + 1))
        sql += f""",
leaf{r} as (select ID, node from ({reached}) qualify row_number() over (partition by ID order by d desc) = 1),
margin{r + 1} as (select m.ID, m.y, m.m + 0.05 * {_boost_value('t.t0', 't.t1')} as m from margin{r} m join leaf{r} using (ID) join tree{r} t using (node))"""
    return sql + "\n" + " union all ".join(
        f"""select {r}::int as tree, node::int as node, depth::int as depth, feature, round(threshold, 6) as threshold, left_node::int as left_node,
 t0 as stat0, t1 as stat1, round(gain, 6) as gain, round({_boost_value('t0', 't1')}, 6) as value from tree{r}""" for r in range(rounds))


def forest_tree_sql(depth: int) -> str:
    """One balanced Gini tree over all rows and features, leaf >= 10, split >= 20."""
    def purity(a: str, b: str) -> str:
        return f"(coalesce((w0 * {a} * (w0 * {a}) + w1 * {b} * (w1 * {b})) / nullif(w0 * {a} + w1 * {b}, 0), 0))"
    gain = f"(select {purity('l0', 'l1')} + {purity('r0', 'r1')} - {purity('t0', 't1')} from cw)"
    sql = with_train() + _CUTS + """, cw as (select count(*) / (2.0::double * count(*) filter ("Default" = 0)) as w0,
   count(*) / (2.0::double * count(*) filter ("Default" = 1)) as w1 from train),
cls as (select ID, ("Default" = 0)::int as s0, ("Default" = 1)::int as s1 from train)"""
    sql += _tree_levels("tree", "cls", depth, gain, "l0 + l1 >= 10 and r0 + r1 >= 10 and t0 + t1 >= 20 and least(t0, t1) > 0 and gain > 1e-12")[0]
    return sql + """
select 0::int as tree, node::int as node, depth::int as depth, feature, round(threshold, 6) as threshold, left_node::int as left_node,
 t0 as stat0, t1 as stat1, round(gain, 6) as gain, round(t1 * w1 / (t0 * w0 + t1 * w1), 6) as value from tree, cw"""


SQL["boosted_stumps"] = boosted_sql(3, 1)
SQL["boosted_trees"] = boosted_sql(2, 2)
SQL["forest_tree"] = forest_tree_sql(2)



def logistic_sql(steps: int, c: float) -> str:
    """Newton steps of a model of two columns and a constant; the 3 x 3 system is solved by determinants."""
    sql = with_train() + """, cw as (select count(*) / (2.0::double * count(*) filter ("Default" = 0)) as w0,
   count(*) / (2.0::double * count(*) filter ("Default" = 1)) as w1 from train),
lr as (select "Default"::double as y, Age_Years / 10 as a, Score_Source_2 as b, case when "Default" = 1 then w1 else w0 end as w from train, cw),
b0 as (select 0.0::double as x, 0.0::double as y, 0.0::double as z)"""
    for k in range(steps):
        sql += f""",
p{k} as (select lr.*, 1 / (1 + exp(-(b{k}.x + b{k}.y * lr.a + b{k}.z * lr.b))) as p, b{k}.x as bx, b{k}.y as by_, b{k}.z as bz from lr, b{k}),
s{k} as (select any_value(bx) bx, any_value(by_) by_, any_value(bz) bz,
   {c} * sum(w * (p - y)) + any_value(bx) g1, {c} * sum(w * (p - y) * a) + any_value(by_) g2, {c} * sum(w * (p - y) * b) + any_value(bz) g3,
   {c} * sum(w * p * (1 - p)) + 1 h11, {c} * sum(w * p * (1 - p) * a) h12, {c} * sum(w * p * (1 - p) * b) h13,
   {c} * sum(w * p * (1 - p) * a * a) + 1 h22, {c} * sum(w * p * (1 - p) * a * b) h23, {c} * sum(w * p * (1 - p) * b * b) + 1 h33 from p{k}),
d{k} as (select *, h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h23 * h13) + h13 * (h12 * h23 - h22 * h13) as det from s{k}),
b{k + 1} as (select bx - (g1 * (h22 * h33 - h23 * h23) - h12 * (g2 * h33 - h23 * g3) + h13 * (g2 * h23 - h22 * g3)) / det as x,
   by_ - (h11 * (g2 * h33 - h23 * g3) - g1 * (h12 * h33 - h23 * h13) + h13 * (h12 * g3 - g2 * h13)) / det as y,
   bz - (h11 * (h22 * g3 - g2 * h23) - h12 * (h12 * g3 - g2 * h13) + g1 * (h12 * h23 - h22 * h13)) / det as z from d{k})"""
    return sql + "\n" + " union all ".join(f"select '{n}' as name, round({v}, 6) as coefficient from b{steps}"
                                           for n, v in (("constant", "x"), ("age", "y"), ("score", "z")))


SQL["logistic_steps"] = logistic_sql(3, 0.1)

SQL["anova_f_edges"] = with_(LOANS) + """, x as (select "Default" y, (ID % 7 + 100000000)::double large_mean, (ID % 7)::double small_mean,
   "Default" * 3.0::double separator, 5.0::double as constant from loans),
long as (unpivot x on large_mean, small_mean, separator, constant into name "column" value value),
g as (select "column", y, count(value) n, avg(value) m, var_pop(value) v from long group by 1, 2),
o as (select "column", sum(n * m) / sum(n) as all_m from g group by 1),
a as (select "column", sum(n) N, count(*) k, sum(n * v) ssw, sum(n * (m - all_m) * (m - all_m)) ssb from g join o using ("column") group by 1),
f as (select "column", case when ssw > 0 then (ssb / (k - 1)) / (ssw / (N - k)) when ssb > 0 then 'inf'::double end as f from a)
select "column", round(f, 6) as f_score, row_number() over (order by f desc nulls last, "column") as rank,
 f is not null and row_number() over (order by f desc nulls last, "column") <= 2 as selected from f"""

SQL["rank_models"] = with_(LOANS) + """, g as (select Client_Education as Model, avg("Default") p, avg(House_Own) auc, avg(Bike_Owned) f1,
   avg(Car_Owned) - avg(House_Own) gap from loans where Client_Education is not null group by 1),
s as (select *, 0.4 * auc + 0.3 * f1 + 0.2 * p + (-0.1) * gap as score from g)
select Model, round(p, 6) as Test_Precision, round(auc, 6) as Test_ROC_AUC, round(f1, 6) as Test_F1, round(gap, 6) as Overfitting_Gap,
 case when gap < 0.05 then 'green' when gap < 0.15 then 'amber' else 'red' end as Gap_Status, round(score, 6) as Composite_Score,
 row_number() over (order by score desc, Model)::int as Rank from s"""

SQL["duplicate_rows_coarse"] = with_(LOANS) + """
select (count(*) - (select count(*) from (select distinct "Default", Bike_Owned, Child_Count, Client_Income_Type from loans)))::bigint
 as duplicate_rows from loans"""

SQL["undersample_train"] = with_train() + f""",
r as (select ID, "Default", row_number() over (partition by "Default" order by {_HASH}, ID) rk,
   (select count(*) from train where "Default" = 1) n1 from train)
select ID, "Default" from r where "Default" = 1 or rk <= floor(n1 / 0.3)"""

SQL["class_weights"] = with_train() + """
select "Default", count(*)::bigint as n_c, round((select count(*) from train) / (2.0 * count(*)), 6) as weight
from train group by 1"""


# ---------------------------------------------------------------- evaluation on the labelled log

_CONF = """c as (select count(*) filter (where actual_outcome = 1 and prediction = 1) tp,
   count(*) filter (where actual_outcome = 0 and prediction = 1) fp,
   count(*) filter (where actual_outcome = 1 and prediction = 0) fn,
   count(*) filter (where actual_outcome = 0 and prediction = 0) tn from lab where actual_outcome is not null)"""

SQL["classification_metrics"] = with_log() + ", " + _CONF + """
select tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn,
 round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0.0), 6) as accuracy,
 round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) as "precision",
 round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) as recall,
 round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) as f1_score from c"""

SQL["confusion_matrix"] = with_log() + ", " + _CONF + """
select 0 as actual, 0 as predicted, tn::bigint as n from c union all select 0, 1, fp from c
union all select 1, 0, fn from c union all select 1, 1, tp from c"""

SQL["classification_report"] = with_log() + ", " + _CONF + """,
per as (select '0' as label, coalesce(tn / nullif(tn + fn, 0), 0.0) p, coalesce(tn / nullif(tn + fp, 0), 0.0) r,
   coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0.0) f, (tn + fp)::double s from c
 union all
 select '1', coalesce(tp / nullif(tp + fp, 0), 0.0), coalesce(tp / nullif(tp + fn, 0), 0.0),
   coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), (tp + fn)::double from c)
select label, round(p, 6) as "precision", round(r, 6) as recall, round(f, 6) as f1_score, round(s, 6) as support from per
union all
select 'accuracy', null, null, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0.0), 6),
  (tp + fp + fn + tn)::double from c
union all
select 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(s) from per
union all
select 'weighted avg', round(coalesce(sum(p * s) / nullif(sum(s), 0), 0.0), 6),
  round(coalesce(sum(r * s) / nullif(sum(s), 0), 0.0), 6), round(coalesce(sum(f * s) / nullif(sum(s), 0), 0.0), 6),
  sum(s) from per"""

_SWEEP = with_log() + """,
t as (select 0.1::double + i * ((0.1::double + 0.05::double) - 0.1::double) as threshold from range(0, 16) r(i)),
sw as (select threshold,
   count(*) filter (where actual_outcome = 1 and probability >= threshold) tp,
   count(*) filter (where actual_outcome = 0 and probability >= threshold) fp,
   count(*) filter (where actual_outcome = 1 and probability < threshold) fn,
   count(*) filter (where actual_outcome = 0 and probability < threshold) tn
   from t, lab where actual_outcome is not null group by threshold),
m as (select *, coalesce(tp / nullif(tp + fp, 0), 0.0) p, coalesce(tp / nullif(tp + fn, 0), 0.0) r,
   coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) f1,
   coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0.0) acc from sw)
"""

SQL["threshold_sweep"] = _SWEEP + """
select round(threshold, 6) as threshold, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn,
 round(acc, 6) as accuracy, round(p, 6) as "precision", round(r, 6) as recall, round(f1, 6) as f1_score,
 round(0.7 * p + 0.3 * f1, 6) as business_score from m"""

SQL["threshold_choice"] = _SWEEP + """,
u as (select 'precision_first' as strategy, *, (p >= 0.25)::int mt, case when p >= 0.25 then f1 else p end sc from m
      union all
      select 'balanced', *, (p >= 0.20)::int, f1 from m)
select strategy, round(threshold, 6) as threshold, round(p, 6) as "precision", round(r, 6) as recall,
 round(f1, 6) as f1_score, mt = 1 as meets_target
from u qualify row_number() over (partition by strategy order by mt desc, sc desc, threshold) = 1"""


# ---------------------------------------------------------------- drift, alerts, health

def _ks(col: str, name: str) -> str:
    return f"""ks_{name} as (select max(abs(f1 - f0)) d, any_value(n1) n1, any_value(n0) n0 from (
   select sum(r) over (order by v) / n1 f1, sum(1 - r) over (order by v) / n0 f0, n1, n0
   from (select {col} v, r from u where {col} is not null) x,
        (select sum(r)::double n1, sum(1 - r)::double n0 from u where {col} is not null) t))"""


def _kpv(src: str) -> str:
    lam = f"(sqrt({src}.n1 * {src}.n0 / ({src}.n1 + {src}.n0)) * {src}.d)"
    series = (f"list_sum(list_transform(range(1, 101), lambda k: 2.0 * (case when k % 2 = 1 then 1.0 else -1.0 end)"
              f" * exp(-2.0 * k * k * {lam} * {lam})))")
    return (f"(case when greatest({src}.n1, {src}.n0) <= 10000 then (select p_value from exact_{src})"
            f" when {lam} < 0.2 then 1.0 else least(greatest({series}, 0.0), 1.0) end)")


def _exact(src: str) -> str:
    """The chance that a random merged order leaves the band |i / n1 - j / n0| < d, a diagonal of the lattice at a time."""
    return f"""band_{src} as (select *, n1 + n0 as nn, round(d * (n1 / gcd(n1, n0)) * n0)::bigint * gcd(n1, n0) as w
   from (select n1::bigint n1, n0::bigint n0, d from {src})),
walk_{src} as (select 0::bigint as s, 0::bigint as lo, [1.0::double] as p from band_{src} where w > 0 and greatest(n1, n0) <= 10000
   union all
   select s + 1, lo2, [coalesce(p[i - lo + 1], 0.0) * (n0 - (s - i)) / (nn - s) + coalesce(p[i - lo], 0.0) * (n1 - (i - 1)) / (nn - s)
     for i in range(lo2, hi2 + 1)]
   from (select *, greatest(0, s + 1 - n0, floor(((s + 1) * n1 - w) / nn)::bigint + 1) as lo2,
     least(n1, s + 1, ceil(((s + 1) * n1 + w) / nn)::bigint - 1) as hi2 from walk_{src}, band_{src} where s < nn)),
exact_{src} as (select case when w = 0 then 1.0 else greatest(0.0, 1 - coalesce((select list_sum(p) from walk_{src} order by s desc limit 1), 0.0)) end as p_value
   from band_{src})"""


DRIFT = f"""u as (select probability, processing_time_ms,
   ("timestamp" >= {AS_OF} - interval 7 day)::int r from lab where "timestamp" >= {AS_OF} - interval 30 day),
cnt as (select count(*) filter (where r = 1) rs, count(*) filter (where r = 0) bs,
   count(*) filter (where r = 1 and processing_time_ms is not null) rl from u),
{_ks('probability', 'p')},
{_ks('processing_time_ms', 'l')},
{_exact('ks_p')}, {_exact('ks_l')},
dr as (select 'probability_drift' as metric, ks_p.d, {_kpv('ks_p')} as pv, rs, bs from cnt, ks_p where rs >= 10 and bs >= 10
   union all
   select 'processing_time_drift', ks_l.d, {_kpv('ks_l')}, rs, bs from cnt, ks_l where rs >= 10 and bs >= 10 and rl > 5),
drift as (select metric, d, pv, pv < 0.05 as detected,
   case when pv < 0.01 then 'HIGH' when pv < 0.05 then 'MEDIUM' else 'LOW' end as severity, rs, bs from dr)"""

SQL["drift_7d_vs_30d"] = with_log() + ", " + DRIFT + """
select metric, round(d, 6) as ks_statistic, round(pv, 6) as p_value, detected as drift_detected, severity,
 rs::bigint as recent_samples, bs::bigint as baseline_samples from drift"""

MON = DRIFT + f""",
w7 as (select * from lab where "timestamp" >= {AS_OF} - interval 7 day),
k7 as (select count(*) n, avg(processing_time_ms) lat, count(*) filter (where actual_outcome is not null) labeled,
   count(*) filter (where actual_outcome = 1 and prediction = 1) tp,
   count(*) filter (where actual_outcome = 0 and prediction = 1) fp,
   count(*) filter (where actual_outcome = 1 and prediction = 0) fn from w7),
k7m as (select *, case when labeled > 0 then coalesce(tp / nullif(tp + fp, 0), 0.0) end prec,
   case when labeled > 0 then coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) end f1,
   n / 7.0 cur, (select count(*) from lab where "timestamp" >= {AS_OF} - interval 30 day) / 30.0 hist from k7),
al as (
 select 'PERFORMANCE_DEGRADATION' as type, 'HIGH' as severity,
   'Precision dropped to ' || printf('%.1f%%', prec * 100) || ' (below 35.0%)' as message, prec as value,
   0.35 as threshold from k7m where prec < 0.35
 union all
 select 'F1_SCORE_LOW', 'MEDIUM', 'F1-score dropped to ' || printf('%.1f%%', f1 * 100) || ' (below 20.0%)', f1, 0.20
   from k7m where f1 < 0.20
 union all
 select 'SLOW_RESPONSE_TIME', 'MEDIUM', 'Average response time: ' || printf('%.1f', lat) || 'ms (above 500ms)', lat,
   500.0 from k7m where lat > 500
 union all
 select 'VOLUME_ANOMALY', 'MEDIUM', 'Prediction volume changed by ' || printf('%.1f%%', abs(cur - hist) / hist * 100)
   || ' (current: ' || printf('%.1f', cur) || '/day, historical: ' || printf('%.1f', hist) || '/day)',
   abs(cur - hist) / hist, 0.30 from k7m where hist <> 0 and abs(cur - hist) / hist > 0.30
 union all
 select 'DATA_DRIFT', severity, 'Data drift detected in ' || replace(metric, '_', ' ') || ' (p-value: '
   || printf('%.4f', pv) || ')', null, null from drift where detected)"""

SQL["alerts_7d"] = with_log() + ", " + MON + """
select type, severity, message, round(value, 6) as value, round(threshold, 6) as threshold from al"""

SQL["health_check"] = with_log() + ", " + MON + f""",
rr as (select count(*) filter (where decision = 'REVIEW') / count(*) mrr from lab
   where "timestamp" >= {AS_OF} - interval 30 day),
h as (select (select n from k7m) n, (select count(*) from al) na, (select count(*) from drift where detected) nd,
   (select mrr from rr) mrr)
select case when n = 0 then 'ERROR' when na > 0 or nd > 0 then 'WARNING' else 'HEALTHY' end as overall_status,
 na::bigint as active_alerts, nd::bigint as drifted_metrics,
 case when na = 0 and not coalesce(mrr > 0.3, false) then 'System operating normally - continue monitoring'
      else concat_ws('; ', case when na > 0 then 'Review and address active alerts' end,
                     case when mrr > 0.3 then 'High manual review rate - consider threshold optimization' end) end
   as recommendations
from h"""

SQL["model_status"] = with_log() + ", " + MON + """,
s as (select 100 - case when prec < 0.35 then 30 else 0 end - case when f1 < 0.20 then 20 else 0 end
   - case when lat > 200 then 10 else 0 end - 15 * (select count(*) from drift where detected) as score,
   concat_ws('; ', case when prec < 0.35 then 'Precision below target (35%)' end,
     case when f1 < 0.20 then 'F1-score below minimum (20%)' end,
     case when lat > 200 then 'Slow response times' end,
     (select string_agg('Data drift detected in ' || metric, '; ' order by metric) from drift where detected)) as warnings,
   n, (select count(*) from drift where detected) > 0 as dd from k7m)
select case when score >= 90 then 'EXCELLENT' when score >= 75 then 'GOOD' when score >= 60 then 'WARNING'
   else 'CRITICAL' end as model_status, score::int as health_score, warnings,
 n::bigint as predictions_last_7_days, round(n / 7.0, 6) as avg_daily_volume, dd as data_drift_detected from s"""

SQL["alert_cooldown"] = """
with recursive a as (select event_id, concat('T', (user_id % 3)::varchar) ty, ts,
   row_number() over (partition by user_id % 3 order by ts, event_id) rn from events where event_type = 'error'),
r as (select event_id, ty, ts, rn, ts as last, true as sent from a where rn = 1
   union all
   select a.event_id, a.ty, a.ts, a.rn,
     case when a.ts - r.last >= interval 60 minute then a.ts else r.last end,
     a.ts - r.last >= interval 60 minute
   from r join a on a.ty = r.ty and a.rn = r.rn + 1)
select event_id as alert_id, ty as type, sent from r"""


# ---------------------------------------------------------------- reports

def roi(days: int) -> str:
    return (SQL["roi_30d"].replace("interval 30 day", f"interval {days} day")
            .replace("select 30 as period_days", f"select {days} as period_days")
            .replace("n / 30.0", f"n / {days}.0"))


def _long(src: str, items, names=("section", "metric", "value")) -> str:
    return " union all ".join(
        f"select '{a}' as {names[0]}, '{b}' as {names[1]}, ({e})::double as {names[2]} from {src}" for a, b, e in items)


_EXEC = [("kpi", "total_predictions", "total_predictions"), ("kpi", "automation_rate", "automation_rate"),
         ("kpi", "manual_review_rate", "manual_review_rate"),
         ("kpi", "avg_processing_time_ms", "avg_processing_time_ms"),
         ("financial", "defaults_prevented", "defaults_prevented"),
         ("financial", "default_cost_prevented", "default_cost_prevented"),
         ("financial", "net_savings", "net_savings"),
         ("baseline", "current_precision", "current_precision"),
         ("baseline", "baseline_precision", "case when labeled_sample_size > 0 then 0.161 end"),
         ("baseline", "precision_improvement", "precision_improvement"),
         ("operations", "daily_prediction_volume", "daily_prediction_volume"),
         ("operations", "total_operational_cost", "total_operational_cost"),
         ("operations", "cost_per_prediction", "total_operational_cost / nullif(total_predictions, 0)")]


def _exec(days: int) -> str:
    return (f"select section, metric, round(value, 6) as value from ({_long(f'({roi(days)}) roi', _EXEC)}) "
            f"where value is not null or section = 'kpi'")


SQL["executive_summary_30d"] = _exec(30)

_DAILY = [("volume", "total_predictions", "total_predictions"), ("volume", "approval_rate", "approval_rate"),
          ("volume", "rejection_rate", "rejection_rate"), ("volume", "review_rate", "review_rate"),
          ("risk", "avg_probability", "avg_probability"), ("model", "precision", '"precision"'),
          ("model", "recall", "recall"), ("model", "f1_score", "f1_score"),
          ("model", "labeled_samples", "case when labeled_samples > 0 then labeled_samples end"),
          ("system", "avg_processing_time_ms", "avg_processing_time_ms"),
          ("trends", "drifted_metrics", "drifted_metrics")]

SQL["daily_report"] = _exec(1) + " union all " + \
    f"select section, metric, round(value, 6) from ({_long(f'({kpis(1)}) k, (select count(*) filter (where drift_detected) drifted_metrics from (' + SQL['drift_7d_vs_30d'] + ')) dd', _DAILY)}) " \
    "where value is not null or section in ('volume', 'trends')"

_DASH = [("decision", "APPROVE", "approval_rate"), ("decision", "REJECT", "rejection_rate"),
         ("decision", "REVIEW", "review_rate"), ("risk", "low_risk", "low_risk"),
         ("risk", "medium_risk", "medium_risk"), ("risk", "high_risk", "high_risk"),
         ("confidence", "HIGH", "conf_high"), ("confidence", "MEDIUM", "conf_medium"),
         ("confidence", "LOW", "conf_low"), ("volume", "daily_average", "total_predictions / 7.0"),
         ("quality", "precision", '"precision"'), ("quality", "recall", "recall"), ("quality", "f1_score", "f1_score")]

SQL["dashboard_7d"] = (f"select panel, label, round(value, 6) as value from "
                       f"({_long(f'({kpis(7)}) k', _DASH, ('panel', 'label', 'value'))}) "
                       "where value is not null and (panel <> 'confidence' or value > 0)")

SQL["monitoring_summary"] = f"""
select h.overall_status, h.active_alerts, h.recommendations,
 k.total_predictions as predictions_7d, k.approval_rate as approval_rate_7d, k.avg_probability as avg_probability_7d,
 k.avg_processing_time_ms as avg_processing_time_ms_7d, k."precision", k.recall, k.f1_score, k.roc_auc,
 k.labeled_samples, r.total_predictions as predictions_30d, r.automation_rate as automation_rate_30d,
 r.net_savings as net_savings_30d
from ({SQL['health_check']}) h, ({kpis(7)}) k, ({roi(30)}) r"""

SQL["alert_history"] = SQL["alert_cooldown"].replace(
    "select event_id as alert_id, ty as type, sent from r",
    """select event_id as alert_id, ty as type, ts as "timestamp", (select count(*) from r where sent) as total_alerts
from r where sent order by ts desc, event_id desc limit 20""")


# ---------------------------------------------------------------- validation and scoring

APP_RULES = [("Credit_Amount", 0, 1000000, False), ("Client_Income_Type", 0, 10, True),
             ("Client_Education", 0, 10, True), ("Client_Gender", 0, 2, True), ("Age_Days", 0, 50000, True),
             ("Employed_Days", 0, 20000, True), ("Registration_Days", 0, 10000, True),
             ("ID_Days", 0, 10000, True), ("Cleint_City_Rating", 1, 5, True),
             ("Client_Permanent_Match_Tag", 0, 1, True), ("Type_Organization", 0, 20, True),
             ("Score_Source_1", 0, 1, False), ("Score_Source_2", 0, 1, False), ("Score_Source_3", 0, 1, False),
             ("Phone_Change", 0, 10, True), ("Age_Years", 18, 100, True), ("Employment_Years", 0, 50, True),
             ("Average_External_Score", 0, 1, False), ("Max_External_Score", 0, 1, False),
             ("Min_External_Score", 0, 1, False)]
APP_FIELDS = [r[0] for r in APP_RULES]

APPS = """
apps as (select f.ID, o.o_orderdate as received_at,
  coalesce(nullif(case when f.ID % 10 = 0 then null when f.ID % 10 = 1 then '' else 'cust_' || f.ID::varchar end, ''),
           'customer_' || strftime(o.o_orderdate, '%Y%m%d_%H%M%S_%f')[1:17]) as customer_id,
  Credit_Amount, (f.ID % 12)::int Client_Income_Type, (f.ID % 11)::int Client_Education, (f.ID % 3)::int Client_Gender,
  trunc(abs(Age_Days))::int Age_Days, trunc(Employed_Days)::int Employed_Days, ((f.ID * 7) % 10500)::int Registration_Days,
  ((f.ID * 3) % 10000)::int ID_Days, (f.ID % 6)::int Cleint_City_Rating, (f.ID % 2)::int Client_Permanent_Match_Tag,
  (f.ID % 21)::int Type_Organization, Score_Source_1, Score_Source_2, Score_Source_3, (f.ID % 11)::int Phone_Change,
  trunc(Age_Years)::int Age_Years, trunc(Employment_Years)::int Employment_Years,
  Average_External_Score, Max_External_Score, Min_External_Score
 from feat f join orders o on o.o_orderkey = f.ID)"""


def _rule_sql(f: str, lo, hi, integral: bool) -> str:
    x = f"{q(f)}::double"
    parts = [f"when {q(f)} is null or isnan({x}) then '{f}: required'",
             f"when {x} < {lo} or {x} > {hi} then '{f}: outside [{lo}, {hi}]'"]
    if integral:
        parts.append(f"when {x} <> floor({x}) then '{f}: not an integer'")
    return "case " + " ".join(parts) + " end"


VAPPS = APPS + ",\nvapps as (select *, list_filter([" + ", ".join(_rule_sql(*r) for r in APP_RULES) + \
    "], lambda e: e is not null) as errs from apps)"

SQL["application_validation"] = with_feat() + ", " + VAPPS + """
select ID, customer_id, len(errs) = 0 as is_valid, len(errs) as n_errors, array_to_string(errs, '; ') as errors
from vapps"""

_ML_ORDER = [c for c in FEAT_COLUMNS if c not in ("ID", "Default")]
SQL["aligned_applications"] = with_feat() + ", " + VAPPS + "\nselect ID, " + ", ".join(
    f"round(coalesce({q(c)}::double, 0.0), 6) as {q(c)}" if c in APP_FIELDS else f"0.0 as {q(c)}"
    for c in _ML_ORDER) + " from vapps where len(errs) = 0"

SQL["score_decisions"] = with_(RAW_PREDICTIONS) + """
select id, round(probability, 6) as probability,
 (probability >= 0.6500000000000001)::int as prediction,
 case when probability <= 0.15 then 'APPROVE' when probability <= 0.25 then 'APPROVE'
      when probability <= 0.40 then 'REVIEW' else 'REJECT' end as decision,
 case when probability <= 0.15 then 'HIGH' when probability <= 0.25 then 'MEDIUM'
      when probability <= 0.40 then 'MEDIUM' else 'HIGH' end as confidence_level,
 customer_id is not null and probability between 0 and 1 as is_valid
from raw_predictions"""

SQL["feedback_validation"] = with_(FEEDBACK) + """
select feedback_id, customer_id is not null and actual_outcome in (0, 1) as is_valid,
 (customer_id is null)::int + (actual_outcome is null or actual_outcome not in (0, 1))::int as n_errors from feedback"""

SQL["features_json_roundtrip"] = with_feat() + ", " + VAPPS + "\nselect ID, " + ", ".join(
    f"round({q(c)}, 6) as {q(c)}" if not r[3] else q(c) for c, r in zip(APP_FIELDS, APP_RULES)) + \
    " from vapps where len(errs) = 0"


# ---------------------------------------------------------------- oversampling

KNN = """
mino as (select vec_id id, embedding v,
   row_number() over (order by ('0x' || substr(md5('42|' || vec_id::varchar), 1, 8))::bigint, vec_id) base_no
   from embeddings where label = 0),
pairs as (select a.id, b.id nid,
   list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double))) d
   from mino a, mino b where a.id <> b.id),
knn as (select id, row_number() over (partition by id order by d, nid) nn_rank, nid, d from pairs qualify nn_rank <= 3)"""

SQL["knn_minority_embeddings"] = with_(KNN) + """
select id, nn_rank::int as nn_rank, nid as neighbor_id, round(d, 6) as sq_dist from knn"""


def _h(tag: str, digits: int = 8) -> str:
    return f"('0x' || substr(md5('42|' || i::varchar || '|{tag}'), 1, {digits}))::bigint"


SQL["smote_embeddings"] = with_(KNN) + f""",
cnt as (select count(*) filter (where label = 0) m, count(*) filter (where label <> 0) nmaj from embeddings),
idx as (select unnest(range(0, greatest(floor(nmaj / 3.0)::bigint - m, 0))) i, m from cnt),
syn as (select i syn_id, {_h('b', 15)} % m + 1 base_no, {_h('n')} % least(3, m - 1) + 1 nn_rank,
   {_h('g')} / 4294967296.0 gap from idx),
v as (select s.syn_id, list_transform(list_zip(b.v, n.v), lambda x: x[1]::double + s.gap * (x[2]::double - x[1]::double)) vec
   from syn s join mino b on b.base_no = s.base_no
   join knn k on k.id = b.id and k.nn_rank = s.nn_rank join mino n on n.id = k.nid)
select syn_id, unnest(range(0, len(vec)))::int as dim, round(unnest(vec), 6) as value from v"""


# ---------------------------------------------------------------- streaming

_DAILY_PARTIALS = """daily as (select cast("timestamp" as date) as day, count(*) total_predictions,
   count(*) filter (where decision = 'APPROVE') approved, count(*) filter (where decision = 'REJECT') rejected,
   count(*) filter (where decision = 'REVIEW') reviews, sum(probability) sum_probability,
   sum(processing_time_ms) sum_latency, count(processing_time_ms) n_latency from scored group by 1)"""

_FINISH_DAILY = """select day, total_predictions::bigint as total_predictions,
 round(approved / total_predictions, 6) as approval_rate, round(rejected / total_predictions, 6) as rejection_rate,
 round(reviews / total_predictions, 6) as review_rate, round(sum_probability / total_predictions, 6) as avg_probability,
 round(sum_latency / nullif(n_latency, 0), 6) as avg_processing_time_ms"""

# The last day is still open: no later event has closed it.
SQL["stream_daily_kpis"] = with_(RAW_PREDICTIONS, SCORED, _DAILY_PARTIALS) + _FINISH_DAILY + \
    ", day < (select max(day) from daily) as closed from daily"

SQL["sliding_7d_kpis"] = with_(RAW_PREDICTIONS, SCORED, _DAILY_PARTIALS) + """,
s as (select day, """ + ", ".join(
    f"sum({c}) over (order by day range between interval 6 day preceding and current row) as {c}"
    for c in ["total_predictions", "approved", "rejected", "reviews", "sum_probability", "sum_latency", "n_latency"]) + \
    " from daily)\n" + _FINISH_DAILY + " from s"

SQL["stream_sliding_7d_kpis"] = SQL["sliding_7d_kpis"]

SQL["stream_alert_cooldown"] = SQL["alert_cooldown"]

SQL["loans_csv_roundtrip"] = SQL["loans_typed"]
SQL["alert_log_roundtrip"] = SQL["alerts_7d"]


# ---------------------------------------------------------------- the shifted log

_RECENT = f"ts >= {AS_OF} - interval 7 day"
_SHIFTED_P = f"""(case when {_RECENT} then least(least(value / 200.0::double, 1.0::double) * 1.5::double + 0.2::double, 1.0::double)
   else least(value / 200.0::double, 1.0::double) end)"""
RAW_SHIFTED = f"""
moved as (
 select * replace (case when {_RECENT} or event_id % 4 = 0 then ts
   else {AS_OF} - interval 7 day + to_days((event_id % 7)::int) + (ts - date_trunc('day', ts)) end as ts)
 from events where event_type in ('view','click','signup')),
raw_predictions as (
 select event_id as id, ts as "timestamp", concat('customer_', cast(user_id as varchar)) as customer_id,
  {_SHIFTED_P} as probability, cast({_SHIFTED_P} >= 0.5::double as int) as prediction,
  case when regexp_extract(props,'([0-9]+)',1) in ('7','77') then null
       else cast(regexp_extract(props,'([0-9]+)',1) as double) * 6 * (case when {_RECENT} then 20 else 1 end) end as processing_time_ms
 from moved)"""
FEEDBACK_SHIFTED = FEEDBACK.replace("cast(event_type = 'error' as int) as actual_outcome",
                                    "cast(event_type = 'error' and event_id % 10 = 0 as int) as actual_outcome")

for _name in ("alerts_7d", "drift_7d_vs_30d", "health_check", "model_status"):
    SQL[{"alerts_7d": "alerts_shifted", "drift_7d_vs_30d": "drift_shifted"}.get(_name, f"{_name}_shifted")] = \
        SQL[_name].replace(RAW_PREDICTIONS, RAW_SHIFTED).replace(FEEDBACK, FEEDBACK_SHIFTED)

SQL["monitor_kpis_7d_counts"] = SQL["monitor_kpis_7d"]
# Averages of a day's few scores can end in a 5 at the seventh digit, where the order of adding shows.
SQL["daily_snapshot_batches"] = SQL["daily_snapshot"].replace("round(conf, 6)", "round(conf, 9)")
SQL["committed_log_7d"] = with_log() + f"""
select date, batch_id::bigint as batch_id, count(*)::bigint as n, sum(id)::bigint as ids from (
 select "timestamp"::date as date, id % 3 as batch_id, id from lab where "timestamp" >= {AS_OF} - interval 7 day) group by all"""

SQL["feedback_breaches"] = with_(FEEDBACK) + """,
b as (select feedback_id, case when feedback_id % 7 <> 0 then customer_id end as c,
   case when feedback_id % 5 = 0 then 2 when feedback_id % 11 <> 0 then actual_outcome end as o from feedback)
select feedback_id, c is not null and coalesce(o in (0, 1), false) as is_valid,
 ((c is null)::int + (not coalesce(o in (0, 1), false))::int)::int as n_errors from b"""

SQL["prediction_breaches"] = with_(RAW_PREDICTIONS) + """,
b as (select id, case when id % 7 <> 0 then customer_id end as c, id % 13 = 0 as hold,
   case when id % 9 = 0 then -probability - 0.5 when id % 10 = 0 then probability + 1.5 when id % 11 <> 0 then probability end as p
   from raw_predictions),
e as (select id, (c is null)::int + (p is null or p < 0 or p > 1)::int + hold::int + (p is null)::int as n from b)
select id, n = 0 as is_valid, n::int as n_errors from e"""

SQL["health_check_silent"] = with_log() + f"""
select case when count(*) = 0 then 'ERROR' else 'HEALTHY' end as overall_status, 0::bigint as active_alerts, 0::bigint as drifted_metrics,
 'System operating normally - continue monitoring' as recommendations from lab where "timestamp" >= {AS_OF} + interval 53 day"""

SQL["processed_summary"] = with_ml() + f"""
select count(*) as n_rows, {len(_ML_FEATURES) + 1}::int as n_columns, count(*) filter ("Default" = 0) as n_0, count(*) filter ("Default" = 1) as n_1,
 round(count(*) filter ("Default" = 0) / nullif(count(*) filter ("Default" = 1), 0), 6) as imbalance_ratio,
 coalesce(count(*) filter ("Default" = 0) / nullif(count(*) filter ("Default" = 1), 0) > 20, count(*) filter ("Default" = 0) > 0) as severe_imbalance
from ml"""

_OPT = ("(values ('Base Model', 0, 0.5::double), ('Threshold Optimized', 1, 0.65), ('Sampling: No Sampling', 2, 0.3), "
        "('Sampling: Conservative SMOTE (4:1)', 3, 0.45), ('Sampling: SMOTE (2:1)', 4, 0.6), ('Sampling: Random Undersampling', 5, 0.75), "
        "('Hyperparameter Tuned', 6, 0.7)) v(configuration, ord, t)")
SQL["tuning_report"] = with_log() + f""",
c as (select configuration, ord, count(*) filter (actual_outcome = 1 and probability >= t) tp,
   count(*) filter (actual_outcome = 0 and probability >= t) fp, count(*) filter (actual_outcome = 1 and probability < t) fn
   from {_OPT}, lab where actual_outcome is not null group by 1, 2),
m as (select configuration, ord, coalesce(tp / nullif(tp + fp, 0), 0.0) as p, coalesce(tp / nullif(tp + fn, 0), 0.0) as r,
   coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) as f from c),
s as (select * from m where ord not between 2 and 5 or ord = (select ord from m where ord between 2 and 5 order by p desc, ord limit 1)),
best as (select configuration as b, p as bp from m where ord in (0, 1, 6) order by p desc, ord limit 1),
base as (select p as p0 from m where ord = 0)
select configuration, round(p, 6) as "precision", round(r, 6) as recall, round(f, 6) as f1_score, b as best_configuration,
 round(bp, 6) as best_precision, configuration = b as is_best, round(bp - p0, 6) as precision_gain,
 round((bp - p0) / nullif(p0, 0), 6) as relative_gain, bp >= 0.25 as target_met from s, best, base"""

# The exact drift test walks a lattice, in statements that may stand inside others.
SQL = {k: re.sub(r"\bwith (?=\s*(?:raw_predictions|moved) as)", "with recursive ", v) if "walk_ks_" in v else v for k, v in SQL.items()}
