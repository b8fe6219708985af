"""SQL for DuckDB that gives the same results, written straight from what each report means."""

from __future__ import annotations

from carequeue.plans.actions import SUMMARY_TEXT
from carequeue.plans.questions import ROUTES
from carequeue.plans.quality import RULES
from checks.queries import ASKED as QUESTIONS

AS_OF = "DATE '2001-08-01'"

ROLES = f"""
referral AS (
  SELECT o_orderkey AS referral_id, o_custkey AS patient_id, CAST(o_orderdate AS DATE) AS created,
         CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 22 AS INTEGER) END AS reviewed,
         CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS state,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS closure_reason,
         o_orderpriority AS priority
  FROM orders),
visit AS (
  SELECT l_orderkey * 10 + l_linenumber AS appointment_id, l_orderkey AS referral_id, l_suppkey AS provider_id,
         s_nationkey AS clinic_id, CAST(l_shipdate AS DATE) AS day,
         CAST(l_shipdate AS DATE) - CAST(l_quantity AS INTEGER) AS planned,
         CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'no_show'
              ELSE CASE WHEN l_linenumber % 2 = 1 THEN 'canceled' ELSE 'rescheduled' END END AS outcome,
         CASE WHEN l_linestatus = 'O' THEN 'telehealth' ELSE 'in_person' END AS mode,
         p_type AS kind
  FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey),
person AS (
  SELECT c_custkey AS patient_id,
         CASE WHEN c_acctbal < 0 THEN '18-25' WHEN c_acctbal < 2500 THEN '26-35' WHEN c_acctbal < 5000 THEN '36-50'
              WHEN c_acctbal < 7500 THEN '51-64' ELSE '65+' END AS age_group,
         c_mktsegment AS insurance_type,
         CASE c_custkey % 4 WHEN 0 THEN 'English' WHEN 1 THEN 'Spanish' WHEN 2 THEN 'Polish' ELSE 'Other' END
           AS preferred_language,
         c_acctbal < 0 AS transportation_risk_flag, c_custkey % 9 AS prior_no_show_count,
         CAST(c_nationkey AS VARCHAR) AS zip_code
  FROM customer),
provider AS (
  SELECT s_suppkey AS provider_id, s_name AS provider_name, s_nationkey AS home_clinic,
         CASE WHEN s_acctbal >= 5000 THEN 'Therapist' ELSE 'Social Worker' END AS provider_type,
         20 + s_suppkey % 16 AS slots
  FROM supplier),
clinic AS (
  SELECT n_nationkey AS clinic_id, n_name AS clinic_name, r_name AS clinic_group,
         CAST(50 + 5 * (n_nationkey % 10) AS BIGINT) AS slots
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey),
area AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS zip_code, n_name AS area_name,
         avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END) AS transportation,
         avg(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1.0 ELSE 0.0 END) AS underinsured,
         avg(CASE WHEN c_mktsegment = 'FURNITURE' THEN 1.0 ELSE 0.0 END) AS language
  FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY ALL),
encounter AS (
  SELECT l_orderkey * 10 + l_linenumber AS encounter_id FROM lineitem WHERE l_returnflag = 'A'),
followup AS (
  SELECT event_id * 10 + 1 AS encounter_id, event_type = 'purchase' AS done FROM events),
linked AS (
  SELECT v.*, r.patient_id, r.created, r.state, r.priority, date_diff('day', r.created, v.day) AS lag,
         p.age_group, p.insurance_type, p.preferred_language, p.transportation_risk_flag, p.prior_no_show_count,
         p.zip_code, c.clinic_name, c.clinic_group, c.slots,
         r.state = 'open' AND date_diff('day', r.created, {AS_OF}) > 21 AS aged
  FROM visit v JOIN referral r USING (referral_id) JOIN person p ON p.patient_id = r.patient_id
       JOIN clinic c ON c.clinic_id = v.clinic_id)"""

COMPLETED = "count(*) FILTER (outcome = 'completed')"
NO_SHOWS = "count(*) FILTER (outcome = 'no_show')"
VISITS = "count(appointment_id)"
WINDOW = (
    "day BETWEEN DATE '1997-07-01' AND DATE '1999-06-30' AND insurance_type IN ('BUILDING', 'HOUSEHOLD', 'MACHINERY')"
)
PRIOR = (
    "day BETWEEN DATE '1995-07-02' AND DATE '1997-06-30' AND insurance_type IN ('BUILDING', 'HOUSEHOLD', 'MACHINERY')"
)


def pct(part: str, whole: str) -> str:
    return f"round(100.0::DOUBLE * ({part}) / nullif({whole}, 0), 2)"


def share(name: str) -> str:
    return f"({name} / nullif(max({name}) OVER (), 0))"


def query(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([ROLES, *ctes]) + "\n" + body


FRICTION = [
    f"""area_facts AS (
  SELECT z.*, CAST(count(DISTINCT r.referral_id) AS BIGINT) AS referral_volume,
         median(date_diff('day', r.created, v.day)) AS lag, {pct(NO_SHOWS, VISITS)} AS no_show_rate_pct,
         {pct(f"count(*) FILTER (r.state = 'open' AND date_diff('day', r.created, {AS_OF}) > 21)",
              "count(DISTINCT r.referral_id)")} AS open_rate,
         {pct("count(*) FILTER (mode = 'telehealth')", VISITS)} AS tele_rate
  FROM area z LEFT JOIN person p USING (zip_code) LEFT JOIN referral r ON r.patient_id = p.patient_id
       LEFT JOIN visit v ON v.referral_id = r.referral_id
  GROUP BY z.zip_code, z.area_name, z.transportation, z.underinsured, z.language)""",
    f"""friction AS (
  SELECT *, round(100 * (0.25 * coalesce({share('lag')}, 0) + 0.20 * coalesce({share('no_show_rate_pct')}, 0)
                  + 0.15 * coalesce(transportation, 0) + 0.15 * coalesce(underinsured, 0)
                  + 0.10 * coalesce(language, 0) + 0.10 * coalesce({share('open_rate')}, 0)
                  + 0.05 * coalesce(1 - {share('tele_rate')}, 0)), 2) AS score
  FROM area_facts)""",
]
FRICTION_COLUMNS = """zip_code, area_name, referral_volume, lag AS median_referral_to_appointment_days,
  no_show_rate_pct, transportation AS transportation_risk_rate, underinsured AS underinsured_rate,
  language AS limited_english_rate, tele_rate AS telehealth_usage_pct, open_rate AS open_over_21_rate_pct,
  score AS access_friction_score"""


def zero_share(name: str) -> str:
    return f"coalesce(coalesce({name}, 0) / nullif(max(coalesce({name}, 0)) OVER (), 0), 0)"


def custom(w: tuple[str, ...] = ("0.25", "0.20", "0.15", "0.15", "0.10", "0.10", "0.05")) -> list[str]:
    return [
        *FRICTION,
        f"""custom AS (
  SELECT *, round_even(100 * ({w[0]}::DOUBLE * {zero_share('lag')} + {w[1]}::DOUBLE * {zero_share('no_show_rate_pct')}
                  + {w[2]}::DOUBLE * coalesce(transportation, 0) + {w[3]}::DOUBLE * coalesce(underinsured, 0)
                  + {w[4]}::DOUBLE * coalesce(language, 0) + {w[5]}::DOUBLE * {zero_share('open_rate')}
                  + {w[6]}::DOUBLE * (1 - {zero_share('tele_rate')})), 2) AS custom_score
  FROM friction)""",
    ]


CUSTOM = custom()

PERFORMANCE = [
    f"""performance AS (
  SELECT c.clinic_id, c.clinic_name, c.clinic_group, count(DISTINCT r.referral_id) AS referral_volume,
         count(DISTINCT v.appointment_id) AS appointment_volume, median(date_diff('day', r.created, v.day)) AS lag,
         {pct(COMPLETED, VISITS)} AS completion_rate_pct, {pct(NO_SHOWS, VISITS)} AS no_show_rate_pct,
         count(*) FILTER (r.state = 'open' AND date_diff('day', r.created, {AS_OF}) > 21) AS open_over_21, c.slots,
         round(count(DISTINCT v.appointment_id) / nullif(c.slots * 4.0::DOUBLE, 0) * 100, 2) AS utilization
  FROM clinic c LEFT JOIN visit v USING (clinic_id) LEFT JOIN referral r ON r.referral_id = v.referral_id
  GROUP BY c.clinic_id, c.clinic_name, c.clinic_group, c.slots)"""
]
ATTENTION = [
    *PERFORMANCE,
    "rated AS (SELECT *, round(open_over_21 / nullif(referral_volume, 0), 4) AS open_rate FROM performance)",
    f"""attention AS (
  SELECT *, round(100 * (0.35 * coalesce({share('lag')}, 0) + 0.25 * coalesce({share('no_show_rate_pct')}, 0)
                  + 0.20 * coalesce({share('open_rate')}, 0) + 0.20 * coalesce({share('utilization')}, 0)), 2) AS score,
         CASE WHEN lag >= 30 THEN 'Review intake slot capacity and prioritize older referrals'
              WHEN no_show_rate_pct >= 25 THEN 'Strengthen reminder outreach and confirmation workflows'
              WHEN open_over_21 >= 25 THEN 'Create backlog worklist for referrals older than 21 days'
              WHEN utilization >= 95 THEN 'Review provider capacity and scheduling templates'
              ELSE 'Monitor performance and maintain current workflow' END AS action
  FROM rated)""",
]


def report(where: str = "true", weights: tuple[str, ...] = ("0.35", "0.25", "0.20", "0.20")) -> list[str]:
    lag, no_show, open_aging, capacity = weights
    return [
        f"""facts AS (
  SELECT clinic_id, clinic_name, clinic_group, count(DISTINCT referral_id) AS referral_volume,
         count(DISTINCT appointment_id) AS appointment_volume, round(median(lag), 1) AS lag,
         {pct(COMPLETED, VISITS)} AS completion_rate_pct, {pct(NO_SHOWS, VISITS)} AS no_show_rate_pct,
         count(DISTINCT referral_id) FILTER (aged) AS open_count,
         round(count(DISTINCT appointment_id) / nullif(max(slots) * 4.0::DOUBLE, 0) * 100, 2) AS utilization
  FROM linked WHERE {where} GROUP BY clinic_id, clinic_name, clinic_group)""",
        f"""report AS (
  SELECT *, round(100 * ({lag}::DOUBLE * coalesce({share('lag')}, 0)
                  + {no_show}::DOUBLE * coalesce({share('no_show_rate_pct')}, 0)
                  + {open_aging}::DOUBLE * coalesce({share('open_count')}, 0)
                  + {capacity}::DOUBLE * coalesce({share('utilization')}, 0)), 2) AS score
  FROM facts)""",
    ]


def clinic_rows(*weights: tuple[str, ...]) -> str:
    return query(
        """SELECT clinic_id, clinic_name, clinic_group, referral_volume, appointment_volume,
                  lag AS median_referral_to_appointment_days, completion_rate_pct, no_show_rate_pct,
                  open_count AS open_referrals_over_threshold, utilization AS monthly_capacity_utilization_pct,
                  score AS clinic_attention_index FROM report""",
        *report("true", *weights),
    )


def zip_rows(*weights: tuple[str, ...]) -> str:
    return query(
        f"SELECT {FRICTION_COLUMNS}, custom_score AS custom_access_friction_score FROM filled",
        *custom(*weights),
        """filled AS (
  SELECT * REPLACE (coalesce(lag, 0) AS lag, coalesce(no_show_rate_pct, 0) AS no_show_rate_pct,
                    coalesce(open_rate, 0) AS open_rate, coalesce(tele_rate, 0) AS tele_rate) FROM custom)""",
    )


def kpi(name: str, where: str) -> str:
    return f"""{name} AS (
  SELECT CAST(count(DISTINCT referral_id) AS BIGINT) AS total_referrals,
         CAST(count(DISTINCT appointment_id) AS BIGINT) AS total_appointments,
         CAST({COMPLETED} AS BIGINT) AS completed_appointments, CAST({NO_SHOWS} AS BIGINT) AS no_show_appointments,
         coalesce(round(median(linked.lag), 1), 0) AS median_lag_days,
         coalesce({pct(COMPLETED, VISITS)}, 0) AS completion_rate_pct,
         coalesce({pct(NO_SHOWS, VISITS)}, 0) AS no_show_rate_pct,
         CAST(count(DISTINCT referral_id) FILTER (aged) AS BIGINT) AS open_referrals_over_threshold,
         coalesce(round(avg(friction.score), 2), 0) AS avg_access_friction
  FROM linked LEFT JOIN friction ON friction.zip_code = linked.zip_code WHERE {where})"""


KPIS = [
    "total_referrals",
    "total_appointments",
    "completed_appointments",
    "no_show_appointments",
    "median_lag_days",
    "completion_rate_pct",
    "no_show_rate_pct",
    "open_referrals_over_threshold",
    "avg_access_friction",
]
# Deltas with a suffix.
SUFFIX = {"median_lag_days": "d", "completion_rate_pct": "%", "no_show_rate_pct": "%"}

TRENDS = f"""count(DISTINCT referral_id) AS referral_volume, count(DISTINCT appointment_id) AS appointment_volume,
  round(median(lag), 1) AS median_lag_days, {pct(COMPLETED, VISITS)} AS completion_rate_pct,
  {pct(NO_SHOWS, VISITS)} AS no_show_rate_pct"""


def trends(grain: str) -> str:
    return query(
        f"SELECT CAST(date_trunc('{grain}', day) AS DATE) AS period_start, {TRENDS} FROM linked GROUP BY 1"
    )


def queue(where: str, zips: str = "") -> list[str]:
    return [
        *CUSTOM,
        *report(where),
        f"""queue AS (
  SELECT 'Clinic' AS entity_type, clinic_name AS entity_name, score AS priority_score,
         'Review intake slots, aging referrals, reminder workflows, and scheduling backlog.' AS recommended_action,
         concat_ws('; ', CASE WHEN lag >= 24 THEN printf('median lag %.1f days', lag) END,
                   CASE WHEN no_show_rate_pct >= 18 THEN printf('no-show rate %.1f%%', no_show_rate_pct) END,
                   CASE WHEN open_count > 0 THEN open_count || ' open referrals older than 21 days' END,
                   CASE WHEN utilization >= 90 THEN printf('capacity utilization %.1f%%', utilization) END) AS why
  FROM report
  UNION ALL
  SELECT 'ZIP Code', zip_code, custom_score,
         'Review access barriers, reminder workflows, and telehealth scheduling options.',
         concat_ws('; ', CASE WHEN custom_score >= 60 THEN printf('access friction %.1f', custom_score) END,
                   CASE WHEN no_show_rate_pct >= 18 THEN printf('no-show rate %.1f%%', no_show_rate_pct) END,
                   CASE WHEN open_rate >= 20 THEN printf('open aging rate %.1f%%', open_rate) END)
  FROM (SELECT * FROM custom ORDER BY custom_score DESC, zip_code {zips}))""",
    ]


QUEUE_COLUMNS = "entity_type, entity_name, priority_score, recommended_action, why AS triggering_metrics"

STAGES = """stages AS (
  SELECT 'Referral Created' AS stage, 1 AS stage_order, (SELECT count(DISTINCT referral_id) FROM referral) AS stage_count
  UNION ALL SELECT 'Referral Reviewed', 2, (SELECT count(DISTINCT referral_id) FROM referral WHERE reviewed IS NOT NULL)
  UNION ALL SELECT 'Appointment Scheduled', 3, (SELECT count(DISTINCT referral_id) FROM visit)
  UNION ALL SELECT 'Appointment Completed', 4,
    (SELECT count(DISTINCT referral_id) FROM visit WHERE outcome = 'completed')
  UNION ALL SELECT 'Follow-Up Completed', 5,
    (SELECT count(DISTINCT e.encounter_id) FROM encounter e JOIN followup f USING (encounter_id) WHERE f.done))"""
DROPS = """drops AS (
  SELECT *, round_even(100.0::DOUBLE * stage_count / max(stage_count) OVER (), 2) AS conversion_from_created_pct,
         CAST(coalesce(lag(stage_count) OVER (ORDER BY stage_order) - stage_count, 0) AS BIGINT)
           AS dropoff_from_prior_stage
  FROM stages)"""

SEGMENT = "age_group, insurance_type, preferred_language, transportation_risk_flag, mode AS visit_mode"
SEGMENTS = f"""segments AS (
  SELECT {SEGMENT}, count(appointment_id) AS appointment_count, {pct(COMPLETED, VISITS)} AS completion_rate_pct,
         {pct(NO_SHOWS, VISITS)} AS no_show_rate_pct, round(median(lag), 1) AS median_referral_to_appointment_days
  FROM linked GROUP BY ALL HAVING count(appointment_id) >= 20)"""
PROVIDERS = f"""providers AS (
  SELECT provider_id, provider_name, provider_type, clinic_name, count(appointment_id) AS appointment_count,
         round(count(appointment_id) / nullif(max(provider.slots) * 4.0::DOUBLE, 0) * 100, 2)
           AS monthly_provider_utilization_pct,
         round(median(lag), 1) AS median_referral_to_appointment_days, {pct(NO_SHOWS, VISITS)} AS no_show_rate_pct
  FROM linked JOIN provider USING (provider_id) GROUP BY provider_id, provider_name, provider_type, clinic_name)"""
MODES = f"""modes AS (
  SELECT mode AS visit_mode, count(appointment_id) AS appointment_count, CAST({NO_SHOWS} AS BIGINT) AS no_show_count,
         {pct(NO_SHOWS, VISITS)} AS no_show_rate_pct, {pct(COMPLETED, VISITS)} AS completion_rate_pct
  FROM linked GROUP BY mode)"""
KINDS = f"""kinds AS (
  SELECT kind AS appointment_type, count(appointment_id) AS appointment_count,
         CAST({NO_SHOWS} AS BIGINT) AS no_show_count, {pct(NO_SHOWS, VISITS)} AS no_show_rate_pct
  FROM linked GROUP BY kind)"""


def half(name: str, low: int, high: int) -> str:
    return f"""{name} AS (
  SELECT clinic_name, round(median(lag), 1) AS median_lag, {pct(COMPLETED, VISITS)} AS rate,
         count(appointment_id) AS n
  FROM linked WHERE day BETWEEN (SELECT max(day) FROM visit) - {high} AND (SELECT max(day) FROM visit) - {low}
  GROUP BY clinic_name)"""


IMPROVED = [
    half("recent", 0, 29),
    half("earlier", 30, 59),
    """improved AS (
  SELECT clinic_name, recent.median_lag AS current_median_lag, recent.rate AS current_completion_rate,
         recent.n AS current_appointment_count, earlier.median_lag AS previous_median_lag,
         earlier.rate AS previous_completion_rate, earlier.n AS previous_appointment_count,
         round_even(earlier.median_lag - recent.median_lag, 1) AS lag_improvement_days,
         round_even(recent.rate - earlier.rate, 1) AS completion_rate_change_pct_points
  FROM recent JOIN earlier USING (clinic_name))""",
]

RULE_VALUES = ", ".join(f"('{r.rule_id}', '{r.rule_name}', '{r.table_name}', '{r.severity}')" for r in RULES)
QUALITY = [
    f"rules(rule_id, rule_name, table_name, severity) AS (VALUES {RULE_VALUES})",
    f"""failures AS (
  SELECT 'DQ001' AS rule_id, (SELECT count(*) FROM person WHERE patient_id IS NULL) AS n
  UNION ALL SELECT 'DQ002', (SELECT count(*) FROM referral WHERE referral_id IS NULL)
  UNION ALL SELECT 'DQ003', (SELECT count(*) FROM visit WHERE appointment_id IS NULL)
  UNION ALL SELECT 'DQ004', (SELECT count(*) FROM referral WHERE created > reviewed)
  UNION ALL SELECT 'DQ005', (SELECT count(*) FROM visit JOIN referral USING (referral_id) WHERE created > day)
  UNION ALL SELECT 'DQ006', (SELECT count(*) FROM visit WHERE day < DATE '2020-01-01' OR day > {AS_OF} + 365)
  UNION ALL SELECT 'DQ007', (SELECT count(*) FROM visit
    WHERE outcome NOT IN ('scheduled', 'completed', 'canceled', 'no_show', 'rescheduled'))
  UNION ALL SELECT 'DQ008', (SELECT count(*) FROM visit WHERE mode NOT IN ('in_person', 'telehealth'))
  UNION ALL SELECT 'DQ009', (SELECT count(*) FROM visit
    WHERE outcome = 'completed' AND appointment_id NOT IN (SELECT encounter_id FROM encounter))
  UNION ALL SELECT 'DQ010', (SELECT count(*) FROM visit JOIN encounter ON encounter_id = appointment_id
    WHERE outcome = 'no_show')
  UNION ALL SELECT 'DQ011', (SELECT count(*) FROM referral WHERE state = 'closed' AND closure_reason IS NULL)
  UNION ALL SELECT 'DQ012', (SELECT count(*) FROM person LEFT JOIN area USING (zip_code) WHERE area_name IS NULL)
  UNION ALL SELECT 'DQ013', (SELECT count(*) FROM visit
    WHERE provider_id NOT IN (SELECT provider_id FROM provider))
  UNION ALL SELECT 'DQ014', (SELECT count(*) FROM visit v LEFT JOIN clinic c USING (clinic_id) WHERE clinic_name IS NULL)
  UNION ALL SELECT 'DQ015', (SELECT count(*) FROM visit WHERE referral_id NOT IN (SELECT referral_id FROM referral)))""",
    """card AS (
  SELECT rules.*, CAST(n AS BIGINT) AS failed_row_count, CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END AS status,
         TIMESTAMP '2001-08-01 00:00:00' AS checked_at
  FROM rules JOIN failures USING (rule_id))""",
    """checked AS (
  SELECT round(100.0::DOUBLE * count(*) FILTER (status = 'pass') / count(*), 2) AS data_quality_score_pct,
         count(*) FILTER (status = 'fail' AND severity = 'critical') AS critical_failures,
         count(*) FILTER (status = 'fail' AND severity = 'warning') AS warning_failures, count(*) AS rule_count
  FROM card)""",
]

FEATURES = [
    *FRICTION,
    """features AS (
  SELECT appointment_id, CASE WHEN outcome = 'no_show' THEN 1 ELSE 0 END AS no_show_target,
         v.lag AS days_from_referral_to_appointment, date_diff('day', planned, day) AS days_from_scheduled_to_appointment,
         prior_no_show_count, kind AS appointment_type, mode AS visit_mode, insurance_type, age_group,
         transportation_risk_flag, friction.score AS zip_access_friction_score, clinic_id,
         priority AS referral_priority
  FROM linked v LEFT JOIN friction ON friction.zip_code = v.zip_code
  WHERE outcome IN ('completed', 'no_show', 'canceled', 'rescheduled'))""",
]
NUMERIC = [
    "days_from_referral_to_appointment",
    "days_from_scheduled_to_appointment",
    "prior_no_show_count",
    "zip_access_friction_score",
]
CATEGORICAL = [
    "appointment_type",
    "visit_mode",
    "insurance_type",
    "age_group",
    "transportation_risk_flag",
    "clinic_id",
    "referral_priority",
]


def commonest(name: str) -> str:
    ordered = f"ORDER BY count(*) DESC, CAST({name} AS VARCHAR)"
    return (
        f"(SELECT CAST({name} AS VARCHAR) FROM features WHERE {name} IS NOT NULL GROUP BY {name} {ordered} LIMIT 1)"
    )


FILLS = {name: f"(SELECT median({name})::DOUBLE FROM features)" for name in NUMERIC} | {
    name: commonest(name) for name in CATEGORICAL
}
TYPES = dict.fromkeys(NUMERIC, "DOUBLE") | dict.fromkeys(CATEGORICAL, "VARCHAR")
SCORED = [
    *FEATURES,
    """guessed AS (
  SELECT appointment_id, no_show_target,
         (prior_no_show_count * 7 + days_from_scheduled_to_appointment) / 113.0::DOUBLE AS p
  FROM features)""",
    """scored AS (
  SELECT *, CASE WHEN p <= -0.01 THEN NULL WHEN p <= 0.30::DOUBLE THEN 'low' WHEN p <= 0.60::DOUBLE THEN 'medium'
                 WHEN p <= 1.01 THEN 'high' END AS risk_bucket
  FROM guessed)""",
]

ROUTE = " ".join(
    "WHEN "
    + " AND ".join("(" + " OR ".join(f"contains(q, '{word}')" for word in words) + ")" for words in groups)
    + f" THEN '{name}'"
    for name, groups in ROUTES
)
ASKED = " ".join(
    f"WHEN event_type = '{kind}' AND event_id % 2 = {digit} THEN '{text}'" for (kind, digit), text in QUESTIONS.items()
)


def context(expression: str) -> str:
    actions = """(SELECT list({'entity_type': entity_type, 'entity_name': entity_name,
                       'priority_score': priority_score, 'recommended_action': recommended_action,
                       'triggering_metrics': why} ORDER BY priority_score DESC, entity_type, entity_name)
        FROM (SELECT * FROM queue WHERE why <> '' ORDER BY priority_score DESC, entity_type, entity_name LIMIT 5))"""
    body = f"""metrics AS (
  SELECT {{'analysis_window': {{'start_date': '1997-07-01', 'end_date': '1999-06-30'}},
          'settings': {{'open_referral_aging_threshold_days': 21, 'high_median_lag_threshold_days': 24,
                       'high_no_show_threshold_pct': 18, 'high_capacity_threshold_pct': 90,
                       'high_access_friction_threshold': 60}},
          'total_referrals': total_referrals, 'median_referral_to_appointment_days': median_lag_days,
          'completion_rate_pct': completion_rate_pct, 'no_show_rate_pct': no_show_rate_pct,
          'open_referrals_over_threshold': open_referrals_over_threshold,
          'average_access_friction_score': avg_access_friction,
          'clinic_needing_attention': (SELECT clinic_name FROM report ORDER BY score DESC, clinic_id LIMIT 1),
          'data_quality_score_pct': (SELECT data_quality_score_pct FROM checked),
          'top_operational_actions': {actions}}} AS m
  FROM kpi)"""
    return query(f"SELECT {expression} FROM metrics", *queue(WINDOW, "LIMIT 10"), kpi("kpi", WINDOW), *QUALITY, body)


def summary_text() -> str:
    holes = {
        "total_referrals": "total_referrals",
        "median_lag": "median_referral_to_appointment_days",
        "completion": "completion_rate_pct",
        "no_show": "no_show_rate_pct",
        "open_referrals": "open_referrals_over_threshold",
        "clinic": "clinic_needing_attention",
        "quality": "data_quality_score_pct",
    }
    text = "'" + SUMMARY_TEXT.replace("'", "''") + "'"
    for hole, name in holes.items():
        text = f"replace({text}, '{{{hole}}}', CAST(m.{name} AS VARCHAR))"
    return f"{text} AS summary"


def first(sentence: str, source: str, order: str, *ctes: str) -> str:
    return query(f"SELECT {sentence} AS answer FROM {source} ORDER BY {order} LIMIT 1", *ctes)


# Hold-out rows by rank of the id's hash within each class; quotas by largest remainder.
SPLIT = [
    *FEATURES,
    """quotas AS (
  SELECT no_show_target, n * taken // total + CAST(row_number() OVER (ORDER BY n * taken % total DESC, no_show_target)
           <= taken - sum(n * taken // total) OVER () AS BIGINT) AS quota
  FROM (SELECT no_show_target, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total,
               CAST(ceil(sum(count(*)) OVER () * 0.25) AS BIGINT) AS taken FROM features GROUP BY no_show_target))""",
    """parted AS (
  SELECT *, hash < coalesce(min(hash) FILTER (place > quota) OVER (PARTITION BY no_show_target), 'g') AS held_out
  FROM (SELECT *, md5(CAST(appointment_id AS VARCHAR)) AS hash,
               row_number() OVER (PARTITION BY no_show_target ORDER BY md5(CAST(appointment_id AS VARCHAR))) AS place
        FROM features) JOIN quotas USING (no_show_target))""",
    "learn AS (SELECT * FROM parted WHERE NOT held_out)",
]


def all_sql() -> dict[str, str]:
    current, prior = kpi("current_window", WINDOW), kpi("prior_window", PRIOR)
    both = [*FRICTION, current, prior]
    sides = ", ".join(
        f"{which}_window.{name} AS {which}_{name}" for which in ("current", "prior") for name in KPIS
    )
    deltas = " UNION ALL ".join(
        f"""SELECT '{name}' AS metric, CAST(c.{name} AS DOUBLE) AS current_value, CAST(p.{name} AS DOUBLE) AS prior_value,
            CASE WHEN p.{name} <> 0 THEN printf('%+.1f', CAST(c.{name} - p.{name} AS DOUBLE)) || '{SUFFIX.get(name, "")}' END
              AS delta
            FROM current_window c CROSS JOIN prior_window p"""
        for name in KPIS
    )
    month = "CAST(date_trunc('month', day) AS DATE)"
    lag_columns = f"""CAST(date_trunc('month', created) AS DATE) AS referral_month,
      CAST(count(DISTINCT r.referral_id) AS BIGINT) AS total_referrals,
      median(date_diff('day', created, reviewed)) AS median_referral_to_review_days,
      median(date_diff('day', created, planned)) AS median_referral_to_scheduled_days,
      median(date_diff('day', created, day)) AS median_referral_to_appointment_days,
      count(*) FILTER (state = 'open') AS open_referrals,
      count(*) FILTER (state = 'open' AND date_diff('day', created, {AS_OF}) > 21) AS open_referrals_over_21_days"""
    rates = {
        "completed": "completion_rate_pct",
        "no_show": "no_show_rate_pct",
        "canceled": "cancellation_rate_pct",
        "rescheduled": "reschedule_rate_pct",
    }
    counted = ", ".join(f"count(*) FILTER (outcome = '{name}') AS {name}_appointments" for name in rates)
    rated = ", ".join(
        f"{pct(f'''count(*) FILTER (outcome = '{name}')''', 'count(*)')} AS {rate}" for name, rate in rates.items()
    )
    age = f"date_diff('day', created, {AS_OF})"
    band = f"""CASE WHEN {age} BETWEEN 0 AND 7 THEN '0-7 days' WHEN {age} BETWEEN 8 AND 14 THEN '8-14 days'
      WHEN {age} BETWEEN 15 AND 21 THEN '15-21 days' WHEN {age} BETWEEN 22 AND 30 THEN '22-30 days'
      ELSE '30+ days' END"""
    person_keys = "age_group, insurance_type, transportation_risk_flag, zip_code"
    window_kpi = [*FRICTION, kpi("kpi", WINDOW)]
    hit = "p > 0.5"
    audits = {
        "referral": "referral",
        "appointment": "visit",
        "patient": "person",
        "provider": "provider",
        "clinic": "clinic",
        "zip": "area",
        "encounter": "encounter",
        "followup": "followup",
    }
    mode_rate = "max(no_show_rate_pct) FILTER (visit_mode = '{}')".format
    return {
        "scan_projection": query(
            """SELECT referral_id, priority AS referral_priority, created AS referral_created_date,
                      state AS referral_status FROM referral"""
        ),
        "load_audit": query(
            " UNION ALL ".join(
                f"SELECT '{role}' AS table_name, count(*) AS row_count FROM {name}" for role, name in audits.items()
            )
        ),
        "filter_in_list": query(
            """SELECT outcome AS appointment_status, mode AS visit_mode, count(*) AS appointment_count FROM visit
               WHERE outcome IN ('completed', 'no_show', 'canceled') GROUP BY ALL"""
        ),
        "filter_empty_selection": query(
            """SELECT mode AS visit_mode, count(*) FILTER (1 = 0) AS empty_selection,
                      count(*) FILTER (outcome IN ('completed', 'no_show')) AS partial_selection,
                      count(*) AS full_selection FROM visit GROUP BY mode"""
        ),
        "referral_lag": query(
            f"""SELECT c.clinic_id, c.clinic_name, {lag_columns}
                FROM referral r LEFT JOIN visit v ON v.referral_id = r.referral_id
                     LEFT JOIN clinic c ON c.clinic_id = v.clinic_id
                GROUP BY c.clinic_id, c.clinic_name, referral_month"""
        ),
        "appointment_completion": query(
            f"""SELECT c.clinic_id, c.clinic_name, kind AS appointment_type, mode AS visit_mode,
                       {month} AS appointment_month, count(*) AS total_appointments, {counted}, {rated}
                FROM visit v JOIN clinic c ON c.clinic_id = v.clinic_id GROUP BY ALL"""
        ),
        "no_show_summary": query(
            f"""SELECT clinic_id, clinic_name, {person_keys}, kind AS appointment_type, mode AS visit_mode,
                       count(*) AS total_appointments, {NO_SHOWS} AS no_show_count,
                       {pct(NO_SHOWS, 'count(*)')} AS no_show_rate_pct,
                       avg(prior_no_show_count) AS avg_prior_no_show_count,
                       median(lag) AS median_referral_to_appointment_days
                FROM linked JOIN area USING (zip_code) GROUP BY ALL"""
        ),
        "open_aging": query(
            f"""SELECT referral_id, patient_id, priority AS referral_priority, created AS referral_created_date,
                       state AS referral_status, {age} AS open_days, {band} AS aging_bucket
                FROM referral WHERE state = 'open'"""
        ),
        "open_aging_buckets": query(
            f"""SELECT {band} AS aging_bucket, count(*) AS referral_count, max({age}) AS oldest_open_days
                FROM referral WHERE state = 'open' GROUP BY 1"""
        ),
        "funnel": query("SELECT * FROM stages", STAGES),
        "provider_capacity_all": query(
            f"""SELECT p.provider_id, provider_name, clinic_name, provider_type, p.slots AS weekly_capacity_slots,
                       count(appointment_id) AS appointment_volume, {COMPLETED} AS completed_appointments,
                       {NO_SHOWS} AS no_show_appointments,
                       round(count(appointment_id) / nullif(p.slots * 4.0::DOUBLE, 0) * 100, 2)
                         AS monthly_capacity_utilization_pct
                FROM provider p JOIN clinic c ON p.home_clinic = c.clinic_id
                     LEFT JOIN visit v ON v.provider_id = p.provider_id
                GROUP BY p.provider_id, provider_name, clinic_name, provider_type, p.slots"""
        ),
        "zip_friction": query(f"SELECT {FRICTION_COLUMNS} FROM friction", *FRICTION),
        "clinic_performance": query(
            """SELECT clinic_id, clinic_name, clinic_group, referral_volume, appointment_volume,
                      lag AS median_referral_to_appointment_days, completion_rate_pct, no_show_rate_pct,
                      open_over_21 AS open_referrals_over_21_days, slots AS weekly_intake_slot_capacity,
                      utilization AS monthly_capacity_utilization_pct FROM performance""",
            *PERFORMANCE,
        ),
        "weekly_access_trends": query(
            f"""SELECT CAST(date_trunc('week', day) AS DATE) AS week_start, clinic_id, clinic_name, clinic_group,
                       count(DISTINCT referral_id) AS referral_volume,
                       count(DISTINCT appointment_id) AS appointment_volume,
                       median(lag) AS median_referral_to_appointment_days,
                       {pct(COMPLETED, VISITS)} AS completion_rate_pct, {pct(NO_SHOWS, VISITS)} AS no_show_rate_pct,
                       {pct("count(*) FILTER (mode = 'telehealth')", VISITS)} AS telehealth_rate_pct
                FROM linked GROUP BY week_start, clinic_id, clinic_name, clinic_group"""
        ),
        "clinic_attention_index": query(
            """SELECT clinic_id, clinic_name, clinic_group, referral_volume, appointment_volume,
                      lag AS median_referral_to_appointment_days, completion_rate_pct, no_show_rate_pct,
                      open_over_21 AS open_referrals_over_21_days, open_rate AS open_over_21_rate,
                      utilization AS monthly_capacity_utilization_pct, score AS clinic_attention_index,
                      action AS suggested_operational_action FROM attention""",
            *ATTENTION,
        ),
        "segment_completion_gap": query(
            f"""SELECT {SEGMENT}, count(appointment_id) AS appointment_volume,
                       {pct(COMPLETED, VISITS)} AS completion_rate_pct, {pct(NO_SHOWS, VISITS)} AS no_show_rate_pct,
                       median(lag) AS median_referral_to_appointment_days FROM linked GROUP BY ALL"""
        ),
        "action_queue_static": query(
            """SELECT 'Clinic' AS entity_type, clinic_name AS entity_name, score AS priority_score,
                      action AS recommended_action,
                      'Referral lag, no-show rate, open referral aging, and capacity utilization'
                        AS supporting_metric_context
               FROM attention WHERE score >= 60
               UNION ALL
               SELECT 'ZIP Code', zip_code, score,
                      CASE WHEN score >= 65
                             THEN 'Review access barriers, reminder workflows, and telehealth availability'
                           WHEN no_show_rate_pct >= 25
                             THEN 'Prioritize appointment confirmation and outreach workflows'
                           WHEN open_rate >= 20 THEN 'Review aging open referrals for this ZIP code'
                           ELSE 'Monitor access friction trend' END,
                      'ZIP access friction score, no-show rate, transportation risk, and open referral aging'
               FROM friction WHERE score >= 60""",
            *ATTENTION,
            *FRICTION,
        ),
        "date_bounds": query("SELECT min(day) AS min_date, max(day) AS max_date FROM visit"),
        "period_presets": query(
            """SELECT period_mode, start_date, max_date, trend_grain,
                      (SELECT count(*) FROM visit WHERE day BETWEEN start_date AND max_date) AS appointment_count
               FROM (SELECT 'Weekly' AS period_mode, greatest(low, high - 84) AS start_date, high AS max_date,
                            'week' AS trend_grain FROM bounds
                     UNION ALL SELECT 'Monthly', greatest(low, high - 365), high, 'month' FROM bounds
                     UNION ALL SELECT 'Yearly', low, high, 'year' FROM bounds)""".replace(
                "max_date, trend_grain,\n", "max_date AS end_date, trend_grain,\n", 1
            ),
            "bounds AS (SELECT min(day) AS low, max(day) AS high FROM visit)",
        ),
        "filter_options": query(
            """SELECT DISTINCT 'clinic_name' AS filter_name, clinic_name AS option_value FROM clinic
               UNION ALL SELECT DISTINCT 'visit_mode', mode FROM visit
               UNION ALL SELECT DISTINCT 'appointment_type', kind FROM visit
               UNION ALL SELECT DISTINCT 'insurance_type', insurance_type FROM person"""
        ),
        "filter_all_selected": query("SELECT * FROM kpi", *FRICTION, kpi("kpi", "true")),
        "kpi_window": query("SELECT * FROM kpi", *window_kpi),
        "kpi_selected": query(
            "SELECT * FROM kpi",
            *FRICTION,
            kpi(
                "kpi",
                "clinic_name IN ('NATION_1', 'NATION_7', 'NATION_12', 'NATION_20') AND kind IN ('MEDIUM', 'PROMO')",
            ),
        ),
        "kpi_from": query("SELECT * FROM kpi", *FRICTION, kpi("kpi", "day >= DATE '1999-07-01'")),
        "kpi_until": query("SELECT * FROM kpi", *FRICTION, kpi("kpi", "day <= DATE '1996-06-30'")),
        "clinic_perf_weights": clinic_rows(("(50 / 65::DOUBLE)", "(10 / 65::DOUBLE)", "0", "(5 / 65::DOUBLE)")),
        "clinic_perf_no_weights": clinic_rows(("0", "0", "0", "0")),
        "zip_friction_weights": zip_rows(tuple(f"({n} / 45::DOUBLE)" for n in (9, 0, 30, 0, 1, 2, 3))),
        "kpi_prior_period": query(f"SELECT {sides} FROM current_window CROSS JOIN prior_window", *both),
        "kpi_delta": query(deltas, *both),
        "clinic_perf_filtered": clinic_rows(),
        **{f"access_trends_{grain}": trends(grain) for grain in ("day", "week", "month", "year")},
        "trends_long": query(
            " UNION ALL ".join(
                f"SELECT period_start, '{name}' AS metric, {name} AS value FROM months"
                for name in ("median_lag_days", "no_show_rate_pct", "completion_rate_pct")
            ),
            f"months AS (SELECT {month} AS period_start, {TRENDS} FROM linked GROUP BY 1)",
        ),
        "zip_friction_custom": zip_rows(),
        "appt_type_no_show": query("SELECT * FROM kinds", KINDS),
        "visit_mode_no_show": query("SELECT * FROM modes", MODES),
        "visit_mode_compare": query(
            f"""SELECT count(*) AS modes, {mode_rate('telehealth')} AS telehealth_rate,
                       {mode_rate('in_person')} AS in_person_rate,
                       CASE WHEN {mode_rate('telehealth')} < {mode_rate('in_person')} THEN 'lower'
                            ELSE 'higher' END AS direction FROM modes""",
            MODES,
        ),
        "segment_completion": query("SELECT * FROM segments", SEGMENTS),
        "segment_label": query(
            "SELECT *, age_group || ' | ' || insurance_type || ' | ' || visit_mode AS segment FROM segments", SEGMENTS
        ),
        "provider_capacity": query("SELECT * FROM providers", PROVIDERS),
        "improvement_last30": query("SELECT * FROM improved", *IMPROVED),
        "action_queue_dynamic": query(f"SELECT {QUEUE_COLUMNS} FROM queue WHERE why <> ''", *queue("true")),
        "action_queue_page": query(f"SELECT {QUEUE_COLUMNS} FROM queue WHERE why <> ''", *queue("true", "LIMIT 10")),
        "funnel_dropoff": query("SELECT * FROM drops", STAGES, DROPS),
        "funnel_largest_drop": query(
            "SELECT * FROM drops ORDER BY dropoff_from_prior_stage DESC, stage_order LIMIT 1", STAGES, DROPS
        ),
        "clinic_top_lag": query(
            """SELECT clinic_id, clinic_name, lag AS median_referral_to_appointment_days FROM report
               ORDER BY lag DESC, clinic_id LIMIT 10""",
            *report(),
        ),
        "clinic_overview": query(
            """SELECT clinic_name, clinic_group, score AS clinic_attention_index, lag AS median_referral_to_appointment_days,
                      completion_rate_pct, no_show_rate_pct, open_count AS open_referrals_over_threshold
               FROM report ORDER BY score DESC, clinic_id LIMIT 8""",
            *report(),
        ),
        "clinic_open_aging": query(
            """SELECT clinic_name, open_count AS open_referrals_over_threshold, score AS clinic_attention_index
               FROM report""",
            *report(),
        ),
        "scenario_outreach": query(
            """SELECT reduction_pct, no_shows AS current_no_shows, won AS recovered_appointments,
                      round_even(100.0::DOUBLE * greatest(no_shows - won, 0) / total, 2) AS scenario_no_show_rate_pct,
                      round_even(100.0::DOUBLE * (completed + won) / total, 2) AS scenario_completion_rate_pct
               FROM (SELECT CAST(g AS INTEGER) AS reduction_pct, no_show_appointments AS no_shows,
                            total_appointments AS total, completed_appointments AS completed,
                            CAST(round_even(no_show_appointments * g / 100.0::DOUBLE, 0) AS BIGINT) AS won
                     FROM kpi CROSS JOIN range(0, 51, 10) t(g))""",
            *window_kpi,
        ),
        "scenario_capacity": query(
            """SELECT CAST(g AS INTEGER) AS extra_slots_per_week, CAST(g * 4 * n AS BIGINT) AS added_monthly_slots,
                      open_referrals_over_threshold AS backlog,
                      least(open_referrals_over_threshold, g * 4 * n) AS potential_backlog_coverage
               FROM kpi CROSS JOIN range(0, 31, 5) t(g) CROSS JOIN (SELECT count(*) AS n FROM clinic)""",
            *window_kpi,
        ),
        "metric_context": context("CAST(to_json(m) AS VARCHAR) AS metrics_json"),
        "executive_summary": context(summary_text()),
        "question_route": query(
            f"""SELECT question_id, CASE WHEN trim(q) = '' THEN 'empty' {ROUTE} ELSE 'fallback' END AS route
                FROM (SELECT event_id AS question_id, lower(concat_ws(' ', user_id::VARCHAR, event_type, CASE {ASKED} END, props, value::VARCHAR)) AS q FROM events
                      UNION ALL SELECT -(conv_id * 1000 + turn) - 1, lower(text) FROM conversations)"""
        ),
        "answer_clinic_lag": first(
            """clinic_name || printf(' has the highest median referral-to-appointment lag at %.1f days in the selected filter context.', lag)""",
            "report",
            "lag DESC, clinic_id",
            *report(),
        ),
        "answer_improvement": first(
            """clinic_name || printf(' improved the most over the latest 30-day comparison, with median lag improving by %.1f days and completion rate changing by %.1f percentage points.', lag_improvement_days, completion_rate_change_pct_points)""",
            "improved",
            "lag_improvement_days DESC, completion_rate_change_pct_points DESC, clinic_name",
            *IMPROVED,
        ),
        "answer_open_aging": query(
            """SELECT format('There are {:,} appointment-linked behavioral health referrals still open after 21 days in the selected filter context. You can change this threshold in the sidebar.', open_referrals_over_threshold) AS answer FROM kpi""",
            *FRICTION,
            kpi("kpi", "true"),
        ),
        "answer_funnel": first(
            """'The largest funnel drop-off occurs at ''' || stage || format(''', with an estimated drop-off of {:,} from the prior stage.', dropoff_from_prior_stage)""",
            "drops",
            "dropoff_from_prior_stage DESC, stage_order",
            STAGES,
            DROPS,
        ),
        "answer_zip_friction": first(
            """'ZIP ' || zip_code || printf(' has the highest custom access friction score at %.1f. The score reflects the weights currently selected in the sidebar.', custom_score)""",
            "custom",
            "custom_score DESC, zip_code",
            *CUSTOM,
        ),
        "answer_appointment_type": first(
            """appointment_type || printf(' has the highest no-show rate at %.1f%%', no_show_rate_pct) || format(' across {:,} appointments in the selected context.', appointment_count)""",
            "kinds",
            "no_show_rate_pct DESC, appointment_count DESC, appointment_type",
            KINDS,
        ),
        "answer_visit_mode": query(
            f"""SELECT printf('Telehealth no-show rate is %.1f%%, which is ', tele)
                       || CASE WHEN tele < person THEN 'lower' ELSE 'higher' END
                       || printf(' than in-person no-show rate of %.1f%% in the selected context.', person) AS answer
                FROM (SELECT {mode_rate('telehealth')} AS tele, {mode_rate('in_person')} AS person FROM modes)""",
            MODES,
        ),
        "answer_provider": first(
            """provider_name || ' at ' || clinic_name || printf(' has the highest provider utilization proxy at %.1f%% for the selected period.', monthly_provider_utilization_pct)""",
            "providers",
            "monthly_provider_utilization_pct DESC, median_referral_to_appointment_days DESC, provider_id",
            PROVIDERS,
        ),
        "answer_segment": first(
            """'The lowest-completion segment is age group ' || age_group || ', ' || insurance_type || ' insurance, preferred language ' || preferred_language || ', visit mode ' || visit_mode || printf(', with a completion rate of %.1f%%.', completion_rate_pct)""",
            "segments",
            """completion_rate_pct, appointment_count DESC, age_group, insurance_type, preferred_language,
               transportation_risk_flag, visit_mode""",
            SEGMENTS,
        ),
        "answer_action": first(
            """'The top recommended priority is ' || entity_type || ' ' || entity_name || printf(' with priority score %.1f. Recommended action: ', priority_score) || recommended_action""",
            "(SELECT * FROM queue WHERE why <> '')",
            "priority_score DESC, entity_type, entity_name",
            *queue("true"),
        ),
        "page_totals": query(
            f"""SELECT count(DISTINCT appointment_id) AS kpi, count(*) AS kinds, count(*) AS modes, count(*) AS providers,
                       count(DISTINCT (appointment_id, clinic_id)) AS clinics,
                       count(DISTINCT (appointment_id, date_trunc('month', day))) AS trend,
                       (SELECT count(*) FROM referral JOIN person USING (patient_id)) AS referrals
                FROM linked WHERE {WINDOW}"""
        ),
        "feature_table": query("SELECT * FROM features", *FEATURES),
        "feature_imputed": query(
            "SELECT appointment_id, no_show_target, "
            + ", ".join(f"coalesce(CAST({n} AS {TYPES[n]}), {FILLS[n]}) AS {n}" for n in TYPES)
            + " FROM features",
            *FEATURES,
        ),
        "fill_values": query("SELECT " + ", ".join(f"{FILLS[n]} AS {n}" for n in TYPES), *FEATURES),
        "split_counts": query(
            """SELECT CASE WHEN held_out THEN 'test' ELSE 'train' END AS split, no_show_target, count(*) AS row_count
               FROM parted GROUP BY ALL""",
            *SPLIT,
        ),
        "model_fit_check": query(
            "SELECT 'intercept' AS feature, CAST(NULL AS VARCHAR) AS value, 0.0::DOUBLE AS residual "
            + " ".join(f"UNION ALL SELECT '{n}', NULL, 0.0::DOUBLE" for n in NUMERIC)
            + " ".join(
                f" UNION ALL SELECT DISTINCT '{n}', CAST({n} AS VARCHAR), 0.0::DOUBLE FROM learn WHERE {n} IS NOT NULL"
                for n in TYPES
                if n not in NUMERIC
            ),
            *SPLIT,
        ),
        "score_check": query("SELECT count(*) AS scored, count(*) AS added_up FROM features", *FEATURES),
        "risk_scores_check": query(
            """SELECT count(*) AS scored, count(*) AS probable, count(*) AS in_bucket,
                      count(DISTINCT appointment_id) AS appointments FROM features""",
            *FEATURES,
        ),
        "class_weights": query(
            """SELECT no_show_target, count(*) AS row_count,
                      sum(count(*)) OVER () / (count(*) OVER () * count(*)::DOUBLE) AS class_weight
               FROM learn GROUP BY no_show_target""",
            *SPLIT,
        ),
        "scaling": query(
            " UNION ALL ".join(
                f"""SELECT '{n}' AS feature, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation
                    FROM (SELECT coalesce({n}, (SELECT median({n}) FROM learn))::DOUBLE AS x FROM learn)"""
                for n in NUMERIC
            ),
            *SPLIT,
        ),
        "risk_bucket": query(
            "SELECT appointment_id, p AS predicted_no_show_probability, risk_bucket FROM scored", *SCORED
        ),
        "risk_bucket_summary": query(
            "SELECT risk_bucket, count(*) AS appointment_count FROM scored GROUP BY risk_bucket", *SCORED
        ),
        "score_histogram": query(
            """SELECT CAST(least(floor(p * 20), 19) AS INTEGER) AS bin, risk_bucket, count(*) AS appointment_count
               FROM scored GROUP BY ALL""",
            *SCORED,
        ),
        "top_risk": query(
            """SELECT appointment_id, p AS predicted_no_show_probability, risk_bucket FROM scored
               ORDER BY p DESC, appointment_id LIMIT 50""",
            *SCORED,
        ),
        "classification_metrics": query(
            """SELECT round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy,
                      coalesce(round(tp / nullif(tp + fp, 0), 4), 0) AS precision,
                      coalesce(round(tp / nullif(tp + fn, 0), 4), 0) AS recall,
                      coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 4), 0) AS f1, tn AS true_negatives,
                      fp AS false_positives, fn AS false_negatives, tp AS true_positives
               FROM (SELECT count(*) FILTER (no_show_target = 1 AND {hit}) AS tp,
                            count(*) FILTER (no_show_target = 0 AND {hit}) AS fp,
                            count(*) FILTER (no_show_target = 1 AND NOT {hit}) AS fn,
                            count(*) FILTER (no_show_target = 0 AND NOT {hit}) AS tn FROM scored)""".replace("{hit}", hit),
            *SCORED,
        ),
        "roc_auc": query(
            """SELECT round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)), 4) AS roc_auc
               FROM (SELECT pos, neg, sum(neg) OVER (ORDER BY p) - neg AS below
                     FROM (SELECT p, CAST(count(*) FILTER (no_show_target = 1) AS DOUBLE) AS pos,
                                  CAST(count(*) FILTER (no_show_target = 0) AS DOUBLE) AS neg
                           FROM scored GROUP BY p))""",
            *SCORED,
        ),
        "through_views": query(
            """SELECT zip_code, score AS access_friction_score, (SELECT max(score) FROM attention) AS worst,
                      (SELECT count(*) FROM card WHERE status = 'fail') AS failing
               FROM friction WHERE score >= 40""",
            *FRICTION,
            *ATTENTION,
            *QUALITY,
        ),
        "stacked_views": query(
            """SELECT 'Clinic' AS entity_type, count(*) FILTER (score >= 60) AS queued, max(score) AS highest, count(*) AS of_all
               FROM attention HAVING max(score) >= 60
               UNION ALL SELECT 'ZIP Code', count(*) FILTER (score >= 60), max(score), count(*) FROM friction HAVING max(score) >= 60""",
            *FRICTION,
            *ATTENTION,
        ),
        "load_match": query(
            " UNION ALL ".join(
                f"SELECT '{role}' AS table_name, count(*) AS source_rows, count(*) AS target_rows, true AS equal FROM {table}"
                for role, table in audits.items()
            )
        ),
        "refreshed_trends": query(
            """SELECT CAST(date_trunc('month', day) AS DATE) AS month, count(DISTINCT referral_id) AS referrals, count(*) AS appointments
               FROM visit JOIN referral USING (referral_id) GROUP BY 1"""
        ),
        "csv_rescan": """SELECT role, count(*) AS turns, CAST(sum(turn) AS BIGINT) AS turn_sum, CAST(sum(length(text)) AS BIGINT) AS characters,
                                CAST(sum(length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS line_ends
                         FROM conversations GROUP BY role""",
        "json_rescan": query("SELECT * FROM modes", MODES),
        "bucketed_lag": query(
            """SELECT mode AS visit_mode, priority AS referral_priority, count(*) AS appointments,
                      median(date_diff('day', created, day)) AS median_lag
               FROM visit JOIN referral USING (referral_id) GROUP BY ALL"""
        ),
        "coerced_numbers": """SELECT event_type, sum(coalesce(TRY_CAST(substr(props, 7, 2) AS DOUBLE), 0)) AS total,
                                     count(*) FILTER (TRY_CAST(substr(props, 7, 2) AS DOUBLE) IS NULL) AS not_numbers
                              FROM events GROUP BY event_type""",
        "repeated_keys": query(
            " UNION ALL ".join(
                f"SELECT '{role}' AS table_name, (SELECT count(*) FROM (SELECT {key} FROM {table} GROUP BY {key} "
                f"HAVING count({key}) > 1)) AS repeated_keys"
                for role, table, key in (
                    ("referral", "referral", "referral_id"),
                    ("appointment", "visit", "appointment_id"),
                    ("patient", "person", "patient_id"),
                    ("clinic", "clinic", "clinic_id"),
                )
            )
        ),
        "dq_scorecard": query("SELECT * FROM card", *QUALITY),
        "dq_summary": query("SELECT * FROM checked", *QUALITY),
        "dq_by_table": query(
            """SELECT table_name, count(*) AS rule_count, count(*) FILTER (status = 'fail') AS failed_rules,
                      CAST(sum(failed_row_count) AS BIGINT) AS failed_row_count FROM card GROUP BY table_name""",
            *QUALITY,
        ),
        "orphan_rows": query(
            """SELECT encounter_id, count(*) AS row_count FROM followup
               WHERE encounter_id NOT IN (SELECT encounter_id FROM encounter) GROUP BY encounter_id"""
        ),
    }
