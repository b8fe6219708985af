"""The queries the entry point registers: every report bound to the TPC-H-like tables."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carequeue.functions.expressions import LAG, flag, number_or_zero
from carequeue.operators.settle import scratch_folder, settled, stored
from carequeue.operators.summary import summarise
from carequeue.params import ClinicWeights, Filters, Selection, Settings, ZipWeights
from carequeue.plans import actions, catalog, dashboard, quality, questions, risk, views
from carequeue.plans.linked import Page
from carequeue.session import bounded_tasks
from carequeue.sources import versions
from carequeue.sources.files import load_audit, read_csv, repeated_keys, save_bucketed, write_csv, write_json
from carequeue.sources.tpch import ROLES, TpchMart

SETTINGS = Settings(as_of=date(2001, 8, 1))
CHECKED_AT = datetime(2001, 8, 1)
INSURANCE = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
MODES = ["in_person", "telehealth"]
WINDOW = Filters(
    date(1997, 7, 1),
    date(1999, 6, 30),
    visit_modes=Selection(MODES, MODES),
    insurance_types=Selection(["BUILDING", "HOUSEHOLD", "MACHINERY"], INSURANCE),
)
EVERYTHING = Filters(visit_modes=Selection(MODES, MODES), insurance_types=Selection(INSURANCE, INSURANCE))

# Weights whose sum is not 100, and none at all.
WEIGHTED = replace(SETTINGS, clinic_weights=ClinicWeights(50, 10, 0, 5), zip_weights=ZipWeights(9, 0, 30, 0, 1, 2, 3))
UNWEIGHTED = replace(SETTINGS, clinic_weights=ClinicWeights(0, 0, 0, 0))
CLINICS = ["NATION_1", "NATION_7", "NATION_12", "NATION_20"]
SELECTED = Filters(
    clinics=Selection(CLINICS, [*CLINICS, "NATION_2"]),
    appointment_types=Selection(["MEDIUM", "PROMO"], ["LARGE", "MEDIUM", "PROMO", "STANDARD"]),
)

# What a question is put together from: the event's own words before and after one of these, by type and parity.
ASKED = {
    ("view", 0): "slowest clinic by waiting LAG",
    ("view", 1): "has access IMPROVED in any clinic",
    ("signup", 0): "count of referrals left open past the limit",
    ("signup", 1): "biggest drop in our funnel",
    ("error", 0): "worst zip for friction",
    ("error", 1): "no-show rate for each appointment type",
    ("click", 0): "telehealth against in person",
    ("click", 1): "any Provider short of capacity",
    ("purchase", 0): "segment that seldom completes",
    ("purchase", 1): "summary for leadership",
}


def scan_projection(mart) -> DataFrame:
    return mart.table("referral", "referral_id", "referral_priority", "referral_created_date", "referral_status")


def filter_in_list(mart) -> DataFrame:
    kept = Selection(["completed", "no_show", "canceled"], ["scheduled", *risk.OUTCOMES])
    rows = mart.table("appointment", "appointment_status", "visit_mode").where(
        kept.predicate(F.col("appointment_status"))
    )
    return summarise(rows, ["appointment_status", "visit_mode"], counts={"appointment_count": "1"})


def filter_selections(mart) -> DataFrame:
    """Per visit mode, the appointments that pass an empty, a partial and a full selection of statuses."""
    statuses = list(risk.OUTCOMES)
    choices = {
        "empty_selection": Selection([], statuses),
        "partial_selection": Selection(statuses[:2], statuses),
        "full_selection": Selection(statuses, statuses),
    }
    rows = mart.table("appointment", "visit_mode", "appointment_status")
    for name, choice in choices.items():
        test = choice.predicate(F.col("appointment_status"))
        rows = rows.withColumn(name, F.lit(True) if test is None else test)
    return summarise(rows, ["visit_mode"], counts={name: flag(name) for name in choices})


def audit(mart) -> DataFrame:
    return load_audit({role: mart.table(role, *own) for role, (_, own) in ROLES.items()})


def load_match(mart) -> DataFrame:
    """Rows of every role's table as read and as stored, by a refresh of them all."""
    target = scratch_folder(mart.spark)
    mart = TpchMart(versions.loading_session(mart.spark), mart.folder)
    frames = {role: mart.table(role, *own) for role, (_, own) in ROLES.items()}
    found = versions.refresh(frames, target, {"appointment": ("appointment_date", "appointment_id")})
    versions.remove(mart.spark, target)
    return found


def refreshed_trends(mart) -> DataFrame:
    """Referrals and appointments by month, of tables that were refreshed twice, read as they were before the second time."""
    spark, target = mart.spark, scratch_folder(mart.spark)
    source = TpchMart(versions.loading_session(spark), mart.folder)
    frames = {role: source.table(role, *ROLES[role][1]) for role in ("referral", "appointment")}
    versions.refresh(frames, target)
    opened = {role: spark.read.parquet(f"{versions.current(spark, target)}/{role}.parquet") for role in frames}
    versions.refresh({role: frame.limit(0) for role, frame in frames.items()}, target)
    found = settled(
        spark.sql(
            """SELECT trunc(appointment_date, 'month') AS month, count(DISTINCT r.referral_id) AS referrals, count(*) AS appointments
               FROM {appointment} a JOIN {referral} r ON a.referral_id = r.referral_id GROUP BY 1""",
            **opened,
        )
    )
    versions.remove(spark, target)
    return found


def csv_rescan(mart) -> DataFrame:
    """What was said, by role, after a round trip through CSV files whose cells hold line ends."""
    target = scratch_folder(mart.spark)
    write_csv(mart.raw("conversations"), target)
    again = read_csv(mart.spark, target, "role string, text string, turn bigint", multi_line=True)
    found = settled(
        again.groupBy("role").agg(
            F.count("*").alias("turns"), F.sum("turn").alias("turn_sum"), F.sum(F.length("text")).alias("characters"),
            F.sum(F.regexp_count("text", F.lit("\n"))).alias("line_ends"),
        )
    )
    versions.remove(mart.spark, target)
    return found


def json_rescan(mart) -> DataFrame:
    """The rates by visit mode, after a round trip through JSON."""
    target = scratch_folder(mart.spark)
    report = dashboard.visit_mode_no_show(mart, EVERYTHING)
    write_json(report, target)
    found = settled(mart.spark.read.schema(report.schema).json(target))
    versions.remove(mart.spark, target)
    return found


def bucketed_lag(mart) -> DataFrame:
    """Lag by visit mode and priority over facts that are bucketed by referral, so that their join shuffles nothing."""
    facts = {
        "referral": mart.table("referral", "referral_id", "referral_created_date", "referral_priority"),
        "appointment": mart.table("appointment", "referral_id", "appointment_date", "visit_mode"),
    }
    names = {role: f"bucketed_{role}_{uuid4().hex}" for role in facts}
    sort = {names["referral"]: "referral_created_date", names["appointment"]: "appointment_date"}
    save_bucketed({names[role]: frame for role, frame in facts.items()}, "referral_id", 16, sort)
    referrals, visits = (mart.spark.table(names[role]) for role in facts)
    rows = visits.join(referrals, "referral_id")
    found = settled(summarise(rows, ["visit_mode", "referral_priority"], {"appointments": "1"}, {"median_lag": LAG}))
    for name in names.values():
        mart.spark.sql(f"DROP TABLE {name}")
    return found


def coerced_numbers(mart) -> DataFrame:
    """Two characters of each event's properties as a number, which some are not, by event type."""
    number = number_or_zero("substr(props, 7, 2)")
    return mart.raw("events").groupBy("event_type").agg(
        F.sum(F.expr(number)).alias("total"), F.count_if(F.expr("try_cast(substr(props, 7, 2) AS DOUBLE) IS NULL")).alias("not_numbers")
    )


def scorecard(mart) -> DataFrame:
    return quality.scorecard(mart, SETTINGS, CHECKED_AT)


def through_views(mart) -> DataFrame:
    """ZIP codes of high friction beside the clinics' worst attention index, read through the registered names."""
    return catalog.create_views(mart, SETTINGS, scorecard(mart)).sql(
        """SELECT zip_code, access_friction_score, (SELECT max(clinic_attention_index) FROM vw_clinic_attention_index) AS worst,
                  (SELECT count(*) FROM vw_data_quality_scorecard WHERE status = 'fail') AS failing
           FROM vw_zip_access_friction WHERE access_friction_score >= 40"""
    )


def stacked_views(mart) -> DataFrame:
    """What the queue holds of each kind, and how many ZIP codes and clinics it was chosen from, through the views as planned."""
    catalog.create_views(mart, SETTINGS, scorecard(mart))
    return mart.spark.sql(
        """SELECT entity_type, count(*) AS queued, max(priority_score) AS highest,
                  CASE entity_type WHEN 'Clinic' THEN (SELECT count(*) FROM vw_clinic_attention_index)
                                   ELSE (SELECT count(*) FROM vw_zip_access_friction) END AS of_all
           FROM vw_operational_action_queue GROUP BY entity_type"""
    )


def repeated(mart) -> DataFrame:
    tables = {role: mart.table(role, key) for role, key in ROLE_KEYS.items()}
    return repeated_keys(tables, ROLE_KEYS)


def orphan_rows(mart) -> DataFrame:
    """Follow-ups of encounters that are not there, by encounter."""
    return quality.orphan_keys(mart, "followup", "encounter_id", "encounter")


def stand_in(mart) -> DataFrame:
    """Scored appointments with a fixed formula in place of the model."""
    columns = ["prior_no_show_count", "days_from_scheduled_to_appointment"]
    return risk.feature_table(mart, SETTINGS, columns=columns).selectExpr(
        "appointment_id",
        "no_show_target",
        "(prior_no_show_count * 7 + days_from_scheduled_to_appointment) / 113D AS predicted_no_show_probability",
    ).selectExpr("*", f"{risk.risk_bucket('predicted_no_show_probability')} AS risk_bucket")


def feature_imputed(mart) -> DataFrame:
    return risk.impute(stored(risk.feature_table(mart, SETTINGS)))


def fill_values(mart) -> DataFrame:
    return risk.fill_values(risk.feature_table(mart, SETTINGS))


def risk_scores(mart) -> DataFrame:
    features = stored(risk.feature_table(mart, SETTINGS))
    return risk.predictions(risk.score(risk.train(features), features))


def risk_scores_check(mart) -> DataFrame:
    """Rows the model scores, those whose probability is one, and those in the bucket of their probability."""
    return risk_scores(mart).selectExpr(
        "count(*) AS scored",
        "count_if(predicted_no_show_probability BETWEEN 0 AND 1) AS probable",
        f"count_if(risk_bucket = {risk.risk_bucket('predicted_no_show_probability')}) AS in_bucket",
        "count(DISTINCT appointment_id) AS appointments",
    )


def split_counts(mart) -> DataFrame:
    return risk.split_counts(stored(risk.feature_table(mart, SETTINGS, columns=[])))


def class_weights(mart) -> DataFrame:
    features = stored(risk.feature_table(mart, SETTINGS, columns=[]))
    return risk.class_weights(features.where(f"NOT {risk.hold_out(features)}"))


def scaling(mart) -> DataFrame:
    learn, _ = risk.training_part(stored(risk.feature_table(mart, SETTINGS)))
    return risk.scaling(learn).selectExpr("feature", "round(mean, 6) AS mean", "round(deviation, 6) AS deviation")


def model_fit_check(mart) -> DataFrame:
    """The fitted coefficients' names, and how far each is from the optimum, to three digits."""
    features = stored(risk.feature_table(mart, SETTINGS))
    found = risk.optimality(risk.train(features), features)
    return found.selectExpr("feature", "value", "round(residual, 3) AS residual")


def score_check(mart) -> DataFrame:
    """Appointments, and those whose score is what the coefficients give when added up by hand."""
    features = stored(risk.feature_table(mart, SETTINGS))
    model = risk.train(features)
    learn, _ = risk.training_part(features, model)
    # Appointments may repeat their ids: rows get numbers. A row's score goes along with what is added up, so they need no join.
    rows = risk.scored(model, features).withColumn("appointment_id", F.monotonically_increasing_id())
    sums = mart.spark.sql(
        f"""SELECT appointment_id, {risk.PROBABILITY}, 1D / (1D + exp(-sum(x * coefficient))) AS by_hand
            FROM {{cells}} e JOIN {{fitted}} c ON e.feature = c.feature AND e.value <=> c.value GROUP BY appointment_id, {risk.PROBABILITY}""",
        cells=risk.encoded(rows.drop(risk.TARGET), risk.scaling(learn)),
        fitted=risk.coefficients(model),
    )
    return sums.selectExpr(
        "count(*) AS scored", f"count_if(abs({risk.PROBABILITY} - by_hand) < 1e-9) AS added_up"
    )


def model_metrics(mart) -> DataFrame:
    features = stored(risk.feature_table(mart, SETTINGS))
    return risk.metrics_document(stored(risk.score(risk.train(features), features))).selectExpr(
        "accuracy", "precision", "recall", "f1", "roc_auc", "to_json(confusion_matrix) AS confusion_matrix"
    )


def stand_in_auc(mart) -> DataFrame:
    return risk.area_under_curve(stand_in(mart)).selectExpr("round(roc_auc * 10000, 0) / 10000 AS roc_auc")


def queue(mart, zip_rows: int | None = None) -> DataFrame:
    mart = Page(mart)
    clinics = dashboard.clinic_report(mart, EVERYTHING, SETTINGS)
    return actions.dynamic_action_queue(clinics, dashboard.zip_report(mart, SETTINGS), SETTINGS, zip_rows)


def page_totals(mart) -> DataFrame:
    """Rows and appointments of the filtered reports of one page, which read one join."""
    page = Page(mart)
    friction = views.zip_friction(page, SETTINGS)
    return mart.spark.sql(
        """SELECT (SELECT total_appointments FROM {kpi}) AS kpi, (SELECT sum(appointment_volume) FROM {clinics}) AS clinics,
                  (SELECT sum(appointment_volume) FROM {trend}) AS trend, (SELECT sum(appointment_count) FROM {kinds}) AS kinds,
                  (SELECT sum(appointment_count) FROM {modes}) AS modes, (SELECT sum(appointment_count) FROM {providers}) AS providers,
                  (SELECT sum(referral_volume) FROM {friction}) AS referrals""",
        kpi=dashboard.kpis(page, WINDOW, SETTINGS, friction),
        clinics=dashboard.clinic_report(page, WINDOW, SETTINGS),
        trend=dashboard.access_trends(page, WINDOW, "month"),
        kinds=dashboard.appointment_type_no_show(page, WINDOW),
        modes=dashboard.visit_mode_no_show(page, WINDOW),
        providers=dashboard.provider_report(page, WINDOW),
        friction=friction,
    )


def context(mart) -> DataFrame:
    mart = Page(mart)
    clinics = dashboard.clinic_report(mart, WINDOW, SETTINGS)
    friction = views.zip_friction(mart, SETTINGS)
    found = actions.dynamic_action_queue(clinics, dashboard.zip_report(mart, SETTINGS, friction), SETTINGS, actions.PAGE_ZIPS)
    kpi = dashboard.kpis(mart, WINDOW, SETTINGS, friction)
    checked = quality.quality_summary(scorecard(mart))
    return actions.metric_context(kpi, clinics, found, checked, WINDOW, SETTINGS)


def question_route(mart) -> DataFrame:
    """Routes of questions made of events' columns, and of what conversations say (which mostly asks nothing we answer)."""
    cases = " ".join(
        f"WHEN event_type = '{kind}' AND event_id % 2 = {digit} THEN '{text}'" for (kind, digit), text in ASKED.items()
    )
    asked = mart.raw("events").selectExpr(
        "event_id AS question_id", f"concat_ws(' ', ' User', user_id, event_type, CASE {cases} END, props, value, ' ') AS question"
    )
    said = mart.raw("conversations").selectExpr("-(conv_id * 1000 + turn) - 1 AS question_id", "text AS question")
    routed = questions.with_route(asked.unionByName(said))
    return routed.select("question_id", "route")


def answered(route: str):
    return lambda mart: questions.answer(route, mart, EVERYTHING, SETTINGS).text


def clinic_top_lag(mart) -> DataFrame:
    report = dashboard.clinic_report(mart, EVERYTHING, SETTINGS).select(
        "clinic_id", "clinic_name", "median_referral_to_appointment_days"
    )
    return actions.top(report, 10, ("median_referral_to_appointment_days", False), ("clinic_id", True))


ROLE_KEYS = {"referral": "referral_id", "appointment": "appointment_id", "patient": "patient_id", "clinic": "clinic_id"}

MART_QUERIES = {
    "through_views": through_views,
    "stacked_views": stacked_views,
    "repeated_keys": repeated,
    "scan_projection": scan_projection,
    "load_audit": audit,
    "load_match": load_match,
    "refreshed_trends": refreshed_trends,
    "csv_rescan": csv_rescan,
    "json_rescan": json_rescan,
    "bucketed_lag": bucketed_lag,
    "coerced_numbers": coerced_numbers,
    "filter_in_list": filter_in_list,
    "filter_empty_selection": filter_selections,
    "referral_lag": lambda m: views.referral_lag(m, SETTINGS),
    "appointment_completion": views.appointment_completion,
    "no_show_summary": views.no_show_summary,
    "open_aging": lambda m: views.open_referral_aging(m, SETTINGS),
    "open_aging_buckets": lambda m: views.open_aging_buckets(m, SETTINGS),
    "funnel": views.funnel,
    "provider_capacity_all": views.provider_capacity_all,
    "zip_friction": lambda m: views.zip_friction(m, SETTINGS),
    "clinic_performance": lambda m: views.clinic_performance(m, SETTINGS),
    "weekly_access_trends": views.weekly_access_trends,
    "clinic_attention_index": lambda m: views.clinic_attention_index(m, SETTINGS),
    "segment_completion_gap": views.segment_completion_gap,
    "action_queue_static": lambda m: views.action_queue(m, SETTINGS),
    "date_bounds": dashboard.date_bounds,
    "period_presets": dashboard.period_presets,
    "filter_options": dashboard.filter_options,
    "filter_all_selected": lambda m: dashboard.kpis(m, EVERYTHING, SETTINGS),
    "kpi_window": lambda m: dashboard.kpis(m, WINDOW, SETTINGS),
    "kpi_prior_period": lambda m: dashboard.kpi_comparison(m, WINDOW, SETTINGS),
    "kpi_delta": lambda m: dashboard.kpi_delta(m, WINDOW, SETTINGS),
    "clinic_perf_filtered": lambda m: dashboard.clinic_report(m, EVERYTHING, SETTINGS),
    "access_trends_day": lambda m: dashboard.access_trends(m, EVERYTHING, "day"),
    "access_trends_week": lambda m: dashboard.access_trends(m, EVERYTHING, "week"),
    "access_trends_month": lambda m: dashboard.access_trends(m, EVERYTHING, "month"),
    "access_trends_year": lambda m: dashboard.access_trends(m, EVERYTHING, "year"),
    "trends_long": lambda m: dashboard.trends_long(m, EVERYTHING, "month"),
    "zip_friction_custom": lambda m: dashboard.zip_report(m, SETTINGS),
    "appt_type_no_show": lambda m: dashboard.appointment_type_no_show(m, EVERYTHING),
    "visit_mode_no_show": lambda m: dashboard.visit_mode_no_show(m, EVERYTHING),
    "visit_mode_compare": lambda m: questions.compare_visit_modes(dashboard.visit_mode_no_show(m, EVERYTHING)),
    "segment_completion": lambda m: dashboard.segment_completion(m, EVERYTHING, SETTINGS),
    "segment_label": lambda m: dashboard.segment_labels(dashboard.segment_completion(m, EVERYTHING, SETTINGS)),
    "provider_capacity": lambda m: dashboard.provider_report(m, EVERYTHING),
    "improvement_last30": lambda m: dashboard.clinic_improvement(m, EVERYTHING),
    "action_queue_dynamic": queue,
    "action_queue_page": lambda m: queue(m, actions.PAGE_ZIPS),
    "funnel_dropoff": actions.funnel_dropoff,
    "funnel_largest_drop": actions.largest_dropoff,
    "clinic_top_lag": clinic_top_lag,
    "clinic_overview": lambda m: actions.clinic_overview(dashboard.clinic_report(m, EVERYTHING, SETTINGS)),
    "clinic_open_aging": lambda m: questions.answer("open_aging", m, EVERYTHING, SETTINGS).rows,
    "scenario_outreach": lambda m: actions.outreach_scenarios(
        dashboard.counts(m, WINDOW, SETTINGS), range(0, 51, 10)
    ),
    "scenario_capacity": lambda m: actions.capacity_scenarios(
        dashboard.counts(m, WINDOW, SETTINGS), m.table("clinic", "clinic_id"), range(0, 31, 5)
    ),
    "kpi_selected": lambda m: dashboard.kpis(m, SELECTED, SETTINGS),
    "kpi_from": lambda m: dashboard.kpis(m, Filters(start=date(1999, 7, 1)), SETTINGS),
    "kpi_until": lambda m: dashboard.kpis(m, Filters(end=date(1996, 6, 30)), SETTINGS),
    "clinic_perf_weights": lambda m: dashboard.clinic_report(m, EVERYTHING, WEIGHTED),
    "zip_friction_weights": lambda m: dashboard.zip_report(m, WEIGHTED),
    "clinic_perf_no_weights": lambda m: dashboard.clinic_report(m, EVERYTHING, UNWEIGHTED),
    "metric_context": lambda m: actions.context_json(context(m)),
    "executive_summary": lambda m: actions.executive_summary(context(m)),
    "page_totals": page_totals,
    "question_route": question_route,
    **{f"answer_{route}": answered(route) for route, _ in questions.ROUTES},
    "feature_table": lambda m: risk.feature_table(m, SETTINGS),
    "feature_imputed": feature_imputed,
    "fill_values": fill_values,
    "split_counts": split_counts,
    "risk_bucket": lambda m: risk.predictions(stand_in(m)),
    "risk_bucket_summary": lambda m: risk.bucket_summary(stand_in(m)),
    "score_histogram": lambda m: risk.score_histogram(stand_in(m)),
    "top_risk": lambda m: risk.top_risks(stand_in(m)),
    "classification_metrics": lambda m: risk.classification_metrics(stand_in(m)),
    "roc_auc": stand_in_auc,
    "risk_scores": risk_scores,
    "model_metrics": model_metrics,
    "risk_scores_check": risk_scores_check,
    "model_fit_check": model_fit_check,
    "score_check": score_check,
    "class_weights": class_weights,
    "scaling": scaling,
    "dq_scorecard": scorecard,
    "dq_summary": lambda m: quality.quality_summary(scorecard(m)),
    "dq_by_table": lambda m: quality.quality_by_table(scorecard(m)),
    "orphan_rows": orphan_rows,
}


def bind(build):
    return lambda spark, folder: build(TpchMart(bounded_tasks(spark), folder))


def all_queries():
    return {name: bind(build) for name, build in MART_QUERIES.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return views.clinic_attention_index(TpchMart(spark, folder), SETTINGS)
