"""The named reports over the whole mart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carequeue.functions.expressions import (
    CANCELED,
    COMPLETED,
    LAG,
    NO_SHOW,
    RESCHEDULED,
    REVIEW_LAG,
    SCHEDULING_LAG,
    TELEHEALTH,
    aging_bucket,
    first_action,
    flag,
    is_open,
    open_longer_than,
    pct,
    period_start,
    present,
    ratio,
    round_to,
    status,
    utilization,
    weighted_score,
)
from carequeue.operators.joins import COPIES, keep_left, known_only, null_unknown
from carequeue.operators.scores import of_max, with_maxima, with_maxima_planned
from carequeue.operators.settle import settled
from carequeue.operators.summary import distinct_flags, summarise
from carequeue.params import Settings
from carequeue.plans.linked import Page, linked

# Aging threshold, weights, action texts and their thresholds. The dashboard's
# settings do not change them.
AGED = 21
QUEUE_SCORE = 60
ATTENTION_WEIGHTS = {"lag": 0.35, "no_show": 0.25, "open_aging": 0.20, "capacity": 0.20}
FRICTION_WEIGHTS = {
    "lag": 0.25,
    "no_show": 0.20,
    "transportation": 0.15,
    "underinsured": 0.15,
    "language": 0.10,
    "open_aging": 0.10,
    "telehealth": 0.05,
}
CLINIC_ACTIONS = [
    ("median_referral_to_appointment_days", 30, "Review intake slot capacity and prioritize older referrals"),
    ("no_show_rate_pct", 25, "Strengthen reminder outreach and confirmation workflows"),
    ("open_referrals_over_21_days", 25, "Create backlog worklist for referrals older than 21 days"),
    ("monthly_capacity_utilization_pct", 95, "Review provider capacity and scheduling templates"),
]
CLINIC_DEFAULT_ACTION = "Monitor performance and maintain current workflow"
ZIP_ACTIONS = [
    ("access_friction_score", 65, "Review access barriers, reminder workflows, and telehealth availability"),
    ("no_show_rate_pct", 25, "Prioritize appointment confirmation and outreach workflows"),
    ("open_over_21_rate_pct", 20, "Review aging open referrals for this ZIP code"),
]
ZIP_DEFAULT_ACTION = "Monitor access friction trend"
CLINIC_CONTEXT = "Referral lag, no-show rate, open referral aging, and capacity utilization"
ZIP_CONTEXT = "ZIP access friction score, no-show rate, transportation risk, and open referral aging"
STAGES = [
    "Referral Created",
    "Referral Reviewed",
    "Appointment Scheduled",
    "Appointment Completed",
    "Follow-Up Completed",
]

_OUTCOMES = {
    "_appointments": present("appointment_id"),
    "_completed": status(COMPLETED),
    "_no_shows": status(NO_SHOW),
}
_COMPLETION_RATE = f"{pct('_completed', '_appointments')} AS completion_rate_pct"
_NO_SHOW_RATE = f"{pct('_no_shows', '_appointments')} AS no_show_rate_pct"


def referral_lag(mart, settings: Settings = Settings()) -> DataFrame:
    """Referrals by clinic and month of creation; those without a clinic are a group of their own."""
    referrals = mart.table(
        "referral", "referral_id", "referral_created_date", "referral_reviewed_date", "referral_status"
    )
    visits = mart.table("appointment", "referral_id", "clinic_id", "appointment_scheduled_date", "appointment_date")
    # Visits are folded by these columns; their ids and outcomes are not asked for.
    rows = null_unknown(keep_left(referrals, visits, "referral_id"), mart.table("clinic", "clinic_id"), "clinic_id")
    grouped = summarise(
        rows.selectExpr("*", f"{period_start('referral_created_date', 'month')} AS referral_month"),
        ["clinic_id", "referral_month"],
        counts={
            "open_referrals": flag(is_open()),
            "open_referrals_over_21_days": flag(open_longer_than(AGED, settings.today())),
        },
        medians={
            "median_referral_to_review_days": REVIEW_LAG,
            "median_referral_to_scheduled_days": SCHEDULING_LAG,
            "median_referral_to_appointment_days": LAG,
        },
        distinct={"total_referrals": "referral_id"},
        weight=COPIES,
    )
    return grouped.join(mart.table("clinic", "clinic_id", "clinic_name"), "clinic_id", "left").select(
        "clinic_id",
        "clinic_name",
        "referral_month",
        "total_referrals",
        "median_referral_to_review_days",
        "median_referral_to_scheduled_days",
        "median_referral_to_appointment_days",
        "open_referrals",
        "open_referrals_over_21_days",
    )


def appointment_completion(mart) -> DataFrame:
    """Status counts and rates by clinic, appointment type, visit mode and month."""
    outcomes = {
        "completed_appointments": (COMPLETED, "completion_rate_pct"),
        "no_show_appointments": (NO_SHOW, "no_show_rate_pct"),
        "canceled_appointments": (CANCELED, "cancellation_rate_pct"),
        "rescheduled_appointments": (RESCHEDULED, "reschedule_rate_pct"),
    }
    rows = mart.table(
        "appointment", "clinic_id", "appointment_type", "visit_mode", "appointment_date", "appointment_status"
    ).selectExpr("*", f"{period_start('appointment_date', 'month')} AS appointment_month")
    keys = ["clinic_id", "appointment_type", "visit_mode", "appointment_month"]
    grouped = summarise(
        known_only(rows, mart.table("clinic", "clinic_id"), "clinic_id"),
        keys,
        counts={"total_appointments": "1"} | {name: status(value) for name, (value, _) in outcomes.items()},
    )
    return grouped.join(mart.table("clinic", "clinic_id", "clinic_name"), "clinic_id").selectExpr(
        "clinic_id",
        "clinic_name",
        *keys[1:],
        "total_appointments",
        *outcomes,
        *[f"{pct(name, 'total_appointments')} AS {rate}" for name, (_, rate) in outcomes.items()],
    )


def no_show_summary(mart) -> DataFrame:
    """No-show rate, earlier no-shows and lag over eight keys; patients of unknown ZIP drop out."""
    person = ["age_group", "insurance_type", "transportation_risk_flag", "zip_code"]
    keys = ["clinic_id", *person, "appointment_type", "visit_mode"]
    rows = linked(
        mart,
        appointment=["clinic_id", "appointment_type", "visit_mode", "appointment_date", "appointment_status"],
        referral=["referral_created_date"],
        patient=[*person, "prior_no_show_count"],
        clinic=[],
    )
    grouped = summarise(
        known_only(rows, mart.table("zip", "zip_code"), "zip_code"),
        keys,
        counts={
            "total_appointments": "1",
            "no_show_count": status(NO_SHOW),
            "_prior": "prior_no_show_count",
            "_prior_known": present("prior_no_show_count"),
        },
        medians={"median_referral_to_appointment_days": LAG},
    )
    return grouped.join(mart.table("clinic", "clinic_id", "clinic_name"), "clinic_id").selectExpr(
        "clinic_id",
        "clinic_name",
        *keys[1:],
        "total_appointments",
        "no_show_count",
        f"{pct('no_show_count', 'total_appointments')} AS no_show_rate_pct",
        f"{ratio('_prior', '_prior_known')} AS avg_prior_no_show_count",
        "median_referral_to_appointment_days",
    )


def open_referral_aging(mart, settings: Settings = Settings()) -> DataFrame:
    """Every open referral with its age in days and age band."""
    age = f"CAST(datediff({settings.today()}, referral_created_date) AS BIGINT)"
    return (
        mart.table(
            "referral", "referral_id", "patient_id", "referral_priority", "referral_created_date", "referral_status"
        )
        .where(is_open())
        .selectExpr("*", f"{age} AS open_days", f"{aging_bucket(age)} AS aging_bucket")
    )


def open_aging_buckets(mart, settings: Settings = Settings()) -> DataFrame:
    """Open referrals per age band."""
    return mart.spark.sql(
        "SELECT aging_bucket, count(*) AS referral_count, max(open_days) AS oldest_open_days "
        "FROM {rows} GROUP BY aging_bucket",
        rows=open_referral_aging(mart, settings),
    )


def funnel(mart) -> DataFrame:
    """Distinct referrals per stage; the last stage counts distinct encounters instead."""
    referrals = distinct_flags(
        mart.table("referral", "referral_id", "referral_reviewed_date"),
        "referral_id",
        {"reviewed": present("referral_reviewed_date")},
    )
    visits = distinct_flags(
        mart.table("appointment", "referral_id", "appointment_status"),
        "referral_id",
        {"completed": status(COMPLETED)},
    )
    followed = mart.table("followup", "encounter_id", "followup_status").where(f"followup_status = '{COMPLETED}'")
    seen = mart.table("encounter", "encounter_id").distinct()
    both = seen.join(followed.select("encounter_id").distinct(), "encounter_id", "left_semi")
    sources = [
        (referrals, ["referral_id", "reviewed"]),
        (visits, ["referral_id", "completed"]),
        (both.selectExpr("count(encounter_id) AS encounter_id"), ["encounter_id"]),
    ]
    parts, order = [], 0
    for frame, columns in sources:
        stages = []
        for column in columns:
            stages.append(f"'{STAGES[order]}', {order + 1}, {column}")
            order += 1
        parts.append(
            frame.selectExpr(f"stack({len(stages)}, {', '.join(stages)}) AS (stage, stage_order, stage_count)")
        )
    return reduce(DataFrame.unionByName, parts)


def provider_capacity_all(mart) -> DataFrame:
    """Volume and utilisation of every provider, idle ones included."""
    volume = summarise(
        mart.table("appointment", "provider_id", "appointment_id", "appointment_status"),
        ["provider_id"],
        counts=_OUTCOMES,
    )
    providers = mart.table(
        "provider", "provider_id", "provider_name", "clinic_id", "provider_type", "weekly_capacity_slots"
    ).join(mart.table("clinic", "clinic_id", "clinic_name"), "clinic_id")
    return (
        providers.join(volume, "provider_id", "left")
        .fillna(0, list(_OUTCOMES))
        .selectExpr(
            "provider_id",
            "provider_name",
            "clinic_name",
            "provider_type",
            "weekly_capacity_slots",
            "_appointments AS appointment_volume",
            "_completed AS completed_appointments",
            "_no_shows AS no_show_appointments",
            f"{utilization('_appointments', 'weekly_capacity_slots')} AS monthly_capacity_utilization_pct",
        )
    )


def placed_referrals(mart) -> DataFrame:
    """Referrals of patients who have a ZIP code, with it."""
    homes = mart.table("patient", "patient_id", "zip_code").where("zip_code IS NOT NULL")
    return (
        mart.table("referral", "referral_id", "patient_id", "referral_created_date", "referral_status")
        .join(homes, "patient_id")
        .select("referral_id", "zip_code", "referral_created_date", "referral_status")
    )


def placed_visits(mart, placed: DataFrame) -> DataFrame:
    """Appointments of the placed referrals; from the rows of a page, if the mart is one."""
    if isinstance(mart, Page):
        return mart.placed_visits()
    visits = mart.table(
        "appointment", "referral_id", "appointment_id", "appointment_date", "appointment_status", "visit_mode"
    )
    return placed.join(visits, "referral_id")


def _zip_metrics(mart, settings: Settings) -> DataFrame:
    """Measures of all referrals by ZIP code, those without appointments included, of one scan of the appointments.

    Of an outer join's rows the report needs sums only. So appointments meet their referrals in an inner join, whose hot
    keys are split, and what referrals without any would add is counted as all referrals less those that were met.
    """
    aged = open_longer_than(AGED, settings.today())
    counts = {
        "_appointments": present("appointment_id"),
        "_no_shows": status(NO_SHOW),
        "_open_rows": flag(aged),
        "_telehealth": flag(f"visit_mode = '{TELEHEALTH}'"),
    }
    placed = placed_referrals(mart)
    met = summarise(
        placed_visits(mart, placed),
        ["zip_code"],
        counts=counts,
        medians={"median_referral_to_appointment_days": LAG},
        distinct={"_met": "referral_id"},
        distinct_where={"_met_open": ("_met", aged)},
    )
    everyone = summarise(placed, ["zip_code"], counts={"referral_volume": present("referral_id"), "_all_open": flag(aged)})
    grouped = everyone.join(met, "zip_code", "left").fillna(0, [*counts, "_met_open"])
    grouped = grouped.withColumn("_open", F.col("_open_rows") + F.col("_all_open") - F.col("_met_open"))
    areas = mart.table(
        "zip", "zip_code", "area_name", "transportation_risk_rate", "underinsured_rate", "limited_english_rate"
    )
    return (
        areas.join(grouped, "zip_code", "left")
        .fillna(0, ["referral_volume", "_open", *counts])
        .selectExpr(
            *areas.columns,
            "referral_volume",
            "median_referral_to_appointment_days",
            _NO_SHOW_RATE,
            f"{pct('_open', 'referral_volume')} AS open_over_21_rate_pct",
            f"{pct('_telehealth', '_appointments')} AS telehealth_usage_pct",
        )
    )


def _scored(base: DataFrame, planned: bool) -> DataFrame:
    return with_maxima_planned(base) if planned else with_maxima(settled(base))


def zip_friction(mart, settings: Settings = Settings(), planned: bool = False) -> DataFrame:
    """Access friction of every ZIP code; a ZIP without telehealth data gets no telehealth penalty.

    The measures are written once, unless the report is only ``planned``.
    """
    score = weighted_score(
        [
            (FRICTION_WEIGHTS["lag"], of_max("median_referral_to_appointment_days")),
            (FRICTION_WEIGHTS["no_show"], of_max("no_show_rate_pct")),
            (FRICTION_WEIGHTS["transportation"], "transportation_risk_rate"),
            (FRICTION_WEIGHTS["underinsured"], "underinsured_rate"),
            (FRICTION_WEIGHTS["language"], "limited_english_rate"),
            (FRICTION_WEIGHTS["open_aging"], of_max("open_over_21_rate_pct")),
            (FRICTION_WEIGHTS["telehealth"], f"1D - {of_max('telehealth_usage_pct')}"),
        ]
    )
    return _scored(_zip_metrics(mart, settings), planned).selectExpr(
        "zip_code",
        "area_name",
        "referral_volume",
        "median_referral_to_appointment_days",
        "no_show_rate_pct",
        "transportation_risk_rate",
        "underinsured_rate",
        "limited_english_rate",
        "telehealth_usage_pct",
        "open_over_21_rate_pct",
        f"{score} AS access_friction_score",
    )


def clinic_performance(mart, settings: Settings = Settings()) -> DataFrame:
    """Volumes, lag, rates and utilisation of every clinic, empty ones included."""
    visits = mart.table(
        "appointment", "clinic_id", "referral_id", "appointment_id", "appointment_date", "appointment_status"
    ).where("clinic_id IS NOT NULL")
    referrals = mart.table("referral", "referral_id", "referral_created_date", "referral_status").selectExpr(
        "*", "referral_id AS known_referral"
    )
    grouped = summarise(
        visits.join(referrals, "referral_id", "left"),
        ["clinic_id"],
        counts=_OUTCOMES | {"open_referrals_over_21_days": flag(open_longer_than(AGED, settings.today()))},
        medians={"median_referral_to_appointment_days": LAG},
        distinct={"referral_volume": "known_referral", "appointment_volume": "appointment_id"},
    )
    clinics = mart.table("clinic", "clinic_id", "clinic_name", "clinic_group", "weekly_intake_slot_capacity")
    return (
        clinics.join(grouped, "clinic_id", "left")
        .fillna(0, ["referral_volume", "appointment_volume", "open_referrals_over_21_days", *_OUTCOMES])
        .selectExpr(
            "clinic_id",
            "clinic_name",
            "clinic_group",
            "referral_volume",
            "appointment_volume",
            "median_referral_to_appointment_days",
            _COMPLETION_RATE,
            _NO_SHOW_RATE,
            "open_referrals_over_21_days",
            "weekly_intake_slot_capacity",
            f"{utilization('appointment_volume', 'weekly_intake_slot_capacity')} AS monthly_capacity_utilization_pct",
        )
    )


def weekly_access_trends(mart) -> DataFrame:
    """Volumes, lag and rates by week and clinic."""
    rows = linked(
        mart,
        appointment=["clinic_id", "appointment_id", "appointment_date", "appointment_status", "visit_mode"],
        referral=["referral_created_date"],
        clinic=[],
    ).selectExpr("*", f"{period_start('appointment_date', 'week')} AS week_start")
    grouped = summarise(
        rows,
        ["week_start", "clinic_id"],
        counts=_OUTCOMES | {"_telehealth": flag(f"visit_mode = '{TELEHEALTH}'")},
        medians={"median_referral_to_appointment_days": LAG},
        distinct={"referral_volume": "referral_id", "appointment_volume": "appointment_id"},
    )
    return grouped.join(mart.table("clinic", "clinic_id", "clinic_name", "clinic_group"), "clinic_id").selectExpr(
        "week_start",
        "clinic_id",
        "clinic_name",
        "clinic_group",
        "referral_volume",
        "appointment_volume",
        "median_referral_to_appointment_days",
        _COMPLETION_RATE,
        _NO_SHOW_RATE,
        f"{pct('_telehealth', '_appointments')} AS telehealth_rate_pct",
    )


def clinic_attention_index(mart, settings: Settings = Settings(), planned: bool = False) -> DataFrame:
    """Attention score and suggested action of every clinic; written and planned as ``zip_friction`` is."""
    base = clinic_performance(mart, settings).selectExpr(
        "*", f"{round_to(ratio('open_referrals_over_21_days', 'referral_volume'), 4)} AS open_over_21_rate"
    )
    score = weighted_score(
        [
            (ATTENTION_WEIGHTS["lag"], of_max("median_referral_to_appointment_days")),
            (ATTENTION_WEIGHTS["no_show"], of_max("no_show_rate_pct")),
            (ATTENTION_WEIGHTS["open_aging"], of_max("open_over_21_rate")),
            (ATTENTION_WEIGHTS["capacity"], of_max("monthly_capacity_utilization_pct")),
        ]
    )
    return _scored(base, planned).selectExpr(
        "clinic_id",
        "clinic_name",
        "clinic_group",
        "referral_volume",
        "appointment_volume",
        "median_referral_to_appointment_days",
        "completion_rate_pct",
        "no_show_rate_pct",
        "open_referrals_over_21_days",
        "open_over_21_rate",
        "monthly_capacity_utilization_pct",
        f"{score} AS clinic_attention_index",
        f"{first_action(CLINIC_ACTIONS, CLINIC_DEFAULT_ACTION)} AS suggested_operational_action",
    )


def segment_completion_gap(mart) -> DataFrame:
    """Completion, no-shows and lag by patient segment and visit mode."""
    person = ["age_group", "insurance_type", "preferred_language", "transportation_risk_flag"]
    keys = [*person, "visit_mode"]
    grouped = summarise(
        linked(
            mart,
            appointment=["appointment_id", "appointment_date", "appointment_status", "visit_mode"],
            referral=["referral_created_date"],
            patient=person,
        ),
        keys,
        counts=_OUTCOMES,
        medians={"median_referral_to_appointment_days": LAG},
    )
    return grouped.selectExpr(
        *keys,
        "_appointments AS appointment_volume",
        _COMPLETION_RATE,
        _NO_SHOW_RATE,
        "median_referral_to_appointment_days",
    )


def action_queue(
    mart, settings: Settings = Settings(), attention: DataFrame | None = None, friction: DataFrame | None = None
) -> DataFrame:
    """Clinics and ZIP codes whose score reaches the threshold, with their action; from the two reports where they are at hand."""
    attention = clinic_attention_index(mart, settings) if attention is None else attention
    friction = zip_friction(mart, settings) if friction is None else friction
    clinics = attention.where(f"clinic_attention_index >= {QUEUE_SCORE}")
    areas = friction.where(f"access_friction_score >= {QUEUE_SCORE}")
    return clinics.selectExpr(
        "'Clinic' AS entity_type",
        "CAST(clinic_name AS STRING) AS entity_name",
        "clinic_attention_index AS priority_score",
        "suggested_operational_action AS recommended_action",
        f"'{CLINIC_CONTEXT}' AS supporting_metric_context",
    ).unionByName(
        areas.selectExpr(
            "'ZIP Code' AS entity_type",
            "CAST(zip_code AS STRING) AS entity_name",
            "access_friction_score AS priority_score",
            f"{first_action(ZIP_ACTIONS, ZIP_DEFAULT_ACTION)} AS recommended_action",
            f"'{ZIP_CONTEXT}' AS supporting_metric_context",
        )
    )
