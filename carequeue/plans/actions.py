"""Action queue, funnel drop-off, metric context, summary text, scenarios and weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carequeue.functions.expressions import one_decimal, round_even, safe_pct
from carequeue.operators.scores import ordered
from carequeue.params import Filters, Settings
from carequeue.plans.views import funnel

# Texts, thresholds and row limits of the queue.
CLINIC_ACTION = "Review intake slots, aging referrals, reminder workflows, and scheduling backlog."
ZIP_ACTION = "Review access barriers, reminder workflows, and telehealth scheduling options."
ZIP_OPEN_PCT = 20
PAGE_ZIPS = 10
TOP_ACTIONS = 5
WEIGHT_LABELS = {
    "clinic": ("Clinic Attention", ["Lag", "No-show", "Open aging", "Capacity"]),
    "zip": (
        "ZIP Friction",
        ["Lag", "No-show", "Transportation", "Underinsured", "Limited English", "Open aging", "Low telehealth"],
    ),
}
NO_CLINIC = "insufficient clinic data"
SUMMARY_TEXT = """### Executive Summary
Behavioral health access performance was reviewed using structured operational metrics only. The dashboard currently shows {total_referrals} total referrals, a median referral-to-appointment lag of {median_lag} days, an appointment completion rate of {completion}%, and a no-show rate of {no_show}%.

### Key Changes
Trend comparison requires a configured prior-period metric extract. Current-period open referrals over 21 days: {open_referrals}.

### Clinics Needing Attention
The clinic most needing operational review is: {clinic}.

### Possible Operational Drivers
Potential operational drivers include referral backlog, intake slot availability, appointment wait time, no-show patterns, and ZIP-code access friction. These are operational hypotheses based on aggregated metrics, not clinical conclusions.

### Recommended Operational Actions
1. Review open referrals older than 21 days.
2. Check intake slot capacity for clinics with high referral lag.
3. Prioritize reminder outreach for high no-show-risk appointment segments.
4. Evaluate telehealth scheduling options for ZIP codes with high access friction.

### Data Quality Caveats
Current data quality score: {quality}%. Interpret metrics cautiously if critical data quality rules are failing.
"""


def dynamic_action_queue(
    clinics: DataFrame, zips: DataFrame, settings: Settings = Settings(), zip_rows: int | None = None
) -> DataFrame:
    """Clinics and ZIP codes that cross a threshold, with the metrics that did; of the ``zip_rows`` highest ZIP codes, if given."""
    clinic_triggers = [
        _trigger("median_referral_to_appointment_days", f">= {settings.high_lag_days}", "median lag ", " days"),
        _trigger("no_show_rate_pct", f">= {settings.high_no_show_pct}", "no-show rate ", "%"),
        f"CASE WHEN open_referrals_over_threshold > 0 THEN concat(CAST(open_referrals_over_threshold AS STRING), "
        f"' open referrals older than {settings.aging_days} days') END",
        _trigger("monthly_capacity_utilization_pct", f">= {settings.high_capacity_pct}", "capacity utilization ", "%"),
    ]
    zip_triggers = [
        _trigger("custom_access_friction_score", f">= {settings.high_friction}", "access friction ", ""),
        _trigger("no_show_rate_pct", f">= {settings.high_no_show_pct}", "no-show rate ", "%"),
        _trigger("open_over_21_rate_pct", f">= {ZIP_OPEN_PCT}", "open aging rate ", "%"),
    ]
    highest = zips
    if zip_rows is not None:
        highest = top(zips, zip_rows, ("custom_access_friction_score", False), ("zip_code", True))
    queue = clinics.selectExpr(
        "'Clinic' AS entity_type",
        "CAST(clinic_name AS STRING) AS entity_name",
        "clinic_attention_index AS priority_score",
        f"'{CLINIC_ACTION}' AS recommended_action",
        f"concat_ws('; ', {', '.join(clinic_triggers)}) AS triggering_metrics",
    ).unionByName(
        highest.selectExpr(
            "'ZIP Code' AS entity_type",
            "CAST(zip_code AS STRING) AS entity_name",
            "custom_access_friction_score AS priority_score",
            f"'{ZIP_ACTION}' AS recommended_action",
            f"concat_ws('; ', {', '.join(zip_triggers)}) AS triggering_metrics",
        )
    )
    return ordered(
        queue.where("triggering_metrics <> ''"), ("priority_score", False), ("entity_type", True), ("entity_name", True)
    )


def _trigger(metric: str, test: str, before: str, after: str) -> str:
    return f"CASE WHEN {metric} {test} THEN concat('{before}', {one_decimal(metric)}, '{after}') END"


def top(frame: DataFrame, rows: int, *order: tuple[str, bool]) -> DataFrame:
    """The first rows by the given (column, ascending) order, nulls last; end it with a unique column."""
    return ordered(frame, *order).limit(rows)


def clinic_overview(clinics: DataFrame, rows: int = 8) -> DataFrame:
    """The clinics that most need attention, in the columns of the overview."""
    return top(clinics, rows, ("clinic_attention_index", False), ("clinic_id", True)).select(
        "clinic_name",
        "clinic_group",
        "clinic_attention_index",
        "median_referral_to_appointment_days",
        "completion_rate_pct",
        "no_show_rate_pct",
        "open_referrals_over_threshold",
    )


def funnel_dropoff(mart) -> DataFrame:
    """The funnel with each stage's share of the largest stage and its loss from the stage before."""
    # Five rows, one per stage: a window without partitions is bounded by the number of stages.
    stages = W.orderBy("stage_order")
    whole = stages.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        funnel(mart)
        .withColumns(
            {
                "_most": F.max("stage_count").over(whole),
                "_prior": F.lag("stage_count").over(stages),
            }
        )
        .selectExpr(
            "stage",
            "stage_order",
            "stage_count",
            f"{round_even('100D * stage_count / nullif(_most, 0)', 2)} AS conversion_from_created_pct",
            "coalesce(_prior - stage_count, 0L) AS dropoff_from_prior_stage",
        )
    )


def largest_dropoff(mart) -> DataFrame:
    """The stage that loses most against the one before it."""
    return top(funnel_dropoff(mart), 1, ("dropoff_from_prior_stage", False), ("stage_order", True))


def metric_context(
    kpi: DataFrame, clinics: DataFrame, queue: DataFrame, quality: DataFrame, filters: Filters, settings: Settings
) -> DataFrame:
    """One row with everything the summary may use, nested and as JSON text.

    ``kpi`` and ``quality`` have one row; of the clinics and the queue only the first few rows in
    order are used.
    """
    worst = top(clinics, 1, ("clinic_attention_index", False), ("clinic_id", True))
    actions = top(queue, TOP_ACTIONS, ("priority_score", False), ("entity_type", True), ("entity_name", True))
    fields = ["entity_type", "entity_name", "priority_score", "recommended_action", "triggering_metrics"]
    ordered = ", ".join(["-priority_score AS _rank", *fields])
    plain = ", ".join(f"'{name}', a.{name}" for name in fields)
    return kpi.sparkSession.sql(
        f"""SELECT named_struct(
                'analysis_window', named_struct('start_date', '{filters.start}', 'end_date', '{filters.end}'),
                'settings', named_struct(
                    'open_referral_aging_threshold_days', {settings.aging_days},
                    'high_median_lag_threshold_days', {settings.high_lag_days},
                    'high_no_show_threshold_pct', {settings.high_no_show_pct},
                    'high_capacity_threshold_pct', {settings.high_capacity_pct},
                    'high_access_friction_threshold', {settings.high_friction}),
                'total_referrals', total_referrals,
                'median_referral_to_appointment_days', median_lag_days,
                'completion_rate_pct', completion_rate_pct,
                'no_show_rate_pct', no_show_rate_pct,
                'open_referrals_over_threshold', open_referrals_over_threshold,
                'average_access_friction_score', avg_access_friction,
                'clinic_needing_attention',
                    coalesce((SELECT first(clinic_name) FROM {{worst}}), '{NO_CLINIC}'),
                'data_quality_score_pct', (SELECT max(data_quality_score_pct) FROM {{quality}}),
                'top_operational_actions', (
                    SELECT transform(array_sort(collect_list(named_struct({_struct_args(ordered)}))),
                                     a -> named_struct({plain}))
                    FROM {{actions}})
            ) AS metrics
            FROM {{kpi}}""",
        kpi=kpi,
        worst=worst,
        quality=quality,
        actions=actions,
    )


def _struct_args(columns: str) -> str:
    pairs = []
    for item in columns.split(", "):
        expression, _, alias = item.partition(" AS ")
        pairs.append(f"'{alias or expression}', {expression}")
    return ", ".join(pairs)


def context_json(context: DataFrame) -> DataFrame:
    return context.selectExpr("to_json(metrics) AS metrics_json")


def executive_summary(context: DataFrame) -> DataFrame:
    """The summary text for each metric context; a missing metric reads "unknown"."""
    holes = {
        "total_referrals": "metrics.total_referrals",
        "median_lag": "metrics.median_referral_to_appointment_days",
        "completion": "metrics.completion_rate_pct",
        "no_show": "metrics.no_show_rate_pct",
        "open_referrals": "metrics.open_referrals_over_threshold",
        "clinic": "metrics.clinic_needing_attention",
        "quality": "metrics.data_quality_score_pct",
    }
    text = F.lit(SUMMARY_TEXT)
    for hole, column in holes.items():
        default = NO_CLINIC if hole == "clinic" else "unknown"
        value = F.coalesce(F.col(column).cast("string"), F.lit(default))
        text = F.replace(text, F.lit("{" + hole + "}"), value)
    return context.select(text.alias("summary"))


def outreach_scenarios(kpi: DataFrame, reductions: Sequence[int]) -> DataFrame:
    """What each percentage cut in no-shows would recover."""
    grid = ", ".join(str(int(value)) for value in reductions)
    return kpi.selectExpr("*", f"explode(array({grid})) AS reduction_pct").selectExpr(
        "reduction_pct",
        "no_show_appointments AS current_no_shows",
        "CAST(rint(no_show_appointments * reduction_pct / 100D) AS BIGINT) AS recovered_appointments",
        "total_appointments",
        "completed_appointments",
    ).selectExpr(
        "reduction_pct",
        "current_no_shows",
        "recovered_appointments",
        f"{safe_pct('greatest(current_no_shows - recovered_appointments, 0L)', 'total_appointments')} "
        "AS scenario_no_show_rate_pct",
        f"{safe_pct('(completed_appointments + recovered_appointments)', 'total_appointments')} "
        "AS scenario_completion_rate_pct",
    )


def capacity_scenarios(kpi: DataFrame, clinics: DataFrame, extra_slots: Sequence[int]) -> DataFrame:
    """How much of the backlog each number of added weekly slots for each row of ``clinics`` would cover."""
    grid = ", ".join(str(int(value)) for value in extra_slots)
    return kpi.sparkSession.sql(
        f"""SELECT extra_slots_per_week, added AS added_monthly_slots, backlog,
                   least(backlog, added) AS potential_backlog_coverage
            FROM (SELECT extra_slots_per_week, backlog, extra_slots_per_week * clinics * 4L AS added
                  FROM (SELECT explode(array({grid})) AS extra_slots_per_week,
                               open_referrals_over_threshold AS backlog,
                               (SELECT count(*) FROM {{clinics}}) AS clinics
                        FROM {{kpi}}))""",
        kpi=kpi,
        clinics=clinics,
    )


def weights_table(spark: SparkSession, settings: Settings = Settings()) -> DataFrame:
    """The weights in use, one row per score and component."""
    rows = []
    for weights, (score, labels) in (
        (settings.clinic_weights, WEIGHT_LABELS["clinic"]),
        (settings.zip_weights, WEIGHT_LABELS["zip"]),
    ):
        rows += [(score, label, weight) for label, weight in zip(labels, weights.shares().values(), strict=True)]
    frame = spark.createDataFrame(rows, "score string, component string, weight double")
    return frame.selectExpr("*", f"{round_even('100D * weight', 1)} AS weight_pct")
