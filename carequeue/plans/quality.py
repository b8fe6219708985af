"""Data-quality rules as declarations, counted in one pass per table or table pair."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame

from carequeue.functions.expressions import (
    CLOSED,
    COMPLETED,
    MODES,
    NO_SHOW,
    STATUSES,
    flag,
    round_to,
)
from carequeue.params import Settings

# Rules, earliest plausible date and days ahead that a date may lie.
EARLIEST = "2020-01-01"
DAYS_AHEAD = 365


@dataclass(frozen=True)
class Rule:
    rule_id: str
    rule_name: str
    table_name: str
    severity: str


RULES = [
    Rule("DQ001", "patient_id cannot be null", "dim_patient", "critical"),
    Rule("DQ002", "referral_id cannot be null", "fact_referral", "critical"),
    Rule("DQ003", "appointment_id cannot be null", "fact_appointment", "critical"),
    Rule("DQ004", "referral_created_date must be before referral_reviewed_date", "fact_referral", "critical"),
    Rule("DQ005", "referral_created_date must be before appointment_date", "fact_appointment", "critical"),
    Rule("DQ006", "appointment_date cannot be in impossible past or future", "fact_appointment", "warning"),
    Rule("DQ007", "appointment_status must be valid", "fact_appointment", "critical"),
    Rule("DQ008", "visit_mode must be valid", "fact_appointment", "warning"),
    Rule("DQ009", "completed appointments should have encounters", "fact_appointment", "critical"),
    Rule("DQ010", "no-show appointments should not have completed encounters", "fact_appointment", "critical"),
    Rule("DQ011", "closed referrals should have completion or closure reason", "fact_referral", "warning"),
    Rule("DQ012", "ZIP code should be valid", "dim_patient", "warning"),
    Rule("DQ013", "provider_id should exist in dim_provider", "fact_appointment", "critical"),
    Rule("DQ014", "clinic_id should exist in dim_clinic", "fact_appointment", "critical"),
    Rule("DQ015", "appointment referral_id should exist in fact_referral", "fact_appointment", "critical"),
]


def failed_counts(mart, settings: Settings = Settings()) -> DataFrame:
    """(rule_id, failed_row_count) for every rule."""
    passes = [
        _row_rules(mart.table("patient", "patient_id"), {"DQ001": "patient_id IS NULL"}),
        _row_rules(
            mart.table(
                "referral",
                "referral_id",
                "referral_created_date",
                "referral_reviewed_date",
                "referral_status",
                "closure_reason",
            ),
            {
                "DQ002": "referral_id IS NULL",
                "DQ004": "referral_created_date > referral_reviewed_date",
                "DQ011": f"referral_status = '{CLOSED}' AND closure_reason IS NULL",
            },
        ),
        _row_rules(
            mart.table("appointment", "appointment_id", "appointment_date", "appointment_status", "visit_mode"),
            {
                "DQ003": "appointment_id IS NULL",
                "DQ006": f"appointment_date < DATE '{EARLIEST}' "
                f"OR appointment_date > date_add({settings.today()}, {DAYS_AHEAD})",
                "DQ007": f"appointment_status NOT IN ({_listed(STATUSES)})",
                "DQ008": f"visit_mode NOT IN ({_listed(MODES)})",
            },
        ),
        _against_referrals(mart),
        _against_encounters(mart),
        _orphan_count(mart, "DQ012", "patient", "zip_code", "zip"),
        _orphan_count(mart, "DQ013", "appointment", "provider_id", "provider"),
        _orphan_count(mart, "DQ014", "appointment", "clinic_id", "clinic"),
    ]
    return reduce(DataFrame.unionByName, passes)


def _listed(values: list[str]) -> str:
    return ", ".join(f"'{value}'" for value in values)


def _as_rows(sums: DataFrame, rules) -> DataFrame:
    stacked = ", ".join(f"'{rule}', coalesce({rule}, 0L)" for rule in rules)
    return sums.selectExpr(f"stack({len(rules)}, {stacked}) AS (rule_id, failed_row_count)")


def _row_rules(rows: DataFrame, violations: Mapping[str, str]) -> DataFrame:
    """All rules over one table in one scan; a test that is null is not a violation."""
    return _as_rows(rows.selectExpr(*[f"sum({flag(test)}) AS {rule}" for rule, test in violations.items()]), [*violations])


def _against_referrals(mart) -> DataFrame:
    """Appointments before their referral, and appointments without one: one join for both."""
    referrals = mart.table("referral", "referral_id", "referral_created_date").selectExpr("*", "true AS _known")
    rows = mart.table("appointment", "referral_id", "appointment_date").join(referrals, "referral_id", "left")
    return _row_rules(rows, {"DQ005": "referral_created_date > appointment_date", "DQ015": "_known IS NULL"})


def _against_encounters(mart) -> DataFrame:
    """Completed appointments without an encounter, and no-shows times their encounters.

    Both sides are counted per appointment first: no pairs are made, and an id that repeats often
    is combined before the shuffle. Appointments without an id match nothing and are counted apart.
    """
    text = f"""
        SELECT sum(CASE WHEN e.encounters IS NULL THEN a.completed ELSE 0L END) AS DQ009,
               sum(a.no_shows * e.encounters) AS DQ010
        FROM (SELECT appointment_id,
                     sum({flag(f"appointment_status = '{COMPLETED}'")}) AS completed,
                     sum({flag(f"appointment_status = '{NO_SHOW}'")}) AS no_shows
              FROM {{visits}} GROUP BY appointment_id) a
        LEFT JOIN (SELECT appointment_id, count(*) AS encounters
                   FROM {{encounters}} WHERE appointment_id IS NOT NULL GROUP BY appointment_id) e
        ON a.appointment_id = e.appointment_id"""
    counted = mart.spark.sql(
        text,
        visits=mart.table("appointment", "appointment_id", "appointment_status"),
        encounters=mart.table("encounter", "appointment_id"),
    )
    return _as_rows(counted, ["DQ009", "DQ010"])


def orphan_keys(mart, role: str, key: str, parent: str) -> DataFrame:
    """(key, row_count) of the child rows whose key is not in the parent table, nulls included.

    Rows are counted per key before the join, so a key shared by many rows is one row in it.
    """
    counted = mart.spark.sql(
        f"SELECT {key}, count(*) AS row_count FROM {{rows}} GROUP BY {key}", rows=mart.table(role, key)
    )
    return counted.join(mart.table(parent, key), key, "left_anti")


def _orphan_count(mart, rule: str, role: str, key: str, parent: str) -> DataFrame:
    return _as_rows(orphan_keys(mart, role, key, parent).selectExpr(f"sum(row_count) AS {rule}"), [rule])


def scorecard(mart, settings: Settings = Settings(), checked_at: datetime | None = None) -> DataFrame:
    """One row per rule with its failed rows and status, by severity and rule."""
    at = "CAST(current_timestamp() AS TIMESTAMP_NTZ)" if checked_at is None else f"TIMESTAMP_NTZ '{checked_at:%Y-%m-%d %H:%M:%S}'"
    rows = ", ".join(
        f"named_struct('rule_id', '{r.rule_id}', 'rule_name', '{r.rule_name}', "
        f"'table_name', '{r.table_name}', 'severity', '{r.severity}')"
        for r in RULES
    )
    # Rule texts are looked up in a map of as many entries as there are rules.
    keys = ", ".join(f"'{r.rule_id}'" for r in RULES)
    return (
        failed_counts(mart, settings)
        .selectExpr("*", f"map_from_arrays(array({keys}), array({rows}))[rule_id] AS _rule")
        .selectExpr(
            "rule_id",
            "_rule.rule_name",
            "_rule.table_name",
            "_rule.severity",
            "failed_row_count",
            "CASE WHEN failed_row_count = 0 THEN 'pass' ELSE 'fail' END AS status",
            f"{at} AS checked_at",
        )
        .orderBy("severity", "rule_id")
    )


def quality_summary(card: DataFrame) -> DataFrame:
    """Pass rate and number of failed rules per severity, in one row."""
    passed = flag("status = 'pass'")
    return card.selectExpr(
        f"coalesce({round_to(f'100D * sum({passed}) / nullif(count(*), 0)', 2)}, 0D) AS data_quality_score_pct",
        f"coalesce(sum({_failed('critical')}), 0L) AS critical_failures",
        f"coalesce(sum({_failed('warning')}), 0L) AS warning_failures",
        "count(*) AS rule_count",
    )


def _failed(severity: str) -> str:
    return flag(f"status = 'fail' AND severity = '{severity}'")


def quality_by_table(card: DataFrame) -> DataFrame:
    """Rules, failed rules and failed rows per table."""
    return card.sparkSession.sql(
        "SELECT table_name, count(*) AS rule_count, count_if(status = 'fail') AS failed_rules, "
        "sum(failed_row_count) AS failed_row_count FROM {card} GROUP BY table_name",
        card=card,
    )
