"""Binding of the access roles to a TPC-H-like star schema of parquet files.

Only the columns asked for are computed, and only the joins they need are made: the clinic of an
appointment comes from its supplier, the appointment type from its part, the patient from its order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from carequeue.functions.expressions import named

_CREATED = "CAST(o_orderdate AS DATE)"
_VISIT = "CAST(l_shipdate AS DATE)"
_VISIT_ID = "l_orderkey * 10 + l_linenumber"


def _share(test: str) -> str:
    return f"avg(CASE WHEN {test} THEN 1D ELSE 0D END)"


# role -> (table, its own columns as expressions)
ROLES = {
    "referral": (
        "orders",
        {
            "referral_id": "o_orderkey",
            "patient_id": "o_custkey",
            "referral_created_date": _CREATED,
            "referral_reviewed_date": f"CASE WHEN o_orderstatus <> 'P' "
            f"THEN date_add({_CREATED}, CAST(o_orderkey % 22 AS INT)) END",
            "referral_status": "CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END",
            "closure_reason": "CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END",
            "referral_priority": "o_orderpriority",
        },
    ),
    "appointment": (
        "lineitem",
        {
            "appointment_id": _VISIT_ID,
            "referral_id": "l_orderkey",
            "provider_id": "l_suppkey",
            "part_id": "l_partkey",
            "appointment_date": _VISIT,
            "appointment_scheduled_date": f"date_sub({_VISIT}, CAST(l_quantity AS INT))",
            "appointment_status": "CASE WHEN l_returnflag = 'A' THEN 'completed' "
            "WHEN l_returnflag = 'R' THEN 'no_show' "
            "WHEN l_linenumber % 2 = 1 THEN 'canceled' ELSE 'rescheduled' END",
            "visit_mode": "CASE WHEN l_linestatus = 'O' THEN 'telehealth' ELSE 'in_person' END",
        },
    ),
    "patient": (
        "customer",
        {
            "patient_id": "c_custkey",
            "age_group": "CASE WHEN c_acctbal < 0 THEN '18-25' WHEN c_acctbal < 2500 THEN '26-35' "
            "WHEN c_acctbal < 5000 THEN '36-50' WHEN c_acctbal < 7500 THEN '51-64' ELSE '65+' END",
            "insurance_type": "c_mktsegment",
            "preferred_language": "CASE c_custkey % 4 WHEN 0 THEN 'English' WHEN 1 THEN 'Spanish' "
            "WHEN 2 THEN 'Polish' ELSE 'Other' END",
            "transportation_risk_flag": "c_acctbal < 0",
            "prior_no_show_count": "c_custkey % 9",
            "zip_code": "CAST(c_nationkey AS STRING)",
        },
    ),
    "provider": (
        "supplier",
        {
            "provider_id": "s_suppkey",
            "provider_name": "s_name",
            "clinic_id": "s_nationkey",
            "provider_type": "CASE WHEN s_acctbal >= 5000 THEN 'Therapist' ELSE 'Social Worker' END",
            "weekly_capacity_slots": "20 + s_suppkey % 16",
            "active_flag": "s_acctbal >= 0",
        },
    ),
    "clinic": (
        "nation",
        {
            "clinic_id": "n_nationkey",
            "clinic_name": "n_name",
            "region_id": "n_regionkey",
            "weekly_intake_slot_capacity": "CAST(50 + 5 * (n_nationkey % 10) AS BIGINT)",
        },
    ),
    "zip": ("nation", {"zip_code": "CAST(n_nationkey AS STRING)", "area_name": "n_name"}),
    "encounter": (
        "lineitem",
        {
            "encounter_id": _VISIT_ID,
            "appointment_id": _VISIT_ID,
            "provider_id": "l_suppkey",
            "encounter_date": _VISIT,
        },
    ),
    "followup": (
        "events",
        {
            "followup_id": "event_id",
            "encounter_id": "event_id * 10 + 1",
            "followup_status": "CASE WHEN event_type = 'purchase' THEN 'completed' "
            "WHEN event_type = 'error' THEN 'overdue' ELSE 'open' END",
            "followup_due_date": "date_add(CAST(ts AS DATE), 14)",
            "followup_completed_date": "CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) END",
        },
    ),
}

# role -> rows of its table that take part
ROWS = {"encounter": "l_returnflag = 'A'"}

# (role, column) -> (key in the role, table, its key, its value)
LOOKUPS = {
    ("appointment", "clinic_id"): ("provider_id", "supplier", "s_suppkey", "s_nationkey"),
    ("appointment", "appointment_type"): ("part_id", "part", "p_partkey", "p_type"),
    ("appointment", "patient_id"): ("referral_id", "orders", "o_orderkey", "o_custkey"),
    ("clinic", "clinic_group"): ("region_id", "region", "r_regionkey", "r_name"),
}

AREA_RATES = {
    "transportation_risk_rate": _share("c_acctbal < 0"),
    "underinsured_rate": _share("c_mktsegment = 'MACHINERY'"),
    "limited_english_rate": _share("c_mktsegment = 'FURNITURE'"),
    "telehealth_adoption_rate": _share("c_mktsegment = 'HOUSEHOLD'"),
}


class TpchMart:
    """Role tables over ``<folder>/<table>.parquet``."""

    #: the patient of an appointment is the patient of its referral
    patient_from_referral = True

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """A parquet table, its footer read once per mart."""
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._frames[name]

    def table(self, role: str, *columns: str) -> DataFrame:
        """The role's table with the given columns."""
        source, own = ROLES[role]
        looked_up = {name: LOOKUPS[role, name] for name in columns if (role, name) in LOOKUPS}
        rates = [name for name in columns if role == "zip" and name in AREA_RATES]
        direct = [name for name in columns if name in own]
        keys = [key for key, *_ in looked_up.values()] + (["zip_code"] if rates else [])
        rows = self.raw(source)
        if role in ROWS:
            rows = rows.where(ROWS[role])
        rows = rows.selectExpr(*named({name: own[name] for name in dict.fromkeys([*direct, *keys])}))
        for name, (key, table, table_key, value) in looked_up.items():
            rows = rows.join(self.raw(table).selectExpr(f"{table_key} AS {key}", f"{value} AS {name}"), key, "left")
        if rates:
            averages = [f"{AREA_RATES[name]} AS {name}" for name in rates]
            per_area = self.spark.sql(
                f"SELECT CAST(c_nationkey AS STRING) AS zip_code, {', '.join(averages)} "
                "FROM {patients} GROUP BY c_nationkey",
                patients=self.raw("customer"),
            )
            rows = rows.join(per_area, "zip_code", "left")
        return rows if rows.columns == list(columns) else rows.select(*columns)
