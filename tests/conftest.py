from __future__ import annotations

import sys
from datetime import date
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from carequeue.params import Settings
from carequeue.session import build_session
from carequeue.sources.files import TableMart
from carequeue.sources.schemas import SCHEMAS

SMALL = "/root/testdata/sf0.001"
AS_OF = date(2024, 3, 31)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="3",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def settings():
    return Settings(as_of=AS_OF, min_segment_volume=1)


def day(text: str | None) -> date | None:
    return None if text is None else date.fromisoformat(text)


def make_mart(spark, **rows):
    """A mart of hand-written tables; columns that a row leaves out are null."""
    tables = {}
    for name, schema in SCHEMAS.items():
        names = [column.split()[0] for column in schema.split(", ")]
        data = [tuple(row.get(column) for column in names) for row in rows.get(name, [])]
        tables[name] = spark.createDataFrame(data, schema)
    return TableMart(tables)


def referral(key, patient, created, status="closed", reviewed=None, reason="done"):
    return {
        "referral_id": key,
        "patient_id": patient,
        "referral_created_date": day(created),
        "referral_reviewed_date": day(reviewed),
        "referral_status": status,
        "closure_reason": reason,
        "referral_priority": "routine",
    }


def visit(key, of, patient, clinic, provider, on, status="completed", mode="in_person", kind="follow_up"):
    return {
        "appointment_id": key,
        "referral_id": of,
        "patient_id": patient,
        "clinic_id": clinic,
        "provider_id": provider,
        "appointment_scheduled_date": day(on),
        "appointment_date": day(on),
        "appointment_status": status,
        "appointment_type": kind,
        "visit_mode": mode,
    }


@pytest.fixture(scope="session")
def mart(spark):
    return make_mart(
        spark,
        dim_clinic=[
            {"clinic_id": "C1", "clinic_name": "North", "clinic_group": "A", "weekly_intake_slot_capacity": 10},
            {"clinic_id": "C2", "clinic_name": "South", "clinic_group": "B", "weekly_intake_slot_capacity": 0},
            {"clinic_id": "C3", "clinic_name": "Empty", "clinic_group": "B", "weekly_intake_slot_capacity": 5},
        ],
        dim_zip_code=[
            {"zip_code": "06001", "area_name": "One", "transportation_risk_rate": 0.4, "underinsured_rate": 0.2,
             "limited_english_rate": 0.1},
            {"zip_code": "06002", "area_name": "Two", "transportation_risk_rate": 0.2, "underinsured_rate": 0.1,
             "limited_english_rate": 0.3},
            {"zip_code": "06003", "area_name": "Nobody", "transportation_risk_rate": 0.1, "underinsured_rate": 0.1,
             "limited_english_rate": 0.1},
        ],
        dim_patient=[
            {"patient_id": "P1", "zip_code": "06001", "insurance_type": "public", "age_group": "18-25",
             "preferred_language": "English", "transportation_risk_flag": True, "prior_no_show_count": 2},
            {"patient_id": "P2", "zip_code": "06002", "insurance_type": "private", "age_group": "26-35",
             "preferred_language": "Spanish", "transportation_risk_flag": False, "prior_no_show_count": 0},
            {"patient_id": "P3", "zip_code": None, "insurance_type": None, "age_group": "26-35",
             "preferred_language": "English", "transportation_risk_flag": False, "prior_no_show_count": 1},
            {"patient_id": "P4", "zip_code": "99999", "insurance_type": "public", "age_group": "65+",
             "preferred_language": "English", "transportation_risk_flag": None, "prior_no_show_count": None},
        ],
        dim_provider=[
            {"provider_id": "D1", "provider_name": "Ana", "clinic_id": "C1", "provider_type": "Therapist",
             "weekly_capacity_slots": 10},
            {"provider_id": "D2", "provider_name": "Bo", "clinic_id": "C2", "provider_type": "Therapist",
             "weekly_capacity_slots": 0},
            {"provider_id": "D3", "provider_name": "Idle", "clinic_id": "C1", "provider_type": "Nurse",
             "weekly_capacity_slots": 4},
        ],
        fact_referral=[
            referral("R1", "P1", "2024-01-01", "open", reviewed="2024-01-05", reason=None),
            referral("R2", "P2", "2024-01-10", reviewed="2024-01-10"),
            referral("R3", "P1", "2024-01-20", "closed", reviewed="2024-01-10", reason=None),
            referral("R4", "P2", "2024-03-25", "open", reason=None),
            referral("R5", "P3", "2024-02-01", "open", reviewed="2024-02-03", reason=None),
            referral(None, "P1", "2024-02-05", "open", reason=None),
        ],
        fact_appointment=[
            visit("A1", "R1", "P1", "C1", "D1", "2024-01-11", "completed", "telehealth"),
            visit("A2", "R1", "P1", "C1", "D1", "2024-01-21", "no_show"),
            visit("A3", "R2", "P2", "C2", "D2", "2024-02-10", "completed", kind="new_patient"),
            visit("A4", "R3", "P1", "C1", "D1", "2024-01-15", "canceled"),
            visit("A5", "R5", "P3", "C1", "D1", "2024-03-02", None, "telehealth"),
            visit("A6", "R9", "P2", "C9", "D9", "2019-12-31", "oops", "phone"),
            visit("A7", None, "P4", None, None, "2026-01-01", "scheduled", None),
            visit("A1", "R1", "P1", "C1", "D1", "2024-01-11", "completed", "telehealth"),
        ],
        fact_encounter=[
            {"encounter_id": "E1", "appointment_id": "A1"},
            {"encounter_id": "E2", "appointment_id": "A2"},
            {"encounter_id": "E3", "appointment_id": "A2"},
        ],
        fact_followup=[
            {"followup_id": "F1", "encounter_id": "E1", "followup_status": "completed"},
            {"followup_id": "F2", "encounter_id": "E1", "followup_status": "completed"},
            {"followup_id": "F3", "encounter_id": "E2", "followup_status": "open"},
        ],
    )


def rows_of(frame, key):
    return {row[key]: row.asDict() for row in frame.collect()}
