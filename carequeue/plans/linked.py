"""Appointments joined to their referral, patient and clinic."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carequeue.operators.joins import known_only
from carequeue.operators.settle import settled
from carequeue.params import Filters

# What reports ask of each table.
VISIT = [
    "appointment_id",
    "appointment_date",
    "appointment_status",
    "appointment_type",
    "visit_mode",
    "clinic_id",
    "provider_id",
]
REFERRAL = ["referral_created_date", "referral_status"]
PERSON = [
    "zip_code",
    "insurance_type",
    "age_group",
    "preferred_language",
    "transportation_risk_flag",
]


def linked(
    mart,
    appointment: Sequence[str] = (),
    referral: Sequence[str] = (),
    patient: Sequence[str] | None = None,
    clinic: Sequence[str] | None = None,
    filters: Filters = Filters(),
) -> DataFrame:
    """Appointments that have a referral (and a patient, and a clinic) passing the filters.

    ``None`` leaves a table out; no columns keeps it as an existence test. Patients go onto
    referrals first where a mart allows it, so that the appointments, the largest table, are
    shuffled once. A ``Page`` has the rows at hand.
    """
    if isinstance(mart, Page):
        return mart.linked(appointment, referral, patient, clinic, filters)
    asked = ["referral_id", *appointment]
    if clinic is not None:
        asked.append("clinic_id")
    if filters.start is not None or filters.end is not None:
        asked.append("appointment_date")
    if filters.visit_modes is not None:
        asked.append("visit_mode")
    if filters.appointment_types is not None:
        asked.append("appointment_type")
    if patient is not None and not mart.patient_from_referral:
        asked.append("patient_id")
    rows = _where(mart.table("appointment", *dict.fromkeys(asked)), filters.on_appointment())
    if clinic is not None:
        named_filter = ["clinic_name"] if filters.clinics is not None else []
        rows = _attach(rows, mart, "clinic", "clinic_id", clinic, named_filter, filters.on_clinic())

    def with_patient(left: DataFrame) -> DataFrame:
        insured = ["insurance_type"] if filters.insurance_types is not None else []
        return _attach(left, mart, "patient", "patient_id", patient, insured, filters.on_patient())

    if patient is not None and mart.patient_from_referral:
        referrals = with_patient(mart.table("referral", *dict.fromkeys(["referral_id", "patient_id", *referral])))
        return rows.join(referrals, "referral_id")
    rows = rows.join(mart.table("referral", *dict.fromkeys(["referral_id", *referral])), "referral_id")
    return rows if patient is None else with_patient(rows)


def _attach(rows, mart, role, key, columns, filtered, tests) -> DataFrame:
    dimension = _where(mart.table(role, *dict.fromkeys([key, *columns, *filtered])), tests)
    if not columns:
        return known_only(rows, dimension, key)
    return rows.join(dimension.select(key, *columns) if filtered else dimension, key)


def _where(frame: DataFrame, tests: Sequence[Column]) -> DataFrame:
    return frame.where(reduce(lambda a, b: a & b, tests)) if tests else frame


class Page:
    """A mart whose appointments were joined to their referral, patient and clinic and written once.

    All the filtered reports of a page, and the ZIP scores, read those rows instead of joining the facts again. Rows
    are kept whatever the filters, and without a patient or clinic too, since not all reports ask for them; each
    report applies its own filters.
    """

    def __init__(self, mart):
        self.mart, self.spark = mart, mart.spark
        self.patient_from_referral = mart.patient_from_referral
        patients = mart.table("patient", "patient_id", *PERSON).withColumn("_patient", F.lit(True))
        clinics = mart.table("clinic", "clinic_id", "clinic_name").withColumn("_clinic", F.lit(True))
        referrals = mart.table("referral", "referral_id", "patient_id", *REFERRAL)
        own = [] if self.patient_from_referral else ["patient_id"]
        visits = mart.table("appointment", "referral_id", *own, *VISIT).join(clinics, "clinic_id", "left")
        if self.patient_from_referral:
            rows = visits.join(referrals.join(patients, "patient_id", "left"), "referral_id").withColumn("_home", F.col("zip_code"))
        else:
            homes = mart.table("patient", "patient_id", "zip_code").withColumnRenamed("zip_code", "_home")
            placed = referrals.join(homes, "patient_id", "left").drop("patient_id")
            rows = visits.join(placed, "referral_id").join(patients, "patient_id", "left")
        self.rows = settled(rows.select("referral_id", *VISIT, *REFERRAL, *PERSON, "clinic_name", "_home", "_patient", "_clinic"))

    def table(self, role: str, *columns: str) -> DataFrame:
        return self.mart.table(role, *columns)

    def linked(
        self,
        appointment: Sequence[str],
        referral: Sequence[str],
        patient: Sequence[str] | None,
        clinic: Sequence[str] | None,
        filters: Filters,
    ) -> DataFrame:
        """What ``linked`` gives, from the written rows."""
        tests = [*filters.on_appointment()]
        if patient is not None:
            tests += [F.col("_patient"), *filters.on_patient()]
        if clinic is not None:
            tests += [F.col("_clinic"), *filters.on_clinic()]
        columns = ["referral_id", *appointment, *referral, *(patient or ()), *(clinic or ())]
        return _where(self.rows, tests).select(*dict.fromkeys(columns))

    def placed_visits(self) -> DataFrame:
        """Appointments of referrals whose patient has a ZIP code."""
        columns = ["referral_id", "_home AS zip_code", "referral_created_date", "referral_status"]
        visit = ["appointment_id", "appointment_date", "appointment_status", "visit_mode"]
        return self.rows.where("_home IS NOT NULL").selectExpr(*columns, *visit)
