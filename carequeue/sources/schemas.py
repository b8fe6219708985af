"""Explicit table schemas; no type inference, so ZIP codes keep their leading zeros."""

from __future__ import annotations

# Tables, their columns and types.
SCHEMAS = {
    "dim_department": "department_id string, department_name string, service_line string",
    "dim_clinic": "clinic_id string, clinic_name string, clinic_group string, city string, "
    "weekly_intake_slot_capacity bigint",
    "dim_zip_code": "zip_code string, area_name string, transportation_risk_rate double, "
    "underinsured_rate double, limited_english_rate double, telehealth_adoption_rate double",
    "dim_patient": "patient_id string, age_group string, gender string, race_ethnicity string, "
    "preferred_language string, insurance_type string, zip_code string, "
    "transportation_risk_flag boolean, prior_no_show_count bigint, chronic_condition_flag boolean, "
    "behavioral_health_screening_score bigint, created_at date",
    "dim_provider": "provider_id string, provider_name string, clinic_id string, department_id string, "
    "provider_type string, weekly_capacity_slots bigint, active_flag boolean",
    "fact_referral": "referral_id string, patient_id string, referring_department_id string, "
    "referred_to_department_id string, referral_reason string, referral_priority string, "
    "referral_created_date date, referral_reviewed_date date, referral_status string, "
    "referral_closed_date date, closure_reason string",
    "fact_appointment": "appointment_id string, referral_id string, patient_id string, clinic_id string, "
    "provider_id string, appointment_scheduled_date date, appointment_date date, "
    "appointment_status string, appointment_type string, visit_mode string, cancellation_reason string",
    "fact_screening": "screening_id string, patient_id string, referral_id string, screening_date date, "
    "screening_score bigint, positive_screen_flag boolean",
    "fact_encounter": "encounter_id string, appointment_id string, patient_id string, provider_id string, "
    "clinic_id string, encounter_date date, encounter_status string",
    "fact_followup": "followup_id string, encounter_id string, patient_id string, followup_due_date date, "
    "followup_completed_date date, followup_status string",
}

# Roles that the reports ask for, and the table that plays each.
ROLE_TABLES = {
    "referral": "fact_referral",
    "appointment": "fact_appointment",
    "patient": "dim_patient",
    "provider": "dim_provider",
    "clinic": "dim_clinic",
    "zip": "dim_zip_code",
    "encounter": "fact_encounter",
    "followup": "fact_followup",
    "department": "dim_department",
    "screening": "fact_screening",
}

# Keys that the reports take to be unique.
KEYS = {
    "dim_clinic": "clinic_id",
    "dim_zip_code": "zip_code",
    "dim_patient": "patient_id",
    "dim_provider": "provider_id",
    "fact_referral": "referral_id",
}

# Date that the reports filter each fact table by, and the key that splits a busy day.
FACT_ORDER = {
    "fact_referral": ("referral_created_date", "referral_id"),
    "fact_appointment": ("appointment_date", "appointment_id"),
    "fact_screening": ("screening_date", "screening_id"),
    "fact_encounter": ("encounter_date", "encounter_id"),
    "fact_followup": ("followup_due_date", "followup_id"),
}

PREDICTIONS = "appointment_id string, predicted_no_show_probability double, risk_bucket string"
METRICS = (
    "accuracy double, precision double, recall double, f1 double, roc_auc double, "
    "confusion_matrix array<array<bigint>>, model_note string"
)

SCORECARD = (
    "rule_id string, rule_name string, table_name string, severity string, failed_row_count bigint, "
    "status string, checked_at timestamp_ntz"
)
