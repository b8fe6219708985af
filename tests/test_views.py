from datetime import date

from carequeue.params import Filters, Selection, Settings
from carequeue.plans import actions, dashboard, views
from carequeue.plans.linked import Page
from tests.conftest import rows_of


def test_referrals_without_a_clinic_are_their_own_group(mart, settings):
    found = {(r.clinic_id, r.referral_month): r for r in views.referral_lag(mart, settings).collect()}
    march = found[None, date(2024, 3, 1)]
    assert (march.total_referrals, march.open_referrals, march.open_referrals_over_21_days) == (1, 1, 0)
    assert march.clinic_name is None and march.median_referral_to_appointment_days is None
    # A referral without an id is kept but not counted as distinct.
    february = found[None, date(2024, 2, 1)]
    assert (february.total_referrals, february.open_referrals, february.open_referrals_over_21_days) == (0, 1, 1)
    january = found["C1", date(2024, 1, 1)]
    assert january.total_referrals == 2
    # One row per appointment: A1 twice, A2, A4.
    assert january.open_referrals == 3
    assert january.median_referral_to_appointment_days == 10.0
    assert january.median_referral_to_review_days == 4.0


def test_clinic_performance_keeps_empty_clinics(mart, settings):
    found = rows_of(views.clinic_performance(mart, settings), "clinic_id")
    assert set(found) == {"C1", "C2", "C3"}
    north, south, empty = found["C1"], found["C2"], found["C3"]
    assert (north["referral_volume"], north["appointment_volume"]) == (3, 4)
    # Rates count rows, so the repeated appointment counts twice; the null status is in neither.
    assert (north["completion_rate_pct"], north["no_show_rate_pct"]) == (40.0, 20.0)
    assert north["open_referrals_over_21_days"] == 4
    assert north["monthly_capacity_utilization_pct"] == 10.0
    assert south["monthly_capacity_utilization_pct"] is None
    assert (empty["appointment_volume"], empty["completion_rate_pct"]) == (0, None)
    assert empty["median_referral_to_appointment_days"] is None


def test_idle_providers_and_providers_without_slots(mart):
    found = rows_of(views.provider_capacity_all(mart), "provider_id")
    assert found["D3"]["appointment_volume"] == found["D3"]["no_show_appointments"] == 0
    assert found["D3"]["monthly_capacity_utilization_pct"] == 0.0
    assert found["D2"]["monthly_capacity_utilization_pct"] is None
    assert (found["D1"]["appointment_volume"], found["D1"]["completed_appointments"]) == (5, 2)


def test_missing_telehealth_differs_between_the_two_scores(mart, settings):
    found = rows_of(dashboard.zip_report(mart, settings), "zip_code")
    nobody = found["06003"]
    assert nobody["referral_volume"] == 0 and nobody["telehealth_usage_pct"] == 0.0
    fixed = rows_of(views.zip_friction(mart, settings), "zip_code")["06003"]
    assert fixed["telehealth_usage_pct"] is None and fixed["median_referral_to_appointment_days"] is None
    # Only the three rates count in the fixed score; the adjustable one adds the whole penalty.
    assert nobody["access_friction_score"] == 4.0
    assert nobody["custom_access_friction_score"] == 9.0
    assert found["06001"]["open_over_21_rate_pct"] == 200.0


def test_scores_of_all_zero_metrics(mart, settings):
    none = dashboard.clinic_report(mart, Filters(visit_modes=Selection([], ["telehealth"])), settings)
    assert none.collect() == []


def test_no_show_summary_drops_unknown_zip_codes(mart):
    found = views.no_show_summary(mart).collect()
    assert {r.zip_code for r in found} == {"06001", "06002"}
    assert sum(r.total_appointments for r in found) == 5


def test_open_referral_aging(mart, settings):
    found = rows_of(views.open_referral_aging(mart, settings), "referral_id")
    assert {key: (r["open_days"], r["aging_bucket"]) for key, r in found.items()} == {
        "R1": (90, "30+ days"),
        "R4": (6, "0-7 days"),
        "R5": (59, "30+ days"),
        None: (55, "30+ days"),
    }


def test_funnel_counts_distinct_ids(mart):
    found = rows_of(actions.funnel_dropoff(mart), "stage_order")
    assert [found[i]["stage_count"] for i in range(1, 6)] == [5, 4, 5, 2, 1]
    assert [found[i]["dropoff_from_prior_stage"] for i in range(1, 6)] == [0, 1, -1, 3, 1]
    assert [found[i]["conversion_from_created_pct"] for i in range(1, 6)] == [100.0, 80.0, 100.0, 40.0, 20.0]
    assert actions.largest_dropoff(mart).first().stage == "Appointment Completed"


def test_kpis_of_nothing_are_zero(mart, settings):
    row = dashboard.kpis(mart, Filters(date(2010, 1, 1), date(2010, 1, 2)), settings).first()
    assert set(row.asDict().values()) == {0}


def test_kpis(mart, settings):
    row = dashboard.kpis(mart, Filters(), settings).first()
    assert (row.total_referrals, row.total_appointments, row.open_referrals_over_threshold) == (4, 5, 2)
    assert row.median_lag_days == 15.0


def test_full_selection_keeps_null_categories(mart, settings):
    both = Selection(["public", "private"], ["public", "private"])
    one = Selection(["public"], ["public", "private"])
    assert dashboard.kpis(mart, Filters(insurance_types=both), settings).first().total_appointments == 5
    assert dashboard.kpis(mart, Filters(insurance_types=one), settings).first().total_appointments == 3
    nothing = Selection([], ["public", "private"])
    assert dashboard.kpis(mart, Filters(insurance_types=nothing), settings).first().total_appointments == 0


def test_delta_is_null_without_a_prior_value(mart, settings):
    window = Filters(date(2024, 1, 11), date(2024, 1, 20))
    found = rows_of(dashboard.kpi_delta(mart, window, settings), "metric")
    assert found["total_referrals"]["delta"] is None and found["total_referrals"]["current_value"] == 2
    later = Filters(date(2024, 1, 21), date(2024, 1, 30))
    found = rows_of(dashboard.kpi_delta(mart, later, settings), "metric")
    assert found["total_referrals"]["delta"] == "-1.0"
    assert found["completion_rate_pct"]["delta"] == "-66.7%"


def test_comparison_equals_two_separate_windows(mart, settings):
    window = Filters(date(2024, 1, 16), date(2024, 2, 10))
    both = dashboard.kpi_comparison(mart, window, settings).first().asDict()
    for which, filters in {"current": window, "prior": window.prior()}.items():
        alone = dashboard.kpis(mart, filters, settings).first().asDict()
        assert {name: both[f"{which}_{name}"] for name in alone} == alone


def test_improvement_needs_both_windows(mart):
    found = dashboard.clinic_improvement(mart, last_day=date(2024, 2, 10)).collect()
    # South has appointments in the later window only.
    assert [r.clinic_name for r in found] == ["North"]
    north = found[0]
    assert (north.previous_median_lag, north.current_median_lag, north.lag_improvement_days) == (10.0, 7.5, 2.5)
    assert (north.previous_appointment_count, north.current_appointment_count) == (2, 2)
    assert north.completion_rate_change_pct_points == -100.0
    assert dashboard.clinic_improvement(mart, last_day=date(2024, 5, 2)).collect() == []


def test_periods(mart):
    assert dashboard.date_bounds(mart).first() == (date(2019, 12, 31), date(2026, 1, 1))
    weekly = dashboard.resolve_period(mart, "Weekly")
    assert (weekly.start, weekly.end, weekly.grain) == (date(2025, 10, 9), date(2026, 1, 1), "week")
    assert dashboard.resolve_period(mart, "Yearly").start == date(2019, 12, 31)
    custom = dashboard.resolve_period(mart, "Custom dates", date(2024, 1, 1), date(2024, 2, 1), "day")
    assert (custom.start, custom.grain) == (date(2024, 1, 1), "day")
    presets = rows_of(dashboard.period_presets(mart), "period_mode")
    assert {name: row["appointment_count"] for name, row in presets.items()} == {"Weekly": 1, "Monthly": 1, "Yearly": 8}


def test_dynamic_queue_lists_only_crossed_thresholds(mart):
    settings = Settings(as_of=date(2024, 3, 31), high_lag_days=20, high_no_show_pct=20, high_friction=99)
    clinics = dashboard.clinic_report(mart, Filters(), settings)
    found = rows_of(actions.dynamic_action_queue(clinics, dashboard.zip_report(mart, settings), settings), "entity_name")
    assert found["North"]["triggering_metrics"] == "no-show rate 20.0%; 2 open referrals older than 21 days"
    assert found["South"]["triggering_metrics"] == "median lag 31.0 days"
    assert "Empty" not in found and "06003" not in found
    assert found["06001"]["triggering_metrics"].endswith("open aging rate 200.0%")


def test_scenarios(mart, settings):
    kpi = dashboard.kpis(mart, Filters(), settings)
    outreach = rows_of(actions.outreach_scenarios(kpi, [0, 50, 100]), "reduction_pct")
    # Half of one no-show rounds to the even number.
    assert [outreach[p]["recovered_appointments"] for p in (0, 50, 100)] == [0, 0, 1]
    assert outreach[100]["scenario_no_show_rate_pct"] == 0.0
    capacity = rows_of(actions.capacity_scenarios(kpi, kpi.sparkSession.range(2), [0, 1]), "extra_slots_per_week")
    assert (capacity[1]["added_monthly_slots"], capacity[1]["potential_backlog_coverage"]) == (8, 2)
    assert capacity[0]["potential_backlog_coverage"] == 0


def test_reports_of_a_page_equal_those_of_its_mart(mart, settings):
    """The small mart has appointments without referral, patient, clinic or outcome, and a patient other than the referral's."""
    page = Page(mart)
    window = Filters(
        date(2024, 1, 1),
        date(2024, 3, 31),
        visit_modes=Selection(["in_person", "telehealth"], ["in_person", "telehealth", "phone"]),
        insurance_types=Selection(["public"], ["public", "private"]),
    )
    assert rows(views.zip_friction(page, settings)) == rows(views.zip_friction(mart, settings))
    for filters in (Filters(), window):
        for build in (dashboard.kpis, dashboard.counts, dashboard.clinic_report, dashboard.segment_completion):
            assert rows(build(page, filters, settings)) == rows(build(mart, filters, settings)), build
        for build in (
            dashboard.access_trends,
            dashboard.appointment_type_no_show,
            dashboard.visit_mode_no_show,
            dashboard.provider_report,
            dashboard.clinic_improvement,
        ):
            assert rows(build(page, filters)) == rows(build(mart, filters)), build


def rows(frame):
    return sorted(map(str, frame.collect()))
