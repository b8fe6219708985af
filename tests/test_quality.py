from datetime import datetime

from carequeue.plans import quality
from tests.conftest import rows_of

EXPECTED = {
    "DQ001": 0,
    "DQ002": 1,
    "DQ003": 0,
    "DQ004": 1,
    "DQ005": 1,
    "DQ006": 2,
    "DQ007": 1,  # the null status is not a failure
    "DQ008": 1,  # nor is the null mode
    "DQ009": 1,
    "DQ010": 2,  # one no-show with two encounters
    "DQ011": 1,
    "DQ012": 2,
    "DQ013": 2,
    "DQ014": 2,
    "DQ015": 2,
}


def test_scorecard(mart, settings):
    card = quality.scorecard(mart, settings, datetime(2024, 3, 31))
    found = card.collect()
    assert {r.rule_id: r.failed_row_count for r in found} == EXPECTED
    assert [r.severity for r in found] == sorted(r.severity for r in found)
    summary = quality.quality_summary(card).first()
    assert (summary.data_quality_score_pct, summary.critical_failures, summary.warning_failures) == (13.33, 9, 4)
    tables = rows_of(quality.quality_by_table(card), "table_name")
    assert tables["fact_referral"]["failed_rules"] == 3 and tables["dim_patient"]["failed_row_count"] == 2


def test_orphans_include_missing_keys(mart):
    found = {r.provider_id: r.row_count for r in quality.orphan_keys(mart, "appointment", "provider_id", "provider").collect()}
    assert found == {"D9": 1, None: 1}


def test_summary_of_no_rules(mart, settings):
    empty = quality.scorecard(mart, settings).where("false")
    assert quality.quality_summary(empty).first().data_quality_score_pct == 0.0


def test_rules_have_their_severities():
    warnings = {"DQ006", "DQ008", "DQ011", "DQ012"}
    expected = {f"DQ{n:03}": "warning" if f"DQ{n:03}" in warnings else "critical" for n in range(1, 16)}
    assert {rule.rule_id: rule.severity for rule in quality.RULES} == expected
