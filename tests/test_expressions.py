from datetime import date

import pytest

from carequeue.functions import expressions as X
from carequeue.params import ClinicWeights, Filters, Selection, Settings, ZipWeights
from carequeue.plans.actions import weights_table


def values(spark, texts):
    return list(spark.range(1).selectExpr(*[f"{text} AS c{i}" for i, text in enumerate(texts)]).first())


def test_aging_bands_cover_every_age(spark):
    ages = {-1: "30+ days", 0: "0-7 days", 7: "0-7 days", 8: "8-14 days", 14: "8-14 days", 15: "15-21 days",
            21: "15-21 days", 22: "22-30 days", 30: "22-30 days", 31: "30+ days"}
    assert values(spark, [X.aging_bucket(str(age)) for age in ages]) == list(ages.values())
    assert values(spark, [X.aging_bucket("CAST(NULL AS INT)")]) == ["30+ days"]


def test_risk_bins_are_right_closed(spark):
    bins = {-0.01: None, 0.0: "low", 0.30: "low", 0.300001: "medium", 0.60: "medium", 0.61: "high", 1.01: "high",
            1.02: None}
    assert values(spark, [X.risk_bucket(f"{p!r}D") for p in bins]) == list(bins.values())


def test_rounding_and_ratios(spark):
    found = values(spark, [X.round_to("2.5D", 0), X.round_even("2.5D", 0), X.round_even("0.125D", 2), X.pct("1", "3"),
                           X.pct("1", "0"), X.safe_pct("1", "0"), X.safe_pct("1", "CAST(NULL AS INT)"),
                           X.utilization("3", "0"), X.utilization("3", "10")])
    assert found == [3.0, 2.0, 0.12, 33.33, None, 0.0, 0.0, None, 7.5]


@pytest.mark.parametrize("number", [0.35, 32.25, 32.75, 0.45, 1.15, 12345.05, -0.25, 7.0])
def test_text_of_numbers_is_that_of_python(spark, number):
    assert values(spark, [X.one_decimal(f"{number!r}D"), X.signed_decimal(f"{number!r}D")]) == [
        f"{number:.1f}",
        f"{number:+.1f}",
    ]


def test_thousands(spark):
    assert values(spark, [X.thousands("1234567")]) == ["1,234,567"]


def test_period_start(spark):
    day = "DATE '2024-02-29'"
    expected = {"day": date(2024, 2, 29), "week": date(2024, 2, 26), "month": date(2024, 2, 1),
                "year": date(2024, 1, 1), "decade": date(2024, 2, 26)}
    assert values(spark, [X.period_start(day, grain) for grain in expected]) == list(expected.values())
    assert [X.grain_label(g) for g in ("day", "month", "decade")] == ["Daily", "Monthly", "Weekly"]


def test_selection(spark):
    frame = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    options = ["a", "b"]

    def kept(chosen):
        test = Selection(chosen, options).predicate(frame.x)
        return frame.count() if test is None else frame.where(test).count()

    assert [kept([]), kept(None), kept(["a"]), kept(["a", "b"])] == [0, 0, 1, 3]


def test_prior_window_has_the_same_length():
    prior = Filters(date(2024, 1, 11), date(2024, 1, 20)).prior()
    assert (prior.start, prior.end) == (date(2024, 1, 1), date(2024, 1, 10))


def test_weights(spark):
    assert ClinicWeights().shares() == {"lag": 0.35, "no_show": 0.25, "open_aging": 0.2, "capacity": 0.2}
    assert sum(ZipWeights(lag=90).shares().values()) == pytest.approx(1)
    assert set(ClinicWeights(0, 0, 0, 0).shares().values()) == {0.0}
    table = weights_table(spark, Settings()).collect()
    assert len(table) == 11
    assert (table[0].score, table[0].component, table[0].weight_pct) == ("Clinic Attention", "Lag", 35.0)


def test_half_open_windows(spark):
    rows = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-01-10')) AS appointment_date")
    for filters, n in (
        (Filters(start=date(2024, 1, 4)), 7),
        (Filters(end=date(2024, 1, 4)), 4),
        (Filters(end=date(2023, 1, 4)), 0),
        (Filters(), 10),
    ):
        kept = rows
        for test in filters.on_appointment():
            kept = kept.where(test)
        assert kept.count() == n
    with pytest.raises(ValueError, match="prior"):
        Filters(start=date(2024, 1, 4)).prior()
