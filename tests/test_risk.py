import hashlib
import random

import pytest

from carequeue.operators.ordered import running_totals
from carequeue.operators.selection import cut_texts
from carequeue.operators.settle import settled, stored
from carequeue.plans import risk
from carequeue.sources.files import read_metrics, read_predictions, write_csv, write_json
from carequeue.sources.tpch import TpchMart
from checks.queries import SETTINGS
from tests.conftest import SMALL

FEATURES = (
    "appointment_id string, no_show_target int, days_from_referral_to_appointment int, "
    "days_from_scheduled_to_appointment int, prior_no_show_count long, appointment_type string, visit_mode string, "
    "insurance_type string, age_group string, transportation_risk_flag boolean, zip_access_friction_score double, "
    "clinic_id string, referral_priority string"
)


def test_feature_table(mart, settings):
    found = {r.appointment_id: r for r in risk.feature_table(mart, settings).collect()}
    assert set(found) == {"A1", "A2", "A3", "A4"}
    assert (found["A2"].no_show_target, found["A2"].days_from_referral_to_appointment) == (1, 20)
    assert found["A2"].zip_access_friction_score is not None


def test_imputation(spark):
    rows = [
        ("1", 0, 1, 5, 2, "b", "x", None, "a", True, 1.5, "c", "r"),
        ("2", 1, 2, None, 3, "a", "x", None, "a", True, None, "c", "r"),
        ("3", 0, None, 8, None, None, "y", None, "b", None, 2.5, None, None),
    ]
    found = {r.appointment_id: r for r in risk.impute(spark.createDataFrame(rows, FEATURES)).collect()}
    third = found["3"]
    assert third.days_from_referral_to_appointment == 1.5 and third.prior_no_show_count == 2.5
    # a and b are equally common: the smaller one fills
    assert third.appointment_type == "a" and third.transportation_risk_flag == "true"
    assert found["2"].zip_access_friction_score == 2.0
    assert third.insurance_type is None


def test_no_training_data(spark):
    with pytest.raises(risk.NoTrainingData):
        risk.train(spark.createDataFrame([], FEATURES))


def test_area_under_curve_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(str(i), rng.randint(0, 1), rng.choice([0.1, 0.2, 0.25, 0.9, rng.random()])) for i in range(200)]
    scored = spark.createDataFrame(rows, f"appointment_id string, no_show_target int, {risk.PROBABILITY} double")
    wins = [(a > b) + (a == b) / 2 for _, y, a in rows if y == 1 for _, z, b in rows if z == 0]
    assert risk.roc_auc(scored) == pytest.approx(sum(wins) / len(wins))


def test_metrics_without_predicted_positives(spark):
    scored = spark.createDataFrame(
        [("1", 0, 0.1), ("2", 1, 0.2)], f"appointment_id string, no_show_target int, {risk.PROBABILITY} double"
    )
    row = risk.classification_metrics(scored).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (0.5, 0.0, 0.0, 0.0)


def test_model_round_trip(spark, tmp_path):
    features = risk.feature_table(TpchMart(spark, SMALL), SETTINGS)
    model = risk.train(features)
    scored = risk.score(model, features)
    rows = scored.collect()
    assert len(rows) == features.count()
    assert all(0 <= r[risk.PROBABILITY] <= 1 and r.risk_bucket in ("low", "medium", "high") for r in rows)
    model.save(str(tmp_path / "model"))
    again = risk.score(risk.RiskModel.load(spark, str(tmp_path / "model")), features)
    assert again.agg({risk.PROBABILITY: "sum"}).first()[0] == pytest.approx(sum(r[risk.PROBABILITY] for r in rows))
    # An unseen category encodes as zeros instead of failing.
    unseen = features.limit(5).withColumn("appointment_type", features.appointment_type.substr(1, 0))
    assert risk.score(model, unseen).count() == 5

    write_csv(risk.predictions(scored), str(tmp_path / "predictions"))
    assert read_predictions(spark, str(tmp_path / "predictions")).count() == len(rows)
    write_json(risk.metrics_document(scored), str(tmp_path / "metrics"))
    metrics = read_metrics(spark, str(tmp_path / "metrics")).first()
    assert sum(map(sum, metrics.confusion_matrix)) == scored.where(risk.hold_out(scored)).count()
    assert 0 <= metrics.roc_auc <= 1


def test_split_is_exact_and_keeps_ids_together(spark):
    rows = spark.range(8001).selectExpr("CAST(id AS STRING) AS appointment_id", "CAST(id % 7 = 0 AS INT) AS no_show_target")
    test = risk.hold_out(rows)
    ids = {0: [], 1: []}
    for k in range(8001):
        ids[int(k % 7 == 0)].append(hashlib.md5(str(k).encode()).hexdigest())
    # 2,001 rows: 286 of 1,143 (remainder .85), and 1,715 of 6,858.
    least = {h for key, n in ((0, 1715), (1, 286)) for h in sorted(ids[key])[:n]}
    found = rows.selectExpr("md5(appointment_id) AS h", "no_show_target", f"{test} AS held_out").collect()
    assert {r.h for r in found if r.held_out} == least
    counts = {(r.split, r.no_show_target): r.row_count for r in risk.split_counts(rows).collect()}
    assert counts == {("test", 0): 1715, ("test", 1): 286, ("train", 0): 5143, ("train", 1): 857}
    twice = rows.unionAll(rows)
    again = twice.where(risk.hold_out(twice)).groupBy("appointment_id").count().collect()
    assert {r["count"] for r in again} == {2} and sum(r["count"] for r in again) == 4000  # of 4,001: the odd one would split an id


def test_hold_out_sizes():
    assert risk.hold_out_sizes({0: 3, 1: 1}) == {0: 1, 1: 0}
    assert risk.hold_out_sizes({0: 2, 1: 2}) == {0: 1, 1: 0}
    assert risk.hold_out_sizes({0: 4000, 1: 2000}) == {0: 1000, 1: 500}
    assert risk.hold_out_sizes({5: 1}, 1.0) == {5: 1}


def test_cuts_of_texts_that_agree_far_into_them(spark):
    same = "0123456789abcdef" * 2
    texts = [same[:31] + c for c in "1357"] + ["f" * 32, same[:31] + "3"]
    rows = spark.createDataFrame([(0, t) for t in texts] + [(1, same)] * 3, "k int, t string")
    for wanted, below in ((0, 0), (1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6)):
        cuts = cut_texts(rows, "k", "t", {0: wanted, 1: 0})
        assert sum(t < cuts[0] for t in texts) == below and not same < cuts[1]
    assert same < cut_texts(rows, "k", "t", {1: 3})[1] and not same < cut_texts(rows, "k", "t", {1: 2})[1]


def test_running_totals_over_ranges(spark):
    rows = spark.range(500).selectExpr("id * 37 % 500 AS k", "id AS a", "id % 3 AS b").repartition(7)
    found = sorted(map(tuple, running_totals(rows, ["k"], ["a", "b"]).collect()))
    a = b = 0
    for row in found:
        assert row[3:] == (a, b)
        a, b = a + row[1], b + row[2]
    assert len(found) == 500 and running_totals(rows.limit(0), ["k"], ["a"]).collect() == []


def test_area_without_a_class_is_null(spark):
    scored = spark.createDataFrame([("1", 0, 0.1), ("2", 0, 0.2)], f"appointment_id string, no_show_target int, {risk.PROBABILITY} double")
    assert risk.roc_auc(scored) is None and risk.roc_auc(scored.limit(0)) is None
    assert risk.metrics_document(scored).first().roc_auc is None


def test_optimality_finds_a_model_that_is_not_the_best_one(spark):
    features = settled(risk.feature_table(TpchMart(spark, SMALL), SETTINGS))
    model = risk.train(features)
    rows = risk.optimality(model, features).collect()
    assert max(r.residual for r in rows) < 5e-4
    assert {r.feature for r in rows} == {"intercept", *risk.NUMERIC, *risk.CATEGORICAL}
    # The same model on other rows is off its optimum.
    other = risk.optimality(model, features.where("days_from_referral_to_appointment > 40"))
    assert max(r.residual or 0 for r in other.collect()) > 5e-3


def test_rows_trained_on_are_encoded_once_and_scored_alike(spark):
    features = stored(risk.feature_table(TpchMart(spark, SMALL), SETTINGS))
    model = risk.train(features)
    # A filter of all rows is another frame, whose rows go through the whole pipeline.
    again = features.where("appointment_id IS NOT NULL")
    trained, other = risk.score(model, features), risk.score(model, again)
    plan = trained._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("UDF(") < other._jdf.queryExecution().optimizedPlan().toString().count("UDF(")
    # Nothing is read as rows of a checkpoint, so passes read the columns they need.
    assert "Scan ExistingRDD" not in trained._jdf.queryExecution().executedPlan().toString()
    by_id = {r.appointment_id: r[risk.PROBABILITY] for r in other.collect()}
    found = {r.appointment_id: r[risk.PROBABILITY] for r in trained.collect()}
    assert found.keys() == by_id.keys() and all(found[i] == pytest.approx(by_id[i], abs=1e-12) for i in found)
    part, fill = risk.training_part(features, model)
    plain, own = risk.training_part(again)
    assert sorted(map(str, part.collect())) == sorted(map(str, plain.collect())) and fill.collect() == own.collect()
    residuals = {(r.feature, r.value): r.residual for r in risk.optimality(model, again).collect()}
    assert {(r.feature, r.value): pytest.approx(r.residual, abs=1e-9) for r in risk.optimality(model, features).collect()} == residuals
