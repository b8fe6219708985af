"""Plans that must hold at scale."""

import pytest

from carequeue.operators.joins import COPIES, keep_left
from carequeue.operators.summary import summarise
from carequeue.plans import dashboard, quality, views
from carequeue.plans.linked import Page, linked
from carequeue.sources.tpch import TpchMart
from checks.queries import SETTINGS, WINDOW, all_queries
from tests.conftest import SMALL

LARGE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def large(spark):
    """Settings under which small tables are planned like large ones."""
    before = {key: spark.conf.get(key, None) for key in LARGE}
    for key, value in LARGE.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def hot(spark):
    """Appointments of which a third belong to one referral."""
    ids = "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 500 END"
    visits = spark.range(0, 30000, 1, 8).selectExpr(f"{ids} AS referral_id", "id AS appointment_id", "id % 90 AS lag")
    referrals = spark.range(0, 600, 1, 2).selectExpr("id AS referral_id", "id % 5 AS clinic_id")
    return visits, referrals


def test_hot_referral_is_split_in_an_inner_join(large):
    visits, referrals = hot(large)
    found = summarise(visits.join(referrals, "referral_id"), ["clinic_id"], {"n": "1"}, {"m": "lag"}, {"r": "referral_id"})
    assert sum(r.n for r in found.collect()) == 30000
    assert "skew=true" in plan_of(found)


def test_hot_referral_is_folded_when_referrals_are_kept(large):
    visits, referrals = hot(large)
    kept = keep_left(referrals, visits.select("referral_id", "lag"), "referral_id")
    found = summarise(kept, ["clinic_id"], {"n": "1"}, {"m": "lag"}, {"r": "referral_id"}, weight=COPIES)
    rows = found.collect()
    assert sum(r.n for r in rows) == 30000 + 100 and sum(r.r for r in rows) == 600
    # A third of the visits, but no more rows than lags; they are shuffled by both columns first.
    assert kept.where("referral_id = 7").count() <= 90
    plan = plan_of(found)
    assert "hashpartitioning(referral_id" in plan and "LeftOuter" in plan
    assert any("hashpartitioning(referral_id" in line and "lag" in line.split("hashpartitioning")[1] for line in plan.splitlines())


@pytest.mark.parametrize("report", [views.referral_lag, views.zip_friction])
def test_appointments_are_scanned_once_when_referrals_are_kept(spark, report):
    mart = TpchMart(spark, SMALL)
    scans, read = [], mart.raw
    mart.raw = lambda name: scans.append(name) or read(name)
    report(mart, SETTINGS)
    assert scans.count("lineitem") == 1


def test_zip_report_splits_a_hot_referral(large):
    # What placed_visits joins: an inner join, whose sides AQE may split.
    visits, referrals = hot(large)
    placed = referrals.selectExpr("referral_id", "CAST(clinic_id AS STRING) AS zip_code")
    found = summarise(placed.join(visits, "referral_id"), ["zip_code"], {"n": "1"}, {"m": "lag"}, {"r": "referral_id"})
    assert sum(r.n for r in found.collect()) == 30000 and "skew=true" in plan_of(found)


def test_a_page_joins_the_facts_once(spark):
    mart = TpchMart(spark, SMALL)
    scans, read = [], mart.raw
    mart.raw = lambda name: scans.append(name) or read(name)
    page = Page(mart)
    friction = views.zip_friction(page, SETTINGS)
    for frame in (
        dashboard.clinic_report(page, WINDOW, SETTINGS),
        dashboard.kpis(page, WINDOW, SETTINGS, friction),
        dashboard.access_trends(page, WINDOW, "month"),
        dashboard.provider_report(page, WINDOW),
        dashboard.segment_completion(page, WINDOW, SETTINGS),
    ):
        assert "lineitem" not in plan_of(frame)
    assert scans.count("lineitem") == 1


def test_every_query_avoids_pairs_and_python(spark):
    skip = ("risk_scores", "model_metrics", "risk_scores_check")
    for name, build in all_queries().items():
        if name in skip:
            continue
        plan = plan_of(build(spark, SMALL))
        for word in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "MapInPandas"):
            assert word not in plan, (name, word)


def jobs_of(spark, build) -> int:
    """Jobs that run while a frame is built."""
    spark.sparkContext.setJobGroup("building", "building")
    try:
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("building"))
        build()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) - before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_frames_without_scores_are_built_without_jobs(spark):
    # Reading a table's footer is a job of its own; the friction score would take a dozen.
    for name in ("scenario_outreach", "scenario_capacity", "answer_open_aging", "score_histogram", "kpi_from"):
        jobs = jobs_of(spark, lambda name=name: all_queries()[name](spark, SMALL))
        assert (jobs <= 8) == (name != "kpi_from"), (name, jobs)


def test_date_filters_reach_the_scan(spark):
    rows = linked(TpchMart(spark, SMALL), ["appointment_status"], patient=[], clinic=[], filters=WINDOW)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "lineitem" in line)
    assert "GreaterThanOrEqual(l_shipdate" in scan and "l_extendedprice" not in scan


def test_orphans_are_anti_joins_on_counted_keys(large):
    # Catalyst moves the join below the count only where it can broadcast the parent.
    plan = plan_of(quality.orphan_keys(TpchMart(large, SMALL), "appointment", "provider_id", "provider"))
    assert "LeftAnti" in plan and plan.index("LeftAnti") < plan.index("HashAggregate")


def test_medians_are_taken_over_counted_values(spark):
    plan = plan_of(views.segment_completion_gap(TpchMart(spark, SMALL)))
    # The percentile sees the output of the first aggregate, which runs in generated code.
    assert plan.index("ObjectHashAggregate") < plan.index("HashAggregate(keys=[age_group")


def test_facts_are_scanned_once_for_both_windows(spark):
    plan = plan_of(dashboard.kpi_comparison(TpchMart(spark, SMALL), WINDOW, SETTINGS))
    # A runtime bloom filter may read the dates again; the outcomes are read by the one main scan.
    assert sum("FileScan" in line and "l_returnflag" in line for line in plan.splitlines()) == 1
