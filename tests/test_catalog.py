from datetime import datetime

from carequeue.plans import catalog, views


def test_scorecard_is_kept_and_views_read_it(spark, mart, settings):
    spark.sql("DROP TABLE IF EXISTS scorecard_of_test")
    assert catalog.read_scorecard(spark, "scorecard_of_test").collect() == []
    for hour in (1, 2):
        catalog.refresh_scorecard(mart, settings, datetime(2024, 3, 31, hour), "scorecard_of_test")
    kept = catalog.read_scorecard(spark, "scorecard_of_test")
    assert kept.count() == 15 and {r.checked_at for r in kept.collect()} == {datetime(2024, 3, 31, 2)}
    catalog.create_views(mart, settings, kept)
    names = list(catalog.reports(mart, settings, kept))
    assert len(names) == 13
    for name in names:
        assert spark.table(name).columns
    assert spark.sql("SELECT count(*) FROM vw_data_quality_scorecard").first()[0] == 15
    assert spark.sql("SELECT max(access_friction_score) FROM vw_zip_access_friction").first()[0] > 0
    spark.sql("DROP TABLE scorecard_of_test")


def test_time_of_check_has_one_type(mart, settings):
    from carequeue.plans import quality

    given = quality.scorecard(mart, settings, datetime(2024, 1, 1)).schema["checked_at"].dataType
    assert quality.scorecard(mart, settings).schema["checked_at"].dataType == given


def test_registering_views_runs_no_job_and_readers_share_what_is_written(spark, mart, settings, monkeypatch):
    scorecard = catalog._empty(spark)
    built = []
    friction, attention = views.zip_friction, views.clinic_attention_index
    monkeypatch.setattr(views, "zip_friction", lambda *a, **k: built.append("friction") or friction(*a, **k))
    monkeypatch.setattr(views, "clinic_attention_index", lambda *a, **k: built.append("attention") or attention(*a, **k))
    spark.sparkContext.setJobGroup("views", "views")
    try:
        found = catalog.create_views(mart, settings, scorecard)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("views")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    planned = {name: sorted(map(str, spark.table(name).collect())) for name in found if name != "vw_data_quality_scorecard"}
    built.clear()
    for name, rows in planned.items():
        assert sorted(map(str, found.sql(f"SELECT * FROM {name}").collect())) == rows, name
    assert sorted(built) == ["attention", "friction"]
    assert found["vw_zip_access_friction"] is found["vw_zip_access_friction"]
