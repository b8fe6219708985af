import pytest
from pyspark.ml.feature import StringIndexer

from carequeue.plans import views
from carequeue.plans.linked import linked
from carequeue.sources import files, quoted, versions
from carequeue.sources.schemas import FACT_ORDER, SCHEMAS
from carequeue.sources.tpch import TpchMart
from tests.conftest import SMALL


@pytest.fixture
def folder(spark, mart, tmp_path):
    for name, frame in mart.tables.items():
        frame.coalesce(1).write.option("header", True).csv(str(tmp_path / f"{name}.csv"))
    return tmp_path


def test_csv_to_parquet(spark, mart, folder, tmp_path):
    files.load_tables(spark, str(folder), str(tmp_path / "mart"))
    again = files.load_tables(spark, str(folder), str(tmp_path / "mart"))
    audit = {r.table_name: r.row_count for r in files.load_audit(again).collect()}
    assert audit == {name: mart.tables[name].count() for name in SCHEMAS}
    assert {r.zip_code for r in again["dim_zip_code"].collect()} == {"06001", "06002", "06003"}
    assert again["dim_patient"].schema["transportation_risk_flag"].dataType.simpleString() == "boolean"


def test_missing_source_names_the_file(spark, tmp_path):
    with pytest.raises(files.MissingSource, match="fact_referral.csv"):
        files.read_table(spark, str(tmp_path), "fact_referral")


def test_views_and_scalars(spark, mart):
    files.register_views({"v_clinics": mart.table("clinic")})
    files.register_views({"v_clinics": mart.table("clinic").where("clinic_id = 'C1'")})
    assert files.scalar(spark.sql("SELECT count(*) FROM v_clinics")) == 1
    assert files.scalar(spark.sql("SELECT max(clinic_name) FROM v_clinics WHERE false"), "none") == "none"


def test_only_needed_tables_are_read(spark):
    mart = TpchMart(spark, SMALL)
    plan = mart.table("appointment", "appointment_id", "visit_mode")._jdf.queryExecution().toString()
    assert "supplier" not in plan and "s_suppkey" not in plan and "p_partkey" not in plan



CELLS = "clinic_id string, clinic_name string, weekly_intake_slot_capacity bigint, opened date"


def written(folder, text, name="cells.csv"):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = written(tmp_path, 'opened,extra,clinic_name,weekly_intake_slot_capacity,clinic_id\n2024-01-02,x,"Adult ""A"" Clinic",12,C1\n')
    row = files.read_csv(spark, path, CELLS).first()
    assert (row.clinic_id, row.clinic_name, row.weekly_intake_slot_capacity, str(row.opened)) == ("C1", 'Adult "A" Clinic', 12, "2024-01-02")
    with pytest.raises(ValueError, match="clinic_name"):
        files.read_csv(spark, written(tmp_path, "clinic_id\nC1\n", "few.csv"), CELLS)


def test_csv_cell_of_the_wrong_type_fails(spark, tmp_path):
    path = written(tmp_path, "clinic_id,clinic_name,weekly_intake_slot_capacity,opened\nC1,A,twelve,2024-01-02\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        files.read_csv(spark, path, CELLS).collect()


def test_csv_round_trip_of_quotes_and_line_ends(spark, tmp_path):
    rows = [("C1", 'one "two", three', 1, None), ("C2", "line\nend", None, None), ("C3", None, 3, None)]
    frame = spark.createDataFrame(rows, CELLS)
    files.write_csv(frame.coalesce(1), str(tmp_path / "out"))
    again = files.read_csv(spark, str(tmp_path / "out"), CELLS, multi_line=True)
    assert sorted(again.collect(), key=str) == sorted(frame.collect(), key=str)


def test_refresh_from_itself_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="itself"):
        files.load_tables(spark, str(tmp_path), f"{tmp_path}/", "parquet")


def test_repeated_keys(spark, mart):
    tables = dict(mart.tables)
    assert {r.repeated_keys for r in files.repeated_keys(tables).collect()} == {0}
    tables["dim_clinic"] = tables["dim_clinic"].union(tables["dim_clinic"])
    found = {r.table_name: r.repeated_keys for r in files.repeated_keys(tables).collect()}
    assert found["dim_clinic"] == mart.tables["dim_clinic"].count()


def test_refresh_counts_source_and_target(spark, mart, tmp_path):
    own = versions.loading_session(spark)
    frames = {name: own.createDataFrame(frame.collect(), frame.schema) for name, frame in mart.tables.items()}
    match = versions.refresh(frames, str(tmp_path / "mart"), FACT_ORDER)
    rows = {r.table_name: (r.source_rows, r.target_rows, r.equal) for r in match.collect()}
    assert rows == {name: (n := frame.count(), n, True) for name, frame in mart.tables.items()}
    again = files.open_tables(spark, str(tmp_path / "mart"))
    for name, frame in mart.tables.items():
        assert sorted(map(str, again[name].collect())) == sorted(map(str, frame.collect()))


def test_a_session_can_score_after_a_refresh(spark, folder, tmp_path):
    files.load_tables(spark, str(folder), str(tmp_path / "mart"))
    rows = spark.createDataFrame([("a", 0.0), ("b", 1.0)] * 5, "c string, y double")
    model = StringIndexer(inputCol="c", outputCol="i").fit(rows)
    assert model.transform(rows).select("i").distinct().count() == 2
    assert versions.loading_session(spark).conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")


def test_readers_keep_their_version_and_failures_change_nothing(spark, tmp_path):
    target = str(tmp_path / "mart")
    assert versions.current(spark, target) is None and versions.release(spark, target) == []
    with pytest.raises(files.MissingSource):
        files.open_tables(spark, target)
    rows = versions.loading_session(spark).range(20, numPartitions=3).selectExpr("id")
    versions.refresh({"t": rows}, target)
    first = versions.current(spark, target)
    opened = spark.read.parquet(f"{first}/t.parquet")
    versions.refresh({"t": rows.where("id < 5")}, target, {"t": ["id"]})
    second = versions.current(spark, target)
    assert second != first and spark.read.parquet(f"{second}/t.parquet").count() == 5 and opened.count() == 20
    with pytest.raises(Exception, match="boom"):
        versions.refresh({"t": rows, "u": rows.selectExpr("raise_error('boom') AS x")}, target)
    assert versions.current(spark, target) == second
    assert versions.release(spark, target) == [first.rsplit("/", 1)[1]]
    assert spark.read.parquet(f"{second}/t.parquet").count() == 5
    assert [p.name for p in (tmp_path / "mart" / "versions").iterdir()] == [second.rsplit("/", 1)[1]]


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of a few hundred bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {key: spark.conf.get(key) for key in keys}
    spark.conf.set(keys[0], "300")
    spark.conf.set(keys[1], "0")
    yield spark
    for key, value in before.items():
        spark.conf.set(key, value)


def test_quoted_line_ends_are_read_by_ranges(small_ranges, tmp_path):
    spark = small_ranges
    rows = []
    for k in range(200):
        name = {0: 'say "a, b"', 1: "two\nlines", 2: "many\n\n" * (k % 30) + "end", 3: None, 4: '"\n"\n', 5: "x" * 700, 6: "a,\r\nb"}[k % 7]
        rows.append((f"C{k}", name, k, None))
    text = "clinic_id,clinic_name,weekly_intake_slot_capacity,opened\n" + "".join(
        f'{a},{"" if b is None else chr(34) + b.replace(chr(34), chr(34) * 2) + chr(34)},{c},\n' for a, b, c, _ in rows
    )
    folder = tmp_path / "cells"
    folder.mkdir()
    half = text.index("C100,")
    header = text.split("\n", 1)[0] + "\n"
    (folder / "one.csv").write_bytes(text[:half].encode())
    (folder / "two.csv").write_bytes((header + text[half:]).replace("C150,", "C150é,").encode())
    frame = files.read_csv(spark, str(folder), CELLS, multi_line=True)
    lines = quoted._lines(spark, str(folder))
    assert lines.rdd.getNumPartitions() > 20
    assert lines.select("file", "start").distinct().count() > 20
    found = sorted((r.clinic_id.replace("é", ""), r.clinic_name, r.weekly_intake_slot_capacity, r.opened) for r in frame.collect())
    assert found == sorted(rows)


def test_files_of_different_headers_are_refused(spark, tmp_path):
    folder = tmp_path / "cells"
    folder.mkdir()
    (folder / "one.csv").write_text("clinic_id,clinic_name,weekly_intake_slot_capacity,opened\nC1,A,1,\n")
    (folder / "two.csv").write_text("clinic_name,clinic_id,weekly_intake_slot_capacity,opened\nB,C2,1,\n")
    with pytest.raises(ValueError, match="headers"):
        files.read_csv(spark, str(folder), CELLS, multi_line=True)


def test_lenient_cells_of_the_wrong_type_are_null(spark, tmp_path):
    path = written(tmp_path, "clinic_id,clinic_name,weekly_intake_slot_capacity,opened\nC1,A,twelve,2024-13-02\nC2,B, 7,2024-01-02\n")
    for multi_line in (False, True):
        found = {r.clinic_id: r for r in files.read_csv(spark, path, CELLS, multi_line, lenient=True).collect()}
        assert found["C1"].weekly_intake_slot_capacity is None and found["C1"].opened is None
        assert found["C2"].weekly_intake_slot_capacity == 7 and str(found["C2"].opened) == "2024-01-02"


def test_bucketed_facts_join_without_a_shuffle(spark, mart, settings):
    names = {"fact_referral": "referral_created_date", "fact_appointment": "appointment_date"}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files.save_bucketed({name: mart.tables[name] for name in names}, "referral_id", 4, names)
        bucketed = files.TableMart(mart.tables | {name: spark.table(name) for name in names})
        rows = linked(bucketed, ["appointment_status"], ["referral_status"])
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        for report in (views.clinic_performance, views.zip_friction, views.referral_lag):
            assert sorted(map(str, report(bucketed, settings).collect())) == sorted(map(str, report(mart, settings).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
