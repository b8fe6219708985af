"""Reading and writing the mart's files."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from carequeue.sources.quoted import records
from carequeue.sources.schemas import FACT_ORDER, KEYS, METRICS, PREDICTIONS, ROLE_TABLES, SCHEMAS
from carequeue.sources.versions import current, loading_session, refresh


class MissingSource(FileNotFoundError):
    """A table's file is not where it should be."""


# How CSV files are written and read: quotes inside quotes are doubled.
CSV = {"header": True, "quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = False, lenient: bool = False) -> DataFrame:
    """CSV files with header, columns found by their names.

    The header may have any order and more columns, but must be the same in all files. A cell that is not of its
    column's type fails the job; where ``lenient``, it is null. Cells with line ends need ``multi_line``; such files too are
    read by byte ranges (see ``quoted``).
    """
    names = spark.read.options(**CSV).csv(path).columns
    wanted = StructType.fromDDL(schema)
    missing = [field.name for field in wanted if field.name not in names]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    typed = {field.name: StringType() if lenient else field.dataType for field in wanted}
    found = StructType([StructField(name, typed.get(name, StringType())) for name in names])
    if multi_line:
        rows = _read_records(spark, path, found)
    else:
        rows = spark.read.schema(found).options(**CSV, enforceSchema=False, mode="FAILFAST").csv(path)
    if lenient:
        return rows.select([F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted])
    return rows.select(wanted.names)


def _read_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    found = records(spark, path)
    headers = [row.record for row in found.where("first").select("record").distinct().limit(2).collect()]
    if len(headers) > 1:
        raise ValueError(f"{path} has files of different headers: {headers[0]!r} and {headers[1]!r}")
    options = {"mode": "FAILFAST", "quote": CSV["quote"], "escape": CSV["escape"], "multiLine": "true"}
    cells = F.from_csv("record", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options)
    return found.where("NOT first AND record <> ''").select(cells.alias("cells")).select("cells.*")


def read_table(
    spark: SparkSession, folder: str, table: str, form: str = "csv", multi_line: bool = False
) -> DataFrame:
    """One table of the mart, from ``<folder>/<table>.<form>`` (CSV with header, or parquet)."""
    path = f"{folder.rstrip('/')}/{table}.{form}"
    try:
        if form == "csv":
            return read_csv(spark, path, SCHEMAS[table], multi_line)
        return spark.read.schema(SCHEMAS[table]).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise MissingSource(f"Missing {path}: table {table} has no source file") from error
        raise


def load_tables(
    spark: SparkSession, folder: str, target: str | None = None, form: str = "csv"
) -> dict[str, DataFrame]:
    """Read every table; with a ``target`` folder, refresh it there as parquet (see ``versions``) and read that."""
    if target is not None and form == "parquet" and target.rstrip("/") == folder.rstrip("/"):
        raise ValueError(f"{target} can't be refreshed from itself")
    if target is None:
        return {name: read_table(spark, folder, name, form) for name in SCHEMAS}
    own = loading_session(spark)
    refresh({name: read_table(own, folder, name, form) for name in SCHEMAS}, target, FACT_ORDER)
    return open_tables(spark, target)


def open_tables(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """The tables of the version that is current now; they stay as they are when the target is refreshed."""
    place = current(spark, target)
    if place is None:
        raise MissingSource(f"{target} holds no version of the mart")
    return {name: read_table(spark, place, name, "parquet") for name in SCHEMAS}


def load_audit(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) for every table."""
    counts = [
        frame.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, frame in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def repeated_keys(tables: Mapping[str, DataFrame], keys: Mapping[str, str] = KEYS) -> DataFrame:
    """(table_name, repeated_keys) for every table whose key the reports take to be unique: keys that several rows have."""
    counts = [
        tables[name]
        .where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count_if(F.col("n") > 1).alias("repeated_keys"))
        .select(F.lit(name).alias("table_name"), "repeated_keys")
        for name, key in keys.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def register_views(views: Mapping[str, DataFrame]) -> None:
    """Register each frame as a temporary view, replacing one of the same name."""
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)


def save_bucketed(frames: Mapping[str, DataFrame], key: str, buckets: int, sort: Mapping[str, str]) -> None:
    """Full refresh of catalog tables that are joined on ``key``, all cut alike by its hash into so many buckets.

    Their join needs no shuffle. Rows are sorted by the given column inside a bucket, so that a date window skips row
    groups. A bucket can't be split in a join: for keys of which none holds more than a task's share of the rows.
    """
    for name, frame in frames.items():
        # One task writes each bucket, as one file.
        dealt = frame.repartition(buckets, key)
        dealt.write.bucketBy(buckets, key).sortBy(sort[name]).mode("overwrite").saveAsTable(name)


def save_table(frame: DataFrame, name: str) -> None:
    """Full refresh of a catalog table."""
    frame.write.mode("overwrite").saveAsTable(name)


def write_parquet(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").parquet(path)


def write_csv(frame: DataFrame, path: str) -> None:
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    frame.write.mode("overwrite").options(**CSV, **keep).csv(path)


def write_json(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, PREDICTIONS)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS).json(path)


def scalar(frame: DataFrame, default=0):
    """The single value of a one-column aggregate, or the default where there is none."""
    row = frame.first()
    return default if row is None or row[0] is None else row[0]


class TableMart:
    """The mart over its own tables, by table name."""

    #: appointments carry their own patient
    patient_from_referral = False

    def __init__(self, tables: Mapping[str, DataFrame]):
        self.tables = tables
        self.spark = next(iter(tables.values())).sparkSession

    def table(self, role: str, *columns: str) -> DataFrame:
        frame = self.tables[ROLE_TABLES[role]]
        return frame.select(*columns) if columns else frame
