from carequeue.session import TASK_SIZES, bounded_tasks
from checks.queries import all_queries
from tests.conftest import SMALL

SHUFFLED, READ = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"


def test_tasks_of_registered_reports_are_bounded_and_the_session_stays(spark):
    before = {key: spark.conf.get(key) for key in TASK_SIZES}
    try:
        spark.conf.set(SHUFFLED, "64MB")
        spark.conf.set(READ, "134217728b")
        own = all_queries()["referral_lag"](spark, SMALL).sparkSession
        assert {own.conf.get(key) for key in TASK_SIZES} == {"16MB"}
        assert own.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
        assert (spark.conf.get(SHUFFLED), spark.conf.get(READ)) == ("64MB", "134217728b")
        # Who asked for smaller ones keeps them.
        spark.conf.set(SHUFFLED, "1048576b")
        assert bounded_tasks(spark).conf.get(SHUFFLED) == "1048576b"
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_a_scan_is_cut_by_the_task_size(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(6_000_000).selectExpr("id", "xxhash64(id) AS h").coalesce(1).write.option("parquet.block.size", 1 << 20).parquet(path)
    wide, own = spark.newSession(), None
    wide.conf.set(READ, "128MB")
    wide.conf.set("spark.sql.files.openCostInBytes", "0")
    own = bounded_tasks(wide)
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    wide.conf.set("spark.sql.files.minPartitionNum", "1")
    assert own.read.parquet(path).rdd.getNumPartitions() > wide.read.parquet(path).rdd.getNumPartitions()
