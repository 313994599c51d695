"""Rows that are easy to lose: late stamps, small split files, repeated keys, salted joins."""

from pyspark.sql import functions as F

from posequery.operators.validate import check_order
from posequery.plans.spread import join_per_key
from posequery.sources.lines import read_lines
from posequery.sources.runs import plan_ledger_write, write_run_ledger


def test_order_is_judged_against_the_latest_stamp(spark):
    stamps = [5, 9, 3, 6, 9, 10, 10, 11]
    rows = spark.createDataFrame([("a", i, t) for i, t in enumerate(stamps)], "seq string, line long, ts_ns long")
    for width in (1, 2, 100):
        bad = {r.line: r.code for r in check_order(rows, ["seq"], width=width).collect()}
        assert bad == {
            2: "out_of_order_timestamp",
            3: "out_of_order_timestamp",
            4: "duplicate_timestamp",
            6: "duplicate_timestamp",
        }


def test_small_files_that_are_split_keep_their_line_numbers(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text("".join(f"{i}\n" for i in range(1, 20_001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        for cost in ("4m", "1k"):
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            rows = read_lines(spark, str(path))
            assert rows.where(F.col("line") != F.col("value").cast("long")).count() == 0
            assert rows.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


_RUN = "sequence string, commit string, dirty boolean, config_label string, config_hash string, at long"


def test_second_run_of_a_key_meets_the_first(spark, tmp_path):
    clean = ("s", "abc1234", False, "default", "12345678")
    dirty = ("s", "abc1234", True, "default", "12345678")
    runs = spark.createDataFrame([(*clean, 2), (*clean, 1), (*dirty, 1), (*dirty, 3)], _RUN)
    plan = plan_ledger_write(runs, spark.createDataFrame([], "run_key string"), arrival="at")
    assert sorted((r.dirty, r.at, r.decision) for r in plan.collect()) == [
        (False, 1, "write"),
        (False, 2, "refuse"),
        (True, 1, "write"),
        (True, 3, "overwrite_with_warning"),
    ]
    path = str(tmp_path / "ledger")
    write_run_ledger(runs, path, arrival="at")
    kept = spark.read.parquet(path).collect()
    assert sorted((r.dirty, r.at) for r in kept) == [(False, 1), (True, 3)]


def test_salts_follow_from_the_row(spark):
    rows = spark.range(1000).select(F.lit("k").alias("key"), "id")
    sides = spark.createDataFrame([("k", 1)], "key string, n int")
    joined = join_per_key(rows, sides, ["key"])
    assert joined.count() == 1000
    plan = joined._jdf.queryExecution().toString()
    assert "monotonically_increasing_id" not in plan and "xxhash64" in plan
