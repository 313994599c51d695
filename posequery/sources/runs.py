"""Run summaries, run metadata, the ledger and its comparison table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posequery.functions import nested
from posequery.functions.text import g6, run_key
from posequery.session import cut

_META_TYPE = (
    "schema_version string, sequence string, sequence_root string, created_utc string,"
    " code struct<git_commit_short:string,git_dirty:string>, config map<string,string>,"
    " config_label string, config_hash string, config_canonical_text string,"
    " paths struct<bench_root:string,output_dir:string,layout_template:string>,"
    " warnings array<string>, _corrupt_record string"
)
TABLE_COLUMNS = [
    "sequence",
    "commit",
    "dirty",
    "config",
    "status",
    "ate_trans_rmse",
    "rpe_trans_rmse",
    "completion_rate",
    "coverage_rate",
    "segments",
    "reanchors",
    "rtf",
    "wall_s",
]
_NUMBERS = ["ate_trans_rmse", "rpe_trans_rmse", "completion_rate", "coverage_rate", "rtf", "wall_s"]


def _whole_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", name)
        .text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )


def parse_summaries(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ledger rows, and the paths skipped because they hold no readable object.

    ``files`` holds ``path, value``.  Missing parts fall back, bad numbers are null.
    """
    documents = files.withColumn("s", nested.parsed(F.col("value")))
    readable = nested.is_object(F.col("s"))
    skipped = documents.where(~readable).select("path")

    def at(paths: str | list[str], kind: str, default=None, blank: bool = True) -> Column:
        return nested.found_at(F.col("s"), paths, kind, default, blank)

    label = at("config_label", "string", "default", blank=False)
    numbers = {
        "ate_trans_rmse": "ate.trans.rmse", "rpe_trans_rmse": "rpe.trans.rmse", "completion_rate": "trajectory.completion_rate",
        "coverage_rate": "trajectory.coverage_rate", "rtf": "timing.rtf", "wall_s": "timing.wall_s",
    }
    named = {name: at(path, "double").alias(name) for name, path in numbers.items()}
    rows = documents.where(readable).select(
        at("sequence", "string", "").alias("sequence"),
        at(["code.git_commit_short", "git_commit_short"], "string", "unknown", blank=False).alias("commit"),
        (at(["code.git_dirty", "git_dirty"], "string", "false") == "true").alias("dirty"),
        label.alias("config_label"),
        at("config_hash", "string", "").alias("config_hash"),
        F.concat(label, F.lit("_"), at("config_hash", "string", "")).alias("config"),
        at("status", "string", "").alias("status"),
        named["ate_trans_rmse"], named["rpe_trans_rmse"], named["completion_rate"], named["coverage_rate"],
        at("trajectory.segments", "long").alias("segments"),
        at("robustness.reanchors", "long").alias("reanchors"),
        named["rtf"], named["wall_s"],
        "path",
    )
    return rows, skipped


def read_run_summaries(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """All ``summary.json`` files below ``root``."""
    return parse_summaries(_whole_files(spark, root, "summary.json"))


def parse_meta(files: DataFrame) -> DataFrame:
    parsed = files.withColumn("m", F.from_json("value", _META_TYPE))
    return parsed.where(F.col("m._corrupt_record").isNull()).select("path", "m.*").drop(
        "_corrupt_record"
    )


def read_run_meta(spark: SparkSession, root: str) -> DataFrame:
    """All ``meta.json`` files below ``root`` with their configuration map."""
    return parse_meta(_whole_files(spark, root, "meta.json"))


def config_entries(meta: DataFrame) -> DataFrame:
    """One row per run and configuration key."""
    return meta.select("path", "sequence", F.explode("config").alias("key", "value"))


def overwrite_decision(exists: Column, dirty: Column, force: bool = False) -> Column:
    return (
        F.when(~exists, "write")
        .when(F.lit(force) | dirty, "overwrite_with_warning")
        .otherwise("refuse")
    )


def _planned(runs: DataFrame, existing: DataFrame, force: bool, arrival: str | None) -> DataFrame:
    """The plan, with ``_nth``: the place of a run among the incoming ones of its key."""
    keyed = runs.withColumn(
        "run_key",
        run_key(
            F.col("sequence"),
            F.col("commit"),
            F.col("dirty"),
            F.col("config_label"),
            F.col("config_hash"),
        ),
    )
    row = F.xxhash64(*[F.col(f"`{f.name}`") for f in runs.schema if "map<" not in f.dataType.simpleString()])
    order = [F.col(arrival)] if arrival else []
    # Rows without a key are no copies of each other; the hash keeps them apart.
    same = Window.partitionBy("run_key", F.when(F.col("run_key").isNull(), row)).orderBy(*order, row)
    numbered = keyed.withColumn("_nth", F.row_number().over(same))
    known = existing.select("run_key").distinct().withColumn("_known", F.lit(True))
    joined = numbered.join(known, "run_key", "left")
    exists = F.coalesce("_known", F.lit(False)) | (F.col("_nth") > 1)
    decision = F.when(F.col("run_key").isNull(), "invalid_key").otherwise(
        overwrite_decision(exists, F.col("dirty"), force)
    )
    return joined.withColumn("decision", decision).drop("_known")


def plan_ledger_write(
    runs: DataFrame, existing: DataFrame, force: bool = False, arrival: str | None = None
) -> DataFrame:
    """Incoming runs with their key and what may be done with them.

    ``runs`` carry ``sequence, commit, dirty, config_label, config_hash``; ``existing``
    carries ``run_key``.  Of incoming runs with one key the first by the column ``arrival``
    (by a hash of the row if there is none) meets the ledger, the others meet the first.
    """
    return _planned(runs, existing, force, arrival).drop("_nth")


def write_run_ledger(
    runs: DataFrame, path: str, force: bool = False, arrival: str | None = None
) -> DataFrame:
    """Write the runs that may be written and return the plan with all decisions.

    Of several runs with one key that may be written, the last stays.

    The ledger is partitioned by sequence; a folder per run would mean a file per row.
    Partitions of touched sequences are merged and replaced, others stay as they are.
    """
    spark = runs.sparkSession
    try:
        existing = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        existing = None
    known = spark.createDataFrame([], "run_key string") if existing is None else existing
    plan = cut(_planned(runs, known, force, arrival), "ledger-plan")
    good = plan.where(F.col("decision").isin("write", "overwrite_with_warning"))
    last = good.groupBy("run_key").agg(F.max("_nth").alias("_nth"))
    good = good.join(last, ["run_key", "_nth"], "left_semi").drop("decision", "_nth")
    merged = good
    if existing is not None:
        kept = existing.join(good.select("sequence").distinct(), "sequence", "left_semi").join(
            good.select("run_key"), "run_key", "left_anti"
        )
        merged = good.unionByName(kept, allowMissingColumns=True)
    (
        cut(merged, "ledger-rows")
        .repartitionByRange("sequence", "run_key")  # ranges split a sequence that holds most runs
        .sortWithinPartitions("sequence", "run_key")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("sequence")
        .parquet(path)
    )
    return plan.drop("_nth")


def bench_table(ledger: DataFrame) -> DataFrame:
    """Ledger rows as table text: six significant digits, null as empty, sorted."""
    text = ledger.select(
        "sequence",
        "commit",
        F.when(F.col("dirty"), "yes").otherwise("no").alias("dirty"),
        "config",
        "status",
        *[F.coalesce(g6(F.col(c)), F.lit("")).alias(c) for c in _NUMBERS[:4]],
        F.coalesce(F.col("segments").cast("string"), F.lit("")).alias("segments"),
        F.coalesce(F.col("reanchors").cast("string"), F.lit("")).alias("reanchors"),
        *[F.coalesce(g6(F.col(c)), F.lit("")).alias(c) for c in _NUMBERS[4:]],
    )
    return text.orderBy("sequence", "commit", "config")


def markdown_lines(table: DataFrame) -> DataFrame:
    """The body lines of a Markdown table, in the order of ``table``."""
    return table.select(
        F.concat(F.lit("| "), F.concat_ws(" | ", *TABLE_COLUMNS), F.lit(" |")).alias("value")
    )


def markdown_header() -> list[str]:
    return [
        "| " + " | ".join(TABLE_COLUMNS) + " |",
        "| " + " | ".join("---" for _ in TABLE_COLUMNS) + " |",
    ]


def write_bench_table(ledger: DataFrame, path: str) -> None:
    """CSV of the comparison table, sorted across its part files."""
    bench_table(ledger).write.option("header", "true").csv(path)
