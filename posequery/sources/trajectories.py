"""Trajectory text files, ground-truth state files and error tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posequery.functions.geometry import POSE_COLUMNS, Quat, quat_normalize
from posequery.functions.text import ns_to_seconds_text, seconds_text_to_ns
from posequery.operators.validate import check_order, check_quaternion
from posequery.session import cut
from posequery.sources.lines import (
    Parsed,
    first_violation,
    headed_columns,
    number_checks,
    read_lines,
    stamp_check,
    violation,
    write_in_order,
)

# Column names of the ground-truth state file, in file order.
GROUNDTRUTH_HEADER = (
    "#timestamp, p_RS_R_x [m], p_RS_R_y [m], p_RS_R_z [m], q_RS_w [], q_RS_x [], q_RS_y [],"
    " q_RS_z [], v_RS_R_x [m s^-1], v_RS_R_y [m s^-1], v_RS_R_z [m s^-1],"
    " b_w_RS_S_x [rad s^-1], b_w_RS_S_y [rad s^-1], b_w_RS_S_z [rad s^-1],"
    " b_a_RS_S_x [m s^-2], b_a_RS_S_y [m s^-2], b_a_RS_S_z [m s^-2]"
)
ERROR_COLUMNS = {
    "timestamp_ns": "long",
    "dt_ns": "long",
    "err_trans_m": "double",
    "err_rot_deg": "double",
    "est_x": "double",
    "est_y": "double",
    "est_z": "double",
    "gt_x": "double",
    "gt_y": "double",
    "gt_z": "double",
}


def _with_order(good: DataFrame, bad: DataFrame, repeats: bool) -> Parsed:
    """Add order violations of the parsed rows; rows that break the order are not valid."""
    order = check_order(good, ["file"], repeats=repeats).select("file", "line", "code", "field")
    rows = good.join(order.select("file", "line"), ["file", "line"], "left_anti")
    return Parsed(rows, bad.select("file", "line", "code", "field").unionByName(order))


def _split(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and violations; the text is parsed once and kept as a typed table."""
    judged = cut(judged.drop("fields"), "parsed")
    bad = judged.where(F.col("violation").isNotNull()).select(
        "file", "line", "violation.code", "violation.field"
    )
    return judged.where(F.col("violation").isNull()).drop("violation"), bad


def parse_tum(lines: DataFrame, repeats: bool = False) -> Parsed:
    """Pose rows of ``seconds tx ty tz qx qy qz qw`` lines.

    Time goes to nanoseconds without floating point.  Blank and ``#`` lines are skipped;
    quaternions near unit norm are normalised.  With ``repeats`` poses of a file may share a stamp.
    """
    extra = [c for c in lines.columns if c not in ("file", "line", "value")]
    text = F.regexp_replace(F.trim(F.col("value")), r"\s+", " ")
    fields = F.col("fields")
    content = (
        lines.withColumn("text", text)
        .where((F.length("text") > 0) & ~F.col("text").startswith("#"))
        .withColumn("fields", F.split("text", " "))
        .withColumn("ts_ns", seconds_text_to_ns(F.get(F.col("fields"), F.lit(0))))
    )
    numbers = [F.get(fields, F.lit(i + 1)).try_cast("double") for i in range(7)]
    q = Quat(*[F.col(c) for c in POSE_COLUMNS[3:]])
    subnano = F.get(fields, F.lit(0)).rlike(r"^-?[0-9]+\.[0-9]{10,}$")
    parsed = content.select(
        "file",
        "line",
        *extra,
        "fields",
        "ts_ns",
        *[n.alias(c) for n, c in zip(numbers, POSE_COLUMNS, strict=True)],
    )
    judged = parsed.withColumn(
        "violation",
        first_violation(
            F.when(F.size(fields) != 8, violation("invalid_record")),
            F.when(subnano, violation("sub_nanosecond", "timestamp")),
            F.when(F.col("ts_ns").isNull(), violation("invalid_record", "timestamp")),
            *number_checks(fields, POSE_COLUMNS, 1),
            F.when(~check_quaternion(q), violation("non_unit_quaternion", "qx qy qz qw")),
        ),
    )
    good, bad = _split(judged)
    unit = quat_normalize(q)
    rows = good.select(
        "file",
        "line",
        *extra,
        "ts_ns",
        *POSE_COLUMNS[:3],
        *[c.alias(n) for c, n in zip(unit, POSE_COLUMNS[3:], strict=True)],
    )
    return _with_order(rows, bad, repeats)


def read_tum(spark: SparkSession, path: str, repeats: bool = False) -> Parsed:
    """Trajectories under ``path``; ``run=`` and ``seq=`` folders become columns."""
    return parse_tum(read_lines(spark, path), repeats)


def tum_lines(poses: DataFrame) -> DataFrame:
    """Text of each pose; numbers are the shortest text that reads back unchanged."""
    numbers = [F.col(c).cast("string") for c in POSE_COLUMNS]
    return poses.select(
        "run", "seq", "ts_ns", F.concat_ws(" ", ns_to_seconds_text(F.col("ts_ns")), *numbers).alias("value")
    )


def write_tum(poses: DataFrame, path: str) -> None:
    """One folder per run and sequence, in time order across its part files.

    Ranges of time are written side by side, so one long sequence is not one task.
    """
    write_in_order(tum_lines(poses), ["run", "seq"], "ts_ns", path)


def parse_groundtruth(lines: DataFrame, repeats: bool = False) -> Parsed:
    """State rows: pose (quaternion normalised), velocity and biases.  With ``repeats`` rows may share a stamp."""
    # Field names of the pose columns as the files spell them.
    pose_fields = ["p_RS_R_x", "p_RS_R_y", "p_RS_R_z", "q_RS_w", "q_RS_x", "q_RS_y", "q_RS_z"]
    targets = ["tx", "ty", "tz", "qw", "qx", "qy", "qz"]
    rest = ["vx", "vy", "vz", "bgx", "bgy", "bgz", "bax", "bay", "baz"]
    extra = [c for c in lines.columns if c not in ("file", "line", "value")]
    header = lines.where(
        (F.col("line") == 1) & (F.trim("value") != F.lit(GROUNDTRUTH_HEADER))
    ).select("file", "line", F.lit("invalid_header").alias("code"), F.lit("header").alias("field"))
    fields = F.col("fields")
    parsed = lines.where(F.col("line") > 1).withColumn("fields", F.split("value", ",", -1))
    parsed = parsed.select(
        "file",
        "line",
        *extra,
        "fields",
        F.get(fields, F.lit(0)).try_cast("long").alias("ts_ns"),
        *[
            F.get(fields, F.lit(i + 1)).try_cast("double").alias(n)
            for i, n in enumerate([*targets, *rest])
        ],
    )
    q = Quat(*[F.col(c) for c in ("qx", "qy", "qz", "qw")])
    judged = parsed.withColumn(
        "violation",
        first_violation(
            F.when(F.size(fields) != 17, violation("invalid_column_count")),
            stamp_check(F.get(fields, F.lit(0))),
            *number_checks(fields, pose_fields, 1),
            F.when(~check_quaternion(q), violation("invalid_field", "q_RS")),
        ),
    )
    good, bad = _split(judged)
    unit = quat_normalize(q)
    rows = good.select(
        "file",
        "line",
        *extra,
        "ts_ns",
        "tx",
        "ty",
        "tz",
        *[c.alias(n) for c, n in zip(unit, ("qx", "qy", "qz", "qw"), strict=True)],
        *rest,
    )
    return _with_order(rows, bad.unionByName(header), repeats)


def read_groundtruth(spark: SparkSession, path: str, repeats: bool = False) -> Parsed:
    """Ground-truth state files; ``seq`` comes from folders ``seq=…`` or is the one above ``mav0``."""
    lines = read_lines(spark, path)
    if "seq" not in lines.columns:
        lines = lines.withColumn("seq", F.regexp_extract("file", r"/([^/]+)/mav0/", 1))
    return parse_groundtruth(lines, repeats)


def errors_table(errors: DataFrame) -> DataFrame:
    """Per-sample errors in the column order of the error files."""
    return errors.select(
        "run",
        "seq",
        F.col("ts_ns").alias("timestamp_ns"),
        "dt_ns",
        "err_trans_m",
        "err_rot_deg",
        F.col("aligned_x").alias("est_x"),
        F.col("aligned_y").alias("est_y"),
        F.col("aligned_z").alias("est_z"),
        F.col("gt.tx").alias("gt_x"),
        F.col("gt.ty").alias("gt_y"),
        F.col("gt.tz").alias("gt_z"),
    )


def write_errors(errors: DataFrame, path: str) -> None:
    errors_table(errors).write.partitionBy("run", "seq").option("header", "true").csv(path)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """Error files, columns by header name."""
    return headed_columns(read_lines(spark, path), ERROR_COLUMNS)
