"""Sensor recordings: camera manifests, inertial streams, layout and image inventory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posequery.functions.text import is_basename
from posequery.operators.validate import check_order
from posequery.session import cut
from posequery.sources import heads
from posequery.sources.lines import (
    Parsed,
    first_violation,
    number_checks,
    read_lines,
    stamp_check,
    violation,
)

# Exact headers of the sensor files, and the members of a recording.
CAMERA_HEADER = "#timestamp [ns],filename"
IMU_HEADER = (
    "#timestamp [ns],w_RS_S_x [rad s^-1],w_RS_S_y [rad s^-1],w_RS_S_z [rad s^-1],"
    "a_RS_S_x [m s^-2],a_RS_S_y [m s^-2],a_RS_S_z [m s^-2]"
)
LAYOUTS = {
    "euroc": [
        "mav0/cam0/data.csv",
        "mav0/cam0/sensor.yaml",
        "mav0/cam1/data.csv",
        "mav0/cam1/sensor.yaml",
        "mav0/imu0/data.csv",
        "mav0/imu0/sensor.yaml",
    ],
    "tum_vi": [
        "dso/camchain.yaml",
        "dso/imu_config.yaml",
        "mav0/cam0/data.csv",
        "mav0/cam1/data.csv",
        "mav0/imu0/data.csv",
    ],
    "partitioned": ["sensor=cam0/", "sensor=cam1/", "sensor=imu0/"],
}


def _parse(lines: DataFrame, header: str, checks: list[Column], width: int, columns: list[Column], repeats: bool):
    extra = [c for c in lines.columns if c not in ("file", "line", "value")]
    wrong_header = lines.where((F.col("line") == 1) & (F.col("value") != F.lit(header))).select(
        "file", "line", F.lit("invalid_header").alias("code"), F.lit("header").alias("field")
    )
    fields = F.col("fields")
    body = lines.where(F.col("line") > 1).withColumn("fields", F.split("value", ",", -1))
    judged = body.withColumn("ts_ns", F.get(fields, F.lit(0)).try_cast("long")).withColumn(
        "violation",
        first_violation(
            F.when(F.size(fields) != width, violation("invalid_column_count")),
            stamp_check(F.get(fields, F.lit(0))),
            *checks,
        ),
    )
    # The text is parsed once; order checks and readers share the typed table.
    judged = cut(judged.select("file", "line", *extra, "ts_ns", *columns, "violation"), "parsed")
    rows = judged.where(F.col("violation").isNull()).drop("violation")
    bad = judged.where(F.col("violation").isNotNull()).select(
        "file", "line", "violation.code", "violation.field"
    )
    order = check_order(rows, ["file"], repeats=repeats).select("file", "line", "code", "field")
    valid = rows.join(order.select("file", "line"), ["file", "line"], "left_anti")
    return Parsed(valid, bad.unionByName(wrong_header).unionByName(order))


def parse_camera_manifest(lines: DataFrame, repeats: bool = False) -> Parsed:
    """Stamps and bare file names of a camera's images; with ``repeats`` two images may share a stamp."""
    name = F.get(F.col("fields"), F.lit(1))
    return _parse(
        lines,
        CAMERA_HEADER,
        [F.when(~is_basename(name), violation("invalid_field", "filename"))],
        2,
        [name.alias("filename")],
        repeats,
    )


def parse_imu(lines: DataFrame, repeats: bool = False) -> Parsed:
    """Inertial samples; the files hold the gyroscope first.  With ``repeats`` samples may share a stamp."""
    axes = ["wx", "wy", "wz", "ax", "ay", "az"]
    fields = F.col("fields")
    return _parse(
        lines,
        IMU_HEADER,
        number_checks(fields, axes, 1),
        7,
        [F.get(fields, F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(axes)],
        repeats,
    )


_PLACES = {"seq": r"/([^/]+)/mav0/", "sensor": r"/mav0/([^/]+)/"}


def _keyed(lines: DataFrame) -> DataFrame:
    """``seq, sensor`` from ``seq=…/sensor=…`` folders, or from the path of a recording's member."""
    lacking = {n: F.regexp_extract("file", at, 1) for n, at in _PLACES.items() if n not in lines.columns}
    return lines.withColumns(lacking) if lacking else lines


def read_camera_manifest(spark: SparkSession, path: str, repeats: bool = False) -> Parsed:
    """Camera manifests: files of recordings, or a table partitioned by ``seq`` and ``sensor``."""
    return parse_camera_manifest(_keyed(read_lines(spark, path, only=["sensor LIKE 'cam%'"])), repeats)


def read_imu(spark: SparkSession, path: str, repeats: bool = False) -> Parsed:
    """Inertial streams, in the same two layouts as camera manifests."""
    return parse_imu(_keyed(read_lines(spark, path, only=["sensor LIKE 'imu%'"])), repeats)


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Paths and sizes under a folder; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", "length")
    )


def missing_members(files: DataFrame, members: Sequence[str] = LAYOUTS["euroc"]) -> DataFrame:
    """Required members without a file, per recording; ``files`` has ``path``.

    Members that end in a slash are folders ``sensor=…/`` of a partitioned table.
    """
    if all(m.endswith("/") for m in members):
        place = r"/seq=([^/]+)/(sensor=[^/]+/)[^/]+$"
    else:
        tops = "|".join(sorted({m.split("/")[0] for m in members}))
        place = rf"/([^/]+)/((?:{tops})/.+)$"
    found = (
        files.select(
            F.regexp_extract("path", place, 1).alias("seq"),
            F.regexp_extract("path", place, 2).alias("member"),
        )
        .where(F.length("seq") > 0)
        .distinct()
    )
    expected = found.select("seq").distinct().select(
        "seq", F.explode(F.array(*[F.lit(m) for m in members])).alias("member")
    )
    return expected.join(found, ["seq", "member"], "left_anti")


def open_sequences(
    spark: SparkSession, root: str, layout: str = "euroc", repeats: bool = False
) -> tuple[Parsed, Parsed, DataFrame]:
    """Camera manifests, inertial streams and missing members of all recordings below ``root``.

    The layout ``partitioned`` is a table of lines with folders ``seq=…/sensor=…``.  With ``repeats`` rows of
    a file may share a stamp.
    """
    if layout == "partitioned":
        files = list_files(spark, root)
        return read_camera_manifest(spark, root, repeats), read_imu(spark, root, repeats), missing_members(files, LAYOUTS[layout])
    cameras = read_camera_manifest(spark, f"{root}/*/mav0/cam*/data.csv", repeats)
    imu = read_imu(spark, f"{root}/*/mav0/imu*/data.csv", repeats)
    files = list_files(spark, root, "{data.csv,*.yaml}")
    return cameras, imu, missing_members(files, LAYOUTS[layout])


def png_header(content: Column) -> Column:
    """``ok, width, height, depth, grey`` from the fixed first bytes of a PNG file."""

    def number(start: int, size: int) -> Column:
        return F.conv(F.hex(F.substring(content, start, size)), 16, 10).cast("long")

    signature = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    return F.struct(
        (signature & (F.hex(F.substring(content, 13, 4)) == "49484452")).alias("ok"),
        number(17, 4).alias("width"),
        number(21, 4).alias("height"),
        number(25, 1).alias("depth"),
        (number(26, 1) == 0).alias("grey"),
    )


def image_inventory(
    manifest: DataFrame, files: DataFrame, width: int, height: int, depths: Sequence[int] = (8, 16)
) -> DataFrame:
    """Manifest rows without file, files without row, and images of the wrong form.

    ``manifest`` holds ``seq, sensor, filename``; ``files`` the same keys and ``content``, of which the
    first bytes are enough (:func:`heads.read_heads`); rows with an ``error`` column that is not
    null could not be read.  Pixels are not decoded.
    """
    keys = ["seq", "sensor", "filename"]
    header = png_header(F.col("content"))
    failed = F.col("error").isNotNull() if "error" in files.columns else F.lit(False)
    checked = files.select(*keys, header.alias("h"), failed.alias("failed"))
    issue = (
        F.when(F.col("failed"), "unreadable")
        .when(~F.coalesce("h.ok", F.lit(False)), "not_png")
        .when((F.col("h.width") != width) | (F.col("h.height") != height), "wrong_size")
        .when(~F.col("h.grey") | ~F.col("h.depth").isin(list(depths)), "wrong_depth")
    )
    missing = manifest.select(*keys).join(files.select(*keys), keys, "left_anti")
    orphans = files.select(*keys).join(manifest.select(*keys), keys, "left_anti")
    return (
        missing.withColumn("issue", F.lit("missing_file"))
        .unionByName(orphans.withColumn("issue", F.lit("orphan_file")))
        .unionByName(
            checked.join(manifest.select(*keys), keys, "left_semi")
            .select(*keys, issue.alias("issue"))
            .where(F.col("issue").isNotNull())
        )
    )


def read_image_heads(spark: SparkSession, root: str, pattern: str = "*.png") -> DataFrame:
    """``seq, sensor, filename, path, content, error`` of the images below ``root``; 33 bytes of each are read."""
    files = list_files(spark, root, pattern)
    place = r"/([^/]+)/mav0/([^/]+)/(?:.*/)?([^/]+)$"
    names = [F.regexp_extract("path", place, k).alias(n) for k, n in ((1, "seq"), (2, "sensor"), (3, "filename"))]
    return heads.read_heads(files.select(*names, "path"))


def missing_and_orphan(manifest: DataFrame, files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows on one side only, marked by side."""
    left, right = manifest.select(*keys).distinct(), files.select(*keys).distinct()
    return (
        left.join(right, list(keys), "left_anti")
        .withColumn("issue", F.lit("missing"))
        .unionByName(right.join(left, list(keys), "left_anti").withColumn("issue", F.lit("orphan")))
    )


def replay_union(imu: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """One stream of typed events; ``rank`` orders kinds at equal stamps."""

    def tag(df: DataFrame, kind: str, rank: int) -> DataFrame:
        return df.withColumn("kind", F.lit(kind)).withColumn("rank", F.lit(rank))

    merged = tag(imu, "imu", 0).unionByName(tag(left, "left", 1), allowMissingColumns=True)
    return merged.unionByName(tag(right, "right", 2), allowMissingColumns=True)


def stream_summary(streams: DataFrame) -> DataFrame:
    """Count, first and last stamp per sequence and kind."""
    return streams.groupBy("seq", "kind").agg(
        F.count(F.lit(1)).alias("count"),
        F.min("ts_ns").alias("first_ns"),
        F.max("ts_ns").alias("last_ns"),
    )


def static_check(
    imu: DataFrame, gravity: float = 9.81, tolerance: float = 0.5
) -> DataFrame:
    """Mean and spread of a still interval, and whether it shows gravity along +z."""
    means = imu.groupBy("seq").agg(
        *[F.avg(a).alias(f"mean_{a}") for a in ("ax", "ay", "az")],
        *[F.stddev_pop(a).alias(f"std_{a}") for a in ("ax", "ay", "az")],
    )
    near = (
        (F.abs("mean_ax") <= tolerance)
        & (F.abs("mean_ay") <= tolerance)
        & (F.abs(F.col("mean_az") - gravity) <= tolerance)
    )
    return means.withColumn("still", near)
