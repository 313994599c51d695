"""Per-frame and per-track diagnostic files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posequery.sources.lines import headed_columns, read_lines, write_in_order

# Column names and order of the diagnostic files.
DIAG_COLUMNS = {
    "timestamp_ns": "long",
    "status": "string",
    "num_obs": "long",
    "num_landmarks": "long",
    "num_shared": "long",
    "low_connectivity": "boolean",
    "window_size": "long",
    "prior_key": "long",
    "reproj_rms_before_px": "double",
    "reproj_rms_after_px": "double",
    "num_cheirality": "long",
    "lm_iterations": "long",
    "max_window_pose_shift_m": "double",
    "segment_id": "long",
    "pnp_success": "boolean",
    "pnp_inliers": "long",
    "outliers_culled": "long",
    "reproj_rms_after_cull_px": "double",
    "is_keyframe": "boolean",
    "num_disparity": "long",
}
FRAME_COLUMNS = {
    "timestamp_ns": "long",
    "tracked": "long",
    "detected": "long",
    "valid": "long",
    "no_right_match": "long",
    "invalid_disparity": "long",
    "depth_out_of_range": "long",
    "fb_rejected": "long",
    "epipolar_median_px": "double",
    "epipolar_p95_px": "double",
}
TRACK_COLUMNS = {
    "id": "long",
    "first_timestamp_ns": "long",
    "last_timestamp_ns": "long",
    "length": "long",
}
PROBE_TYPE = (
    "i long, ts_ns long, culled_ids array<long>, zombie_track_n long, rejected_block_n long,"
    " new_lm long, shared long, num_obs long, lm_iterations long, shift_m double,"
    " shift_top array<struct<key:long,dt_m:double>>, res_mean_px double, res_max_px double,"
    " res_max_id long, drops_skipped_this_frame boolean"
)


def read_diag(spark: SparkSession, path: str) -> DataFrame:
    """Diagnostics of any age: columns an older file lacks are null, not zero."""
    return headed_columns(read_lines(spark, path), DIAG_COLUMNS)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return headed_columns(read_lines(spark, path), FRAME_COLUMNS)


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    return headed_columns(read_lines(spark, path), TRACK_COLUMNS)


def _fixed_text(name: str, kind: str) -> Column:
    if kind == "double":
        return F.format_string("%.6f", F.col(name)).alias(name)
    if kind == "boolean":
        return F.col(name).cast("int").cast("string").alias(name)
    return F.col(name).cast("string").alias(name)


def diag_text(diag: DataFrame, columns: dict[str, str] | None = None, *kept: str) -> DataFrame:
    """Diagnostics as the files spell them: six decimals, flags as 0 and 1; ``kept`` stay as they are."""
    kinds = columns or DIAG_COLUMNS
    keys = [c for c in ("run", "seq") if c in diag.columns]
    return diag.select(*keys, *kept, *[_fixed_text(n, k) for n, k in kinds.items()])


def write_diag(diag: DataFrame, path: str, columns: dict[str, str] | None = None) -> None:
    """CSV with header, a folder per run and sequence, in time order across part files."""
    stamp = next(iter(columns or DIAG_COLUMNS))
    text = diag_text(diag.withColumn("_at", F.col(stamp)), columns, "_at")
    write_in_order(text, ["run", "seq"], "_at", path, "csv", header="true")


def read_probe(spark: SparkSession, path: str) -> DataFrame:
    """Probe records, one JSON object per frame; light frames leave most fields null."""
    return spark.read.schema(PROBE_TYPE).json(path)


def probe_culls(probe: DataFrame) -> DataFrame:
    """One row per culled id."""
    keys = [c for c in ("run", "seq") if c in probe.columns]
    return probe.select(*keys, "i", "ts_ns", F.explode("culled_ids").alias("id"))


def probe_shifts(probe: DataFrame) -> DataFrame:
    """One row per reported pose shift."""
    keys = [c for c in ("run", "seq") if c in probe.columns]
    return probe.select(*keys, "i", "ts_ns", F.inline("shift_top"))
