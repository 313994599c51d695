"""Recordings-shaped views over the star-schema test tables.

Each view is a table, a filter and expressions that Spark and an ANSI engine read
alike, so one definition feeds both sides of a comparison.  ``{ns}`` marks a
timestamp column that becomes integer nanoseconds.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_NS = 86_400_000_000_000
EPOCH_2024 = 1_704_067_200_000_000_000
_POSES = "event_type IN ('click','purchase','error')"
_JITTER = (
    "CASE WHEN event_id % 11 = 0 THEN 5000000000 ELSE ((event_id % 5) - 2) * 1000000 END"
)

# name -> (table, filter, {column: expression})
VIEWS: dict[str, tuple[str, str, dict[str, str]]] = {
    "gt": (
        "events",
        _POSES,
        {
            "seq": "user_id % 10",
            "ts_ns": "{ns:ts}",
            "event_id": "event_id",
            "tx": "cos(2e-1 * event_id)",
            "ty": "sin(2e-1 * event_id)",
            "tz": "0e0",
            "qx": "0e0",
            "qy": "0e0",
            "qz": "sin(1e-1 * event_id)",
            "qw": "cos(1e-1 * event_id)",
        },
    ),
    "est": (
        "events",
        f"{_POSES} AND event_id % 4 <> 1",
        {
            "run": "'a'",
            "seq": "user_id % 10",
            "ts_ns": f"{{ns:ts}} + {_JITTER}",
            "event_id": "event_id",
            "tx": "cos(2e-1 * event_id + 7e-1) + 3 + 1e-2 * ((event_id % 7) - 3)",
            "ty": "sin(2e-1 * event_id + 7e-1) - 4 + 1e-2 * ((event_id % 3) - 1)",
            "tz": "0e0",
            "qx": "0e0",
            "qy": "0e0",
            "qz": "sin(1e-1 * event_id + 35e-2)",
            "qw": "cos(1e-1 * event_id + 35e-2)",
        },
    ),
    # A second run of the same sequences that leaves the first from day 12 on.
    "est_b": (
        "events",
        f"{_POSES} AND event_id % 4 <> 1",
        {
            "run": "'b'",
            "seq": "user_id % 10",
            "ts_ns": f"{{ns:ts}} + {_JITTER}",
            "event_id": "event_id",
            "tx": "cos(2e-1 * event_id + 7e-1) + 3 + 1e-2 * ((event_id % 7) - 3)"
            f" + CASE WHEN {{ns:ts}} >= {EPOCH_2024 + 12 * DAY_NS}"
            " THEN 1e-3 * (event_id % 13) ELSE 0e0 END",
            "ty": "sin(2e-1 * event_id + 7e-1) - 4 + 1e-2 * ((event_id % 3) - 1)",
            "tz": "0e0",
            "qx": "0e0",
            "qy": "0e0",
            "qz": "sin(1e-1 * event_id + 35e-2)",
            "qw": "cos(1e-1 * event_id + 35e-2)",
        },
    ),
    # Per-pose diagnostics of run a: one row in 17 is missing.
    "est_diag": (
        "events",
        f"{_POSES} AND event_id % 4 <> 1 AND event_id % 17 <> 0",
        {
            "run": "'a'",
            "seq": "user_id % 10",
            "ts_ns": f"{{ns:ts}} + {_JITTER}",
            "segment_id": f"CAST(floor(({{ns:ts}} - {EPOCH_2024}) / {10 * DAY_NS}e0) AS BIGINT)",
            "outliers_culled": "event_id % 3",
            "num_obs": "20 + event_id % 90",
        },
    ),
    "left": (
        "events",
        "event_id % 10 <> 3",
        {"seq": "user_id % 10", "ts_ns": "{ns:ts}"},
    ),
    "right": (
        "events",
        "event_id % 10 <> 7",
        {
            "seq": "user_id % 10",
            "ts_ns": "{ns:ts} + CASE WHEN event_id % 3 = 0 THEN 0"
            " ELSE (event_id % 5) * 1000000 END",
        },
    ),
    "imu": (
        "events",
        "event_type IN ('signup','purchase')",
        {
            "seq": "user_id % 10",
            "ts_ns": "{ns:ts}",
            "ax": "value / 10",
            "ay": "sin(1e0 * event_id)",
            "az": "9.81e0 + cos(1e0 * event_id) / 10",
            "wx": "sin(5e-1 * event_id)",
            "wy": "cos(5e-1 * event_id)",
            "wz": "value / 100",
        },
    ),
    "images": (
        "events",
        "event_type IN ('view','click')",
        {"seq": "user_id % 10", "ts_ns": "{ns:ts}"},
    ),
    "frames": (
        "orders",
        "",
        {
            "run": "CASE WHEN o_custkey % 2 = 0 THEN 'a' ELSE 'b' END",
            "seq": "o_orderkey % 10",
            "frame": "CAST(floor(o_orderkey / 10) AS BIGINT)",
            "ts_ns": "CAST(1403636579763555584 + CAST(floor(o_orderkey / 10) AS BIGINT) * 50000000"
            " + CAST(floor(o_orderkey / 2000) AS BIGINT) * 400000000 AS BIGINT)",
            "status": "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'rejected'"
            " ELSE 'ok' END",
            "num_obs": "o_custkey % 120",
            "num_landmarks": "o_custkey % 300",
            "num_shared": "o_custkey % 40",
            "num_disparity": "o_custkey % 60",
            "low_connectivity": "(o_custkey % 40 > 0 AND o_custkey % 40 < 10)",
            "window_size": "o_custkey % 11",
            "prior_key": "CAST(floor(o_orderkey / 100) AS BIGINT)",
            "reproj_rms_before_px": "(o_custkey % 97) / 32e0",
            "reproj_rms_after_px": "(o_custkey % 89) / 64e0",
            "num_cheirality": "o_custkey % 3",
            "lm_iterations": "o_custkey % 130",
            "max_window_pose_shift_m": "(o_custkey % 64) / 64e0",
            "segment_id": "CAST(floor(o_orderkey / 3000) AS BIGINT)",
            "pnp_success": "(o_custkey % 3 <> 0)",
            "pnp_inliers": "o_custkey % 50",
            "outliers_culled": "CASE WHEN o_custkey % 7 = 0 THEN o_custkey % 6 ELSE 0 END",
            "reproj_rms_after_cull_px": "(o_custkey % 83) / 64e0",
            "is_keyframe": "(o_custkey % 5 = 0)",
            "message": "CASE WHEN o_orderstatus = 'P' AND o_custkey % 4 = 0"
            " THEN 'insufficient observations to seed new segment'"
            " WHEN o_orderstatus = 'P' THEN 'empty observations' ELSE '' END",
            "rectify_s": "(o_custkey % 16) / 1024e0",
            "frontend_s": "(o_custkey % 32) / 1024e0",
            "estimator_s": "(o_custkey % 64) / 1024e0",
            "tx": "1e-2 * floor(o_orderkey / 10)"
            " + CASE WHEN o_orderkey % 997 = 0 THEN 8e0 ELSE 0e0 END",
            "ty": "sin(1e-2 * floor(o_orderkey / 10))",
            "tz": "cos(1e-2 * floor(o_orderkey / 10))",
            "qx": "0e0",
            "qy": "0e0",
            "qz": "sin(1e-3 * floor(o_orderkey / 10))",
            "qw": "cos(1e-3 * floor(o_orderkey / 10))",
        },
    ),
    "calibration": (
        "supplier",
        "",
        {
            "rig": "s_suppkey",
            "fx": "CASE WHEN s_suppkey % 17 = 3 THEN -1e0 ELSE 400e0 + s_nationkey END",
            "fy": "400e0 + s_nationkey",
            "cx": "320e0",
            "cy": "240e0",
            "d0": "CASE WHEN s_suppkey % 19 = 4 THEN CAST('NaN' AS DOUBLE) ELSE -1e-1 END",
            "d1": "2e-2",
            "d2": "1e-3",
            "d3": "-2e-3",
            "width": "CAST(CASE WHEN s_suppkey % 23 = 5 THEN 0 ELSE 640 END AS BIGINT)",
            "height": "CAST(480 AS BIGINT)",
            "rate_hz": "CASE WHEN s_suppkey % 29 = 6 THEN 0e0 ELSE 20e0 END",
            "accel_noise": "CASE WHEN s_suppkey % 31 = 7 THEN 0e0 ELSE 2e-3 END",
            "gyro_noise": "17e-5",
            "right_x": "CASE WHEN s_suppkey % 37 = 8 THEN 0e0 ELSE 1e-1 END",
            "rot_scale": "CASE WHEN s_suppkey % 13 = 2 THEN -1e0 ELSE 1e0 END",
            "imu_x": "CASE WHEN s_suppkey % 41 = 9 THEN 1e-3 ELSE 0e0 END",
        },
    ),
}


def ns_expression(column: str) -> str:
    """Nanoseconds of a zoneless timestamp, whatever the zone of the session."""
    moment = f"from_utc_timestamp(CAST({column} AS TIMESTAMP), current_timezone())"
    return f"(unix_micros({moment}) * 1000)"


def _ns_spark(match: re.Match[str]) -> str:
    return ns_expression(match[1])


def _ns_sql(match: re.Match[str]) -> str:
    return f"(epoch_us({match[1]}) * 1000)"


def _render(expression: str, ns) -> str:
    return re.sub(r"\{ns:(\w+)\}", ns, expression)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Spark form of a view."""
    if name in _DERIVED:
        return _DERIVED[name](spark, sf_dir)
    source, where, columns = VIEWS[name]
    df = table(spark, sf_dir, source)
    if where:
        df = df.where(where)
    return df.selectExpr(*[f"{_render(e, _ns_spark)} AS {c}" for c, e in columns.items()])


def view_sql(name: str) -> str:
    """The same view as a SELECT for the checking engine."""
    if name in _DERIVED_SQL:
        return _DERIVED_SQL[name]
    source, where, columns = VIEWS[name]
    fields = ", ".join(f"{_render(e, _ns_sql)} AS {c}" for c, e in columns.items())
    return f"SELECT {fields} FROM {source}" + (f" WHERE {where}" if where else "")


def with_views(*names: str, **extra: str) -> str:
    """``WITH`` prefix that defines the named views and further expressions."""
    parts = [f"v_{n} AS ({view_sql(n)})" for n in names]
    parts += [f"{n} AS ({q})" for n, q in extra.items()]
    return "WITH " + ", ".join(parts) + " "


_OBS = {
    "seq": "l_orderkey % 10",
    "frame": "CAST(floor(l_orderkey / 10) AS BIGINT)",
    "id": "l_partkey % 50",
    "line": "l_linenumber",
    "price": "l_extendedprice",
    "u": "l_quantity * 12",
    "v": "l_extendedprice % 480",
    "disparity": "round(l_discount * 100)",
    "epipolar": "round(l_tax * 100) / 4",
    "status": "CASE WHEN l_returnflag = 'A' THEN 'valid' WHEN l_returnflag = 'N'"
    " THEN 'no_right_match' WHEN l_linestatus = 'O' THEN 'invalid_disparity'"
    " ELSE 'depth_out_of_range' END",
}
_OBS_COLUMNS = ["u", "v", "disparity", "epipolar", "status"]
_OBS_FIELDS = ", ".join(f"{e} AS {c}" for c, e in _OBS.items())


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "lineitem").selectExpr(
        *[f"{e} AS {c}" for c, e in _OBS.items()]
    )
    best = F.min(F.struct("line", "price", *_OBS_COLUMNS)).alias("best")
    # Hardly any rows combine before a shuffle, so they move once, by frame: what follows per frame finds them there.
    return (
        raw.repartition("seq", "frame").groupBy("seq", "frame", "id")
        .agg(best)
        .select("seq", "frame", "id", *[f"best.{c}" for c in _OBS_COLUMNS])
    )


_OBS_SQL = (
    f"SELECT seq, frame, id, {', '.join(_OBS_COLUMNS)} FROM (SELECT {_OBS_FIELDS} FROM lineitem)"
    " QUALIFY row_number() OVER (PARTITION BY seq, frame, id"
    f" ORDER BY line, price, {', '.join(_OBS_COLUMNS)}) = 1"
)


#: Observations that are culled.
CULLED = "u <= 24"


def _culls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observations(spark, sf_dir).where(CULLED).select("seq", "frame", "id")


_LANDMARK_KEYS = {
    "seq": "p_partkey % 10",
    "id": "CAST(floor(p_partkey / 10) AS BIGINT) % 50",
}
_LANDMARK_AGGREGATES = {
    "x": "(min(p_size) - 10) / 8e0",
    "y": "(max(p_size) - 40) / 16e0",
    "z": "10 + sum(p_size) % 7 - CASE WHEN sum(p_size) % 11 = 0 THEN 20 ELSE 0 END + 0e0",
}


def _landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "part").selectExpr(
        "p_size", *[f"{e} AS {c}" for c, e in _LANDMARK_KEYS.items()]
    )
    return keyed.groupBy("seq", "id").agg(
        *[F.expr(f"CAST({e} AS DOUBLE)").alias(c) for c, e in _LANDMARK_AGGREGATES.items()]
    )


_LANDMARKS_SQL = (
    "SELECT seq, id, "
    + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in _LANDMARK_AGGREGATES.items())
    + " FROM (SELECT p_size, "
    + ", ".join(f"{e} AS {c}" for c, e in _LANDMARK_KEYS.items())
    + " FROM part) GROUP BY seq, id"
)

_RUN_KEYS = {
    "sequence": "concat('seq_', CAST(o_custkey % 11 AS VARCHAR(20)))",
    "commit": "concat('c', CAST(year(o_orderdate) * 100 + month(o_orderdate) AS VARCHAR(20)))",
    "config": "substr(o_orderpriority, 1, 1)",
}
_RUN_AGGREGATES = {
    "frames": "count(*)",
    "ok": "sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)",
    "failed": "sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)",
    "rejected": "sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)",
    "segments": "1 + max(o_orderkey) % 4",
    "reanchors": "max(o_orderkey) % 4",
    "cents": "CAST(max(round(o_totalprice * 100)) AS BIGINT)",
    "cents_low": "CAST(min(round(o_totalprice * 100)) AS BIGINT)",
}
_RUN_OUTPUT = {
    "sequence": "sequence",
    "commit": "commit",
    "config": "config",
    "dirty": "(cents % 5 = 0)",
    "frames": "CAST(frames AS BIGINT)",
    "ok": "CAST(ok AS BIGINT)",
    "failed": "CAST(failed AS BIGINT)",
    "rejected": "CAST(rejected AS BIGINT)",
    "segments": "CAST(segments AS BIGINT)",
    "reanchors": "CAST(reanchors AS BIGINT)",
    "ate": "CASE WHEN cents % 13 = 0 THEN NULL ELSE cents / 1e8 END",
    "rpe": "CASE WHEN cents % 17 = 0 THEN NULL ELSE cents_low / 1e9 END",
    "completion": "ok / (frames + 0e0)",
    "wall_s": "cents / 1e5",
    "warnings": "cents % 3",
}


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").selectExpr(
        *[f"{e} AS {c}" for c, e in _RUN_KEYS.items()], "o_orderkey", "o_orderstatus", "o_totalprice"
    )
    grouped = orders.groupBy(*_RUN_KEYS).agg(
        *[F.expr(e).alias(c) for c, e in _RUN_AGGREGATES.items()]
    )
    return grouped.selectExpr(*[f"{e} AS {c}" for c, e in _RUN_OUTPUT.items()])


_RUNS_SQL = (
    "SELECT "
    + ", ".join(f"{e} AS {c}" for c, e in _RUN_OUTPUT.items())
    + " FROM (SELECT "
    + ", ".join([*_RUN_KEYS, *[f"{e} AS {c}" for c, e in _RUN_AGGREGATES.items()]])
    + " FROM (SELECT "
    + ", ".join(f"{e} AS {c}" for c, e in _RUN_KEYS.items())
    + ", o_orderkey, o_orderstatus, o_totalprice FROM orders) GROUP BY sequence, commit, config)"
)

_DERIVED = {
    "obs": _observations,
    "culls": _culls,
    "landmarks": _landmarks,
    "runs": _runs,
}
_DERIVED_SQL = {
    "obs": _OBS_SQL,
    "culls": f"SELECT seq, frame, id FROM ({_OBS_SQL}) WHERE u <= 24",
    "landmarks": _LANDMARKS_SQL,
    "runs": _RUNS_SQL,
}
