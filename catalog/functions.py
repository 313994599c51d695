"""Queries on the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query, r6, s6
from posequery.fixtures import ns_expression, table, view, with_views
from posequery.functions import camera as cam
from posequery.functions import geometry as g
from posequery.functions import nested
from posequery.functions import text as tx
from posequery.sources import sensors as sn

_YAW = "2 * atan2(qz, qw)"


@query(
    "h1_quaternion",
    with_views("est")
    + "SELECT event_id, "
    + ", ".join(
        s6(e, n)
        for e, n in (
            ("1e0", "norm"),
            (f"cos({_YAW}) * tx - sin({_YAW}) * ty", "rx"),
            (f"sin({_YAW}) * tx + cos({_YAW}) * ty", "ry"),
            (f"cos(2 * {_YAW})", "m00"),
            (f"sin(2 * {_YAW})", "m10"),
        )
    )
    + ", true AS round_trip FROM v_est",
)
def quaternion(spark, sf):
    q, t = g.pose().q, g.pose().t
    rotated = g.quat_rotate(q, t)
    matrix = g.quat_to_matrix(g.quat_multiply(q, q))
    rows = view(spark, sf, "est").select(
        "event_id",
        *[c.alias(f"q{n}") for c, n in zip(q, "xyzw", strict=True)],
        r6(g.quat_norm(g.quat_normalize(q)), "norm"),
        r6(rotated.x, "rx"),
        r6(rotated.y, "ry"),
        r6(matrix[0], "m00"),
        r6(matrix[3], "m10"),
        *[c.alias(f"m{i}_") for i, c in enumerate(g.quat_to_matrix(q))],
    )
    back = g.matrix_to_quat([F.col(f"m{i}_") for i in range(9)])
    turned = rows.select("*", *[c.alias(f"b{n}") for c, n in zip(back, "xyzw", strict=True)])
    dot = sum((F.col(f"q{c}") * F.col(f"b{c}") for c in "yzw"), F.col("qx") * F.col("bx"))
    same = F.abs(F.abs(dot) - 1.0) < 1e-9
    return turned.select("event_id", "norm", "rx", "ry", "m00", "m10", same.alias("round_trip"))


@query(
    "h2_rotation_angle_deg",
    with_views("est")
    + f"SELECT event_id, {s6('degrees(2 * atan2(abs(qz), abs(qw)))', 'angle_deg')} FROM v_est",
)
def rotation_angle(spark, sf):
    angle = g.rotation_angle_deg(g.pose().q)
    return view(spark, sf, "est").select("event_id", r6(angle, "angle_deg"))


@query(
    "h3_rigid_transform",
    with_views("est")
    + "SELECT event_id, "
    + ", ".join(
        s6(e, n)
        for e, n in (
            (f"-(cos({_YAW}) * tx + sin({_YAW}) * ty)", "inv_x"),
            (f"-(-sin({_YAW}) * tx + cos({_YAW}) * ty)", "inv_y"),
            ("0e0", "identity_x"),
            (f"tx + cos({_YAW}) - 2 * sin({_YAW})", "applied_x"),
            (f"ty + sin({_YAW}) + 2 * cos({_YAW})", "applied_y"),
        )
    )
    + " FROM v_est",
)
def rigid(spark, sf):
    pose = g.pose()
    inverse = g.pose_inverse(pose)
    identity = g.pose_compose(pose, inverse)
    applied = g.pose_apply(pose, g.Vec(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    return view(spark, sf, "est").select(
        "event_id",
        r6(inverse.t.x, "inv_x"),
        r6(inverse.t.y, "inv_y"),
        r6(identity.t.x, "identity_x"),
        r6(applied.x, "applied_x"),
        r6(applied.y, "applied_y"),
    )


_LENS = {"fx": 458.654, "fy": 457.296, "cx": 367.215, "cy": 248.375}
_RADTAN = (-0.28340811, 0.07395907, 0.00019359, 1.76187114e-05)
_EQUI = (0.0034823894022493434, 0.0007150348452162257, -0.0020532361418706202, 0.00020293673591811182)
_POINT = {"x": "(event_id % 41 - 20) / 25e0", "y": "(event_id % 31 - 15) / 25e0", "z": "(event_id % 7 - 1) / 2e0 + 5e-1"}
_POINTS = "SELECT event_id, " + ", ".join(f"{e} AS {n}" for n, e in _POINT.items()) + " FROM events"


def _points(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id", *[f"{e} AS {n}" for n, e in _POINT.items()])


def _lens(distortion):
    return cam.Lens(*[F.lit(v) for v in (*_LENS.values(), *distortion)])


def _projected_sql(x: str, y: str) -> str:
    fx, fy, cx, cy = _LENS.values()
    return (
        f"SELECT event_id, {s6(f'CASE WHEN z > 0 THEN {fx}e0 * ({x}) + {cx}e0 END', 'u')},"
        f" {s6(f'CASE WHEN z > 0 THEN {fy}e0 * ({y}) + {cy}e0 END', 'v')},"
        " CASE WHEN z <= 0 THEN 'outside_domain' END AS error_code"
    )


_K1, _K2, _P1, _P2 = (f"{v:.18f}e0" for v in _RADTAN)
_NORM = f"WITH p AS ({_POINTS}), n AS (SELECT *, x / nullif(z, 0) AS a, y / nullif(z, 0) AS b FROM p), "


@query(
    "h5_project_radial_tangential",
    _NORM
    + "r AS (SELECT *, a * a + b * b AS r2 FROM n) "
    + _projected_sql(
        f"a * (1 + r2 * ({_K1} + {_K2} * r2)) + 2 * {_P1} * a * b + {_P2} * (r2 + 2 * a * a)",
        f"b * (1 + r2 * ({_K1} + {_K2} * r2)) + {_P1} * (r2 + 2 * b * b) + 2 * {_P2} * a * b",
    )
    + " FROM r",
)
def radial_tangential(spark, sf):
    point = g.vec("")
    rows = _points(spark, sf).withColumn("p", cam.project_radial_tangential(_lens(_RADTAN), point))
    return rows.select("event_id", r6("p.u"), r6("p.v"), "p.error_code")


_E = [f"{v:.18f}e0" for v in _EQUI]


@query(
    "h6_project_equidistant",
    _NORM
    + "r AS (SELECT *, sqrt(a * a + b * b) AS r, atan(sqrt(a * a + b * b)) AS t FROM n),"
    f" s AS (SELECT *, CASE WHEN r > 0 THEN t * (1 + {_E[0]} * t ** 2 + {_E[1]} * t ** 4"
    f" + {_E[2]} * t ** 6 + {_E[3]} * t ** 8) / r ELSE 1 END AS k FROM r) "
    + _projected_sql("k * a", "k * b")
    + " FROM s",
)
def equidistant(spark, sf):
    rows = _points(spark, sf).withColumn("p", cam.project_equidistant(_lens(_EQUI), g.vec("")))
    return rows.select("event_id", r6("p.u"), r6("p.v"), "p.error_code")


# The inverse has no closed form: the bearing of a projected point is the point's own.  Points
# that are not before the camera have no pixel.
@query(
    "h7_undistort",
    f"WITH p AS ({_POINTS}), b AS (SELECT *, CASE WHEN z > 0 THEN sqrt(x * x + y * y + z * z) END AS far FROM p)"
    f" SELECT event_id, model, {s6('x / far', 'bx')}, {s6('y / far', 'by')},"
    " CASE WHEN z <= 0 THEN 'non_finite_input' END AS error_code FROM b,"
    " (VALUES ('radial_tangential'), ('equidistant')) m(model)",
)
def undistort(spark, sf):
    rows = _points(spark, sf)
    parts = []
    for model, distortion, project in (
        ("radial_tangential", _RADTAN, cam.project_radial_tangential),
        ("equidistant", _EQUI, cam.project_equidistant),
    ):
        pixel = rows.withColumn("p", project(_lens(distortion), g.vec(""))).select(
            "event_id", F.lit(model).alias("model"), "p.u", "p.v"
        )
        ray = cam.undistort(_lens(distortion), F.col("u"), F.col("v"), model)
        parts.append(
            pixel.withColumn("ray", ray).select(
                "event_id", "model", r6("ray.x", "bx"), r6("ray.y", "by"), "ray.error_code"
            )
        )
    return parts[0].unionByName(parts[1])


@query(
    "h11_text",
    "SELECT event_id, epoch_us(ts) * 1000 - 1704067200000000000 * (event_id % 3) AS ts_ns,"
    " strftime(to_timestamp(epoch_us(ts) // 1000000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS iso,"
    " event_id % 4 <> 1 AND event_id % 4 <> 2 AS basename,"
    " CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat(event_type, '/', CASE WHEN event_id % 7 = 0"
    " THEN 'unknown' ELSE 'abc' END, CASE WHEN event_id % 2 = 0 THEN '_dirty' ELSE '' END, '/cfg_',"
    " event_id) END AS run_key FROM events",
)
def text(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "event_id", "event_type", f"{ns_expression('ts')} AS ns"
    )
    shifted = F.col("ns") - F.lit(1_704_067_200_000_000_000) * (F.col("event_id") % 3)
    written = rows.withColumn("text", tx.ns_to_seconds_text(F.abs(shifted))).withColumn(
        "text", F.when(shifted < 0, F.concat(F.lit("-"), "text")).otherwise(F.col("text"))
    )
    name = F.expr(
        "CASE event_id % 4 WHEN 1 THEN '../a.png' WHEN 2 THEN '' ELSE concat(event_id, '.png') END"
    )
    key = tx.run_key(
        F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("event_type")),
        F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.lit("abc")),
        F.col("event_id") % 2 == 0,
        F.lit("cfg"),
        F.col("event_id").cast("string"),
    )
    return written.select(
        "event_id",
        tx.seconds_text_to_ns(F.col("text")).alias("ts_ns"),
        tx.iso_utc(F.col("ns")).alias("iso"),
        tx.is_basename(name).alias("basename"),
        key.alias("run_key"),
    )


# Every eleventh document is cut off; a number comes as text, a label is blank in every third.
_DOCUMENT = (
    "concat('{{\"run\":', props, ',\"n\":\"', CAST(event_id AS {text}), '\",\"label\":\"',"
    " CASE WHEN event_id % 3 = 0 THEN '' ELSE 'named' END, '\"', CASE WHEN event_id % 11 = 0 THEN '' ELSE '}}' END)"
)


@query(
    "h12_json",
    f"SELECT event_id, json_valid(d) AS readable, CASE WHEN json_valid(d) THEN coalesce(CAST(d->>'$.run.k' AS BIGINT), -1) ELSE -1 END AS k,"
    " CASE WHEN json_valid(d) THEN CAST(d->>'$.n' AS DOUBLE) END AS n, CAST(NULL AS DOUBLE) AS wrong,"
    " CASE WHEN json_valid(d) AND event_id % 3 <> 0 THEN 'named' ELSE 'none' END AS label"
    f" FROM (SELECT event_id, {_DOCUMENT.format(text='VARCHAR')} AS d FROM events)",
)
def json(spark, sf):
    document = F.expr(_DOCUMENT.format(text="STRING"))
    rows = table(spark, sf, "events").select("event_id", nested.parsed(document).alias("d"))
    d = F.col("d")
    return rows.select(
        "event_id",
        nested.is_object(d).alias("readable"),
        nested.found_at(d, ["missing.k", "run.k"], "bigint", -1).alias("k"),
        nested.found_at(d, "n", "double").alias("n"),
        nested.found_at(d, "run", "double").alias("wrong"),
        nested.found_at(d, ["label", "other"], "string", "none", blank=False).alias("label"),
    )


# Configurations of neighbouring runs; a run without a label lacks the key.
_SETTINGS = {"brand": "p_brand", "size": "CAST(p_size AS {text})", "label": "CASE WHEN p_partkey % 4 <> 1 THEN p_type END"}


@query(
    "h13_config_differences",
    "WITH setting AS ("
    + " UNION ALL ".join(f"SELECT p_partkey AS run, '{k}' AS key, {v.format(text='VARCHAR')} AS value FROM part" for k, v in _SETTINGS.items())
    + ") SELECT a.run, a.key, a.value AS left_value, b.value AS right_value FROM setting a JOIN setting b"
    " ON b.run = a.run + 1 AND b.key = a.key WHERE a.value IS DISTINCT FROM b.value",
)
def config_differences(spark, sf):
    entries = [F.struct(F.lit(k).alias("key"), F.expr(v.format(text="STRING")).alias("value")) for k, v in _SETTINGS.items()]
    present = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    runs = table(spark, sf, "part").select(F.col("p_partkey").alias("run"), F.map_from_entries(present).alias("config"))
    later = runs.select((F.col("run") - 1).alias("run"), F.col("config").alias("other"))
    apart = runs.join(later, "run").select("run", F.explode(nested.differing(F.col("config"), F.col("other"))).alias("d"))
    return apart.select("run", "d.key", F.col("d.left").alias("left_value"), F.col("d.right").alias("right_value"))


@query(
    "h13_array_map",
    "SELECT l_orderkey AS frame, rank, l_partkey AS key, dt_m FROM (SELECT l_orderkey, l_partkey, CAST(l_discount AS DOUBLE) AS dt_m,"
    " row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_partkey) AS rank FROM lineitem WHERE l_linenumber <> 3) WHERE rank <= 2",
)
def largest_shifts(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_discount"))).alias("x")
    )
    shift = F.transform("x", lambda x: F.when(x["l_linenumber"] != 3, x["l_discount"].cast("double")))
    top = rows.select("l_orderkey", nested.largest_shifts(F.col("x.l_partkey"), shift, 2).alias("top"))
    ranked = top.select(F.col("l_orderkey").alias("frame"), F.posexplode("top").alias("at", "s"))
    return ranked.select("frame", (F.col("at") + 1).cast("long").alias("rank"), "s.key", "s.dt_m")


@query(
    "h15_imu_static_check",
    with_views("imu")
    + "SELECT seq, "
    + ", ".join(f"{s6(f'avg({a})', f'mean_{a}')}, {s6(f'stddev_pop({a})', f'std_{a}')}" for a in ("ax", "ay", "az"))
    + ", abs(avg(ax)) <= 0.5 AND abs(avg(ay)) <= 0.5 AND abs(avg(az) - 9.81) <= 0.5 AS still"
    " FROM v_imu GROUP BY seq",
)
def static_check(spark, sf):
    found = sn.static_check(view(spark, sf, "imu"))
    return found.select([r6(c) if c.startswith(("mean", "std")) else F.col(c) for c in found.columns])
