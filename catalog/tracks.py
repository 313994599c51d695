"""Queries on observations, tracks, landmarks and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query, r6, s6
from posequery.fixtures import table, view, view_sql, with_views
from posequery.functions import camera as cam
from posequery.functions import geometry as g
from posequery.operators import landmarks as lm
from posequery.operators import ledger as lg
from posequery.operators import tracks as tk

RIG = cam.Rig(400.0, 400.0, 320.0, 240.0, 0.1)
_LENGTH = (
    "SELECT *, row_number() OVER (PARTITION BY seq, id ORDER BY frame) AS length FROM v_obs"
)


def obs(spark, sf):
    return view(spark, sf, "obs")


def frames(spark, sf):
    return view(spark, sf, "frames")


@query(
    "b6_admit_observations",
    with_views("obs", tracked=_LENGTH)
    + "SELECT seq, frame, id, CASE WHEN status = 'valid' THEN disparity ELSE 0e0 END AS disparity"
    " FROM tracked WHERE status = 'valid' OR (status = 'no_right_match' AND length >= 2)",
)
def admit(spark, sf):
    kept = tk.admit_observations(tk.track_length(obs(spark, sf)))
    return kept.select("seq", "frame", "id", "disparity")


@query(
    "b7_classify_stereo_match",
    with_views("obs")
    + "SELECT seq, frame, id, CASE WHEN epipolar > 1.5 OR disparity <= 2 THEN 'invalid_disparity'"
    " WHEN 40 / disparity < 0.3 OR 40 / disparity > 25 THEN 'depth_out_of_range' ELSE 'valid' END"
    " AS match_status, CASE WHEN epipolar > 1.5 THEN 'epipolar' WHEN disparity <= 2 THEN 'disparity'"
    " WHEN 40 / disparity < 0.3 OR 40 / disparity > 25 THEN 'depth' END AS cause FROM v_obs",
)
def classify(spark, sf):
    judged = tk.classify_stereo_match(RIG, F.col("epipolar"), F.col("disparity"))
    rows = obs(spark, sf).withColumn("m", judged)
    return rows.select("seq", "frame", "id", F.col("m.status").alias("match_status"), "m.cause")


_GATES = (
    "SELECT *, ts_ns AS t, max(CASE WHEN status = 'ok' THEN ts_ns END) OVER (PARTITION BY seq"
    " ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_ok FROM v_frames"
)


@query(
    "b8_audit_admission_gates",
    with_views("frames", gates=_GATES)
    + "SELECT seq, frame, last_ok IS NOT NULL AS initialized, CASE WHEN num_obs = 0"
    " THEN 'empty observations' WHEN num_landmarks % 50 = 1"
    " THEN 'non-finite pixel or negative disparity'"
    " WHEN last_ok IS NOT NULL AND ts_ns <= last_ok THEN 'timestamp not strictly increasing'"
    " WHEN last_ok IS NOT NULL AND num_shared = 0 AND NOT is_keyframe"
    " THEN 'zero shared landmarks (non-keyframe)' WHEN last_ok IS NULL AND NOT is_keyframe"
    " THEN 'not initialised (non-keyframe)' WHEN NOT is_keyframe AND num_shared < 10"
    " THEN 'insufficient shared landmarks (non-keyframe)' WHEN last_ok IS NOT NULL"
    " AND num_shared = 0 AND num_disparity < 10"
    " THEN 'insufficient observations to seed new segment' WHEN last_ok IS NULL"
    " AND num_disparity < 10 THEN 'insufficient observations to seed first segment' END"
    " AS rejection FROM gates",
)
def gates(spark, sf):
    rows = frames(spark, sf).withColumn(
        "bad_obs", F.when(F.col("num_landmarks") % 50 == 1, 1).otherwise(0)
    )
    return tk.admission_gates(rows).select("seq", "frame", "initialized", "rejection")


# The first 300 frames of a sequence seed nothing here; 55 different parts do.
_SEEDING = (
    "SELECT *, max(CASE WHEN status = 'ok' AND frame >= 300 THEN ts_ns END) OVER (PARTITION BY seq"
    " ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_ok, is_keyframe AND num_obs > 0 AND num_landmarks % 50 <> 1 AS sound FROM v_frames"
)


@query(
    "b8_accumulated_seed",
    with_views("frames", seeding=_SEEDING)
    + ", turns AS (SELECT *, count(*) FILTER (last_ok IS NULL AND sound AND num_disparity >= 55) OVER"
    " (PARTITION BY seq ORDER BY frame ROWS UNBOUNDED PRECEDING) AS turn FROM seeding),"
    " poor AS (SELECT seq, frame, turn FROM turns WHERE last_ok IS NULL AND sound AND num_disparity < 55),"
    " firsts AS (SELECT p.seq, p.turn, l_partkey AS id, min(p.frame) AS frame FROM poor p JOIN lineitem ON l_orderkey % 10 = p.seq"
    " AND l_orderkey // 10 = p.frame WHERE l_discount > 0 GROUP BY ALL),"
    " known AS (SELECT p.seq, p.frame, count(f.id) AS n FROM poor p LEFT JOIN firsts f ON f.seq = p.seq AND f.turn = p.turn AND f.frame <= p.frame GROUP BY ALL)"
    " SELECT seq, frame, last_ok IS NOT NULL AS initialized, CASE WHEN num_obs = 0"
    " THEN 'empty observations' WHEN num_landmarks % 50 = 1 THEN 'non-finite pixel or negative disparity'"
    " WHEN last_ok IS NOT NULL AND ts_ns <= last_ok THEN 'timestamp not strictly increasing'"
    " WHEN last_ok IS NOT NULL AND num_shared = 0 AND NOT is_keyframe"
    " THEN 'zero shared landmarks (non-keyframe)' WHEN last_ok IS NULL AND NOT is_keyframe"
    " THEN 'not initialised (non-keyframe)' WHEN NOT is_keyframe AND num_shared < 10"
    " THEN 'insufficient shared landmarks (non-keyframe)' WHEN last_ok IS NOT NULL"
    " AND num_shared = 0 AND num_disparity < 55 THEN 'insufficient observations to seed new segment'"
    " WHEN n < 55 THEN 'accumulating seed observations (first segment)' END AS rejection FROM turns LEFT JOIN known USING (seq, frame)",
)
def accumulated_seed(spark, sf):
    rows = frames(spark, sf).withColumns({
        "bad_obs": F.when(F.col("num_landmarks") % 50 == 1, 1).otherwise(0),
        "status": F.when(F.col("frame") >= 300, F.col("status")).otherwise("rejected"),
    })
    seen = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 10).alias("seq"), F.floor(F.col("l_orderkey") / 10).alias("frame"), F.col("l_partkey").alias("id"), F.col("l_discount").alias("disparity")
    )
    return tk.admission_gates(rows, min_seed=55, seed_obs=seen).select("seq", "frame", "initialized", "rejection")


@query(
    "b9_low_connectivity",
    with_views("frames")
    + "SELECT seq, frame, (segment_id > 0 AND num_shared > 0 AND num_shared < 10) AS low FROM v_frames",
)
def low_connectivity(spark, sf):
    low = tk.low_connectivity(F.col("num_shared"), F.col("segment_id") > 0)
    return frames(spark, sf).select("seq", "frame", low.alias("low"))


@query(
    "b11_heavy_frames",
    with_views("frames")
    + "SELECT seq, frame FROM v_frames WHERE frame BETWEEN 420 AND 450 OR outliers_culled > 0"
    " OR lm_iterations >= 100 OR max_window_pose_shift_m > 0.5",
)
def heavy(spark, sf):
    return tk.heavy_frames(frames(spark, sf), 420, 450).select("seq", "frame")


@query(
    "c9_shared_landmarks",
    with_views("obs", "landmarks")
    + "SELECT o.seq, o.frame, count(*) FILTER (disparity > 0) AS num_disparity,"
    " count(*) FILTER (disparity > 0 AND l.id IS NOT NULL) AS num_shared FROM v_obs o"
    " LEFT JOIN v_landmarks l ON o.seq = l.seq AND o.id = l.id GROUP BY o.seq, o.frame",
)
def shared(spark, sf):
    return tk.shared_landmarks(obs(spark, sf), view(spark, sf, "landmarks"))


_FIRST_CULL = "SELECT seq, id, min(frame) AS first_cull FROM v_culls GROUP BY seq, id"


@query("g4_first_culled", with_views("culls") + _FIRST_CULL)
def first_culled(spark, sf):
    return tk.first_culled(view(spark, sf, "culls"))


@query(
    "c10_zombie_tracks",
    with_views("obs", "culls", fc=_FIRST_CULL)
    + "SELECT o.seq, o.frame, o.id, first_cull FROM v_obs o JOIN fc USING (seq, id)"
    " WHERE o.frame > first_cull",
)
def zombies(spark, sf):
    return tk.zombie_tracks(obs(spark, sf), view(spark, sf, "culls"))


@query(
    "c11_block_rebirth",
    with_views("obs", "culls")
    + "SELECT seq, frame, id FROM v_obs o WHERE NOT EXISTS (SELECT 1 FROM v_culls c"
    " WHERE c.seq = o.seq AND c.id = o.id AND c.frame < o.frame)",
)
def rebirth(spark, sf):
    rows = obs(spark, sf).select("seq", "frame", "id")
    return tk.block_rebirth(rows, view(spark, sf, "culls"))


_RESIDUALS = (
    "SELECT seq, frame, id, u, v, disparity, cz AS depth,"
    " CASE WHEN cz <= 0 THEN 800e0 ELSE 400 * cx / cz + 320 - u END AS r_left,"
    " CASE WHEN cz <= 0 THEN 800e0 ELSE 400 * cx / cz + 320 - 40 / cz - (u - disparity) END AS r_right,"
    " CASE WHEN cz <= 0 THEN 800e0 ELSE 400 * cy / cz + 240 - v END AS r_v FROM (SELECT o.*,"
    " cos(2 * atan2(f.qz, f.qw)) * (l.x - f.tx) + sin(2 * atan2(f.qz, f.qw)) * (l.y - f.ty) AS cx,"
    " -sin(2 * atan2(f.qz, f.qw)) * (l.x - f.tx) + cos(2 * atan2(f.qz, f.qw)) * (l.y - f.ty) AS cy,"
    " l.z - f.tz AS cz FROM v_obs o JOIN v_frames f USING (seq, frame)"
    " JOIN v_landmarks l ON o.seq = l.seq AND o.id = l.id)"
)
_NORM = "sqrt(r_left * r_left + r_right * r_right + r_v * r_v)"
_RES_VIEWS = with_views("obs", "frames", "landmarks", res=_RESIDUALS)


def residuals(spark, sf):
    return lm.reproject(obs(spark, sf), frames(spark, sf), view(spark, sf, "landmarks"), RIG)


@query(
    "c13_reproject_join",
    _RES_VIEWS
    + f"SELECT seq, frame, id, {s6('depth')}, {s6('r_left')}, {s6('r_right')}, {s6('r_v')} FROM res",
)
def reproject(spark, sf):
    return residuals(spark, sf).select(
        "seq", "frame", "id", *[r6(c) for c in ("depth", "r_left", "r_right", "r_v")]
    )


@query(
    "d14_reprojection_rms",
    _RES_VIEWS
    + f"SELECT seq, frame, count(*) AS factors, {s6(f'sqrt(avg({_NORM} * {_NORM}))', 'rms_px')}"
    " FROM res WHERE disparity > 0 GROUP BY seq, frame",
)
def reprojection_rms(spark, sf):
    found = lm.reprojection_rms(residuals(spark, sf), ["seq", "frame"])
    return found.select("seq", "frame", "factors", r6("rms_px"))


@query(
    "d14_reprojection_rms_kept",
    with_views("obs", "frames", "landmarks", "culls", res=_RESIDUALS)
    + f"SELECT seq, count(*) AS factors, {s6(f'sqrt(avg({_NORM} * {_NORM}))', 'rms_px')}"
    " FROM res WHERE disparity > 0 AND id % 3 <> 0 GROUP BY seq",
)
def reprojection_rms_kept(spark, sf):
    kept = view(spark, sf, "landmarks").where("id % 3 <> 0")
    found = lm.reprojection_rms(residuals(spark, sf), ["seq"], kept)
    return found.select("seq", "factors", r6("rms_px"))


@query(
    "d15_landmark_residual_cull",
    _RES_VIEWS
    + f"SELECT seq, id, count(*) AS factors, {s6(f'avg({_NORM})', 'mean_px')},"
    " bool_or(depth <= 0) AS behind, CASE WHEN bool_or(depth <= 0) THEN 'cheirality'"
    f" WHEN count(*) >= 4 AND avg({_NORM}) > 300 THEN 'mean_residual' ELSE 'keep' END AS verdict"
    " FROM res WHERE disparity > 0 GROUP BY seq, id",
)
def cull(spark, sf):
    # The synthetic pixels are far from the projections; the limit is set to split them.
    found = lm.cull_landmarks(residuals(spark, sf), max_mean_px=300.0)
    return found.withColumn("mean_px", r6("mean_px"))


@query(
    "d15_behind_camera_counts",
    _RES_VIEWS
    + "SELECT seq, frame, count(*) FILTER (disparity > 0 AND depth <= 0) AS behind_factors"
    " FROM res GROUP BY seq, frame",
)
def behind(spark, sf):
    return lm.behind_camera_counts(residuals(spark, sf))


@query(
    "d16_residual_probe",
    _RES_VIEWS
    + f"SELECT seq, {s6('avg(m)', 'res_mean_px')}, {s6('max(m)', 'res_max_px')},"
    " first(id ORDER BY round(m, 9) DESC, id) AS res_max_id FROM (SELECT seq, id,"
    f" avg({_NORM}) AS m FROM res WHERE disparity > 0 GROUP BY seq, id) GROUP BY seq",
)
def probe(spark, sf):
    found = lm.residual_probe(residuals(spark, sf))
    return found.select("seq", r6("res_mean_px"), r6("res_max_px"), "res_max_id")


@query(
    "h9_candidate_arbitration",
    with_views(
        "obs",
        "frames",
        "landmarks",
        res=_RESIDUALS,
        shifted=_RESIDUALS.replace("f.tx", "(f.tx + 5e-1)"),
    )
    + f"SELECT p.seq, p.frame, {s6('p.rms', 'proposal_px')}, {s6('q.rms', 'guess_px')},"
    " (p.rms IS NOT NULL AND (q.rms IS NULL OR p.rms <= q.rms + 1)) AS accepted FROM"
    + " JOIN ".join(
        f" (SELECT seq, frame, CASE WHEN NOT bool_or(disparity > 0 AND depth <= 0) THEN"
        f" sqrt(sum(CASE WHEN disparity > 0 THEN {_NORM} * {_NORM} ELSE 0 END) / count(*)) END"
        f" AS rms FROM {source} GROUP BY seq, frame) {alias}"
        for source, alias in (("shifted", "p"), ("res", "q"))
    )
    + " USING (seq, frame)",
)
def arbitration(spark, sf):
    proposed = frames(spark, sf).withColumn("tx", F.col("tx") + 0.5)
    points = view(spark, sf, "landmarks")
    proposal = lm.pose_rms(lm.reproject(obs(spark, sf), proposed, points, RIG))
    guess = lm.pose_rms(residuals(spark, sf))
    found = lm.arbitrate(proposal, guess)
    return found.select("seq", "frame", r6("proposal_px"), r6("guess_px"), "accepted")


_LINKS = (
    "SELECT *, max(CASE WHEN is_keyframe AND status = 'ok' THEN frame END) OVER (PARTITION BY seq"
    " ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kf_frame FROM v_frames"
)
_SNAPSHOT = (
    "SELECT c.seq, c.frame, c.id, l.kf_frame, c.u, c.v, k.u AS kf_u, k.v AS kf_v,"
    " 2 * atan2(l.qz, l.qw) AS yaw, 2 * atan2(f.qz, f.qw) AS kf_yaw FROM v_obs c"
    " JOIN links l ON c.seq = l.seq AND c.frame = l.frame"
    " JOIN v_obs k ON k.seq = c.seq AND k.frame = l.kf_frame AND k.id = c.id"
    " JOIN v_frames f ON f.seq = c.seq AND f.frame = l.kf_frame"
)
_SNAP_VIEWS = with_views("obs", "frames", links=_LINKS, snap=_SNAPSHOT)


def links(spark, sf):
    return tk.keyframe_links(frames(spark, sf))


@query("c14_keyframe_snapshot_join", _SNAP_VIEWS + "SELECT seq, frame, id, kf_frame, u, v, kf_u, kf_v FROM snap")
def snapshot(spark, sf):
    found = tk.keyframe_snapshot(obs(spark, sf), links(spark, sf).select("seq", "frame", "kf_frame"))
    return found.select("seq", "frame", "id", "kf_frame", "u", "v", "kf_u", "kf_v")


@query(
    "e9_survival_ratio",
    with_views("obs", "frames", links=_LINKS, snap=_SNAPSHOT)
    + "SELECT l.seq, l.frame, l.kf_frame, coalesce(c.n, 0) AS common,"
    f" {s6('coalesce(c.n, 0) / CAST(greatest(coalesce(s.n, 0), 1) AS DOUBLE)', 'survival')}"
    " FROM links l LEFT JOIN (SELECT seq, frame, count(*) AS n FROM snap GROUP BY seq, frame) c"
    " USING (seq, frame) LEFT JOIN (SELECT seq, frame AS kf_frame, count(*) AS n FROM v_obs"
    " GROUP BY seq, frame) s ON s.seq = l.seq AND s.kf_frame = l.kf_frame"
    " WHERE l.kf_frame IS NOT NULL",
)
def survival(spark, sf):
    found = tk.survival_ratio(obs(spark, sf), links(spark, sf))
    return found.withColumn("survival", r6("survival"))


@query(
    "h10_compensated_parallax",
    _SNAP_VIEWS
    + ", p AS (SELECT *, cos(kf_yaw - yaw) * (kf_u - 320) / 400 - sin(kf_yaw - yaw) * (kf_v - 240) / 400"
    " AS x, sin(kf_yaw - yaw) * (kf_u - 320) / 400 + cos(kf_yaw - yaw) * (kf_v - 240) / 400 AS y"
    " FROM snap) SELECT seq, frame, count(*) AS rays,"
    f" {s6('avg(sqrt(power(u - x * 400 - 320, 2) + power(v - y * 400 - 240, 2)))', 'parallax_px')}"
    " FROM p GROUP BY seq, frame",
)
def parallax(spark, sf):
    rows = frames(spark, sf)
    turned = links(spark, sf).select(
        "seq", "frame", "kf_frame", *[F.col(f"q{c}").alias(f"rot_{c}") for c in "xyzw"]
    )
    past = rows.select(
        "seq",
        F.col("frame").alias("kf_frame"),
        *[F.col(f"q{c}").alias(f"kf_rot_{c}") for c in "xyzw"],
    )
    snap = tk.keyframe_snapshot(obs(spark, sf), turned).join(past, ["seq", "kf_frame"])
    return lm.compensated_parallax(snap, RIG).withColumn("parallax_px", r6("parallax_px"))


@query(
    "d7_track_lifetable",
    with_views("obs")
    + "SELECT seq, id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS length"
    " FROM v_obs GROUP BY seq, id",
)
def lifetable(spark, sf):
    return tk.track_lifetable(obs(spark, sf))


_FRAME_STATS = (
    "SELECT seq, frame, count(*) AS tracks, "
    + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in tk.STATUSES)
    + ", quantile_cont(epipolar, 0.5) AS epipolar_median_px,"
    " quantile_cont(epipolar, 0.95) AS epipolar_p95_px,"
    " list_sort(list(length))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS track_length_median,"
    " max(length) AS track_length_max FROM tracked GROUP BY seq, frame"
)


@query(
    "d8_frame_stats",
    with_views("obs", tracked=_LENGTH, stats=_FRAME_STATS)
    + "SELECT * EXCLUDE (epipolar_median_px, epipolar_p95_px),"
    f" {s6('epipolar_median_px')}, {s6('epipolar_p95_px')} FROM stats",
)
def frame_stats(spark, sf):
    found = tk.frame_stats(tk.track_length(obs(spark, sf)))
    return found.withColumn("epipolar_median_px", r6("epipolar_median_px")).withColumn(
        "epipolar_p95_px", r6("epipolar_p95_px")
    ).withColumn("track_length_median", F.col("track_length_median").cast("long"))


@query(
    "d10_frontend_totals",
    with_views("obs", tracked=_LENGTH, stats=_FRAME_STATS)
    + "SELECT seq, count(*) AS frames, min(tracks) AS min_tracks,"
    f" {s6('sum(tracks) / CAST(count(*) AS DOUBLE)', 'mean_tracks')}, "
    + ", ".join(s6(f"sum({s}) / CAST(sum(tracks) AS DOUBLE)", f"{s}_rate") for s in tk.STATUSES)
    + ", CAST(sum(tracks) AS BIGINT) AS observations,"
    f" {s6('quantile_cont(epipolar_median_px, 0.5)', 'epipolar_median_px')},"
    f" {s6('quantile_cont(epipolar_p95_px, 0.95)', 'epipolar_p95_px')} FROM stats GROUP BY seq",
)
def frontend_totals(spark, sf):
    from posequery.session import cut

    per_frame = cut(tk.frame_stats(tk.track_length(obs(spark, sf))), "frames")
    found = tk.frontend_totals(per_frame)
    doubles = [n for n, t in found.dtypes if t == "double"]
    return found.select([r6(c) if c in doubles else F.col(c) for c in found.columns])


@query(
    "d29_distinct_culled",
    with_views("culls")
    + "SELECT seq, count(*) AS culled, count(DISTINCT id) AS culled_unique FROM v_culls GROUP BY seq",
)
def distinct_culled(spark, sf):
    return tk.distinct_culled(view(spark, sf, "culls"))


_COMPOSE = ("SELECT seq, frame, tx, ty, tz, 2 * atan2(qz, qw) AS yaw, {lags} FROM v_frames"
            " WHERE status = 'ok' WINDOW w AS (PARTITION BY seq ORDER BY frame)")
_PREDICT = _COMPOSE.format(
    lags=", ".join(
        f"lag({e}, {k}) OVER w AS {n}{k}"
        for k in (1, 2)
        for e, n in (("tx", "x"), ("ty", "y"), ("tz", "z"), ("2 * atan2(qz, qw)", "a"))
    )
)


@query(
    "e1_constant_velocity",
    with_views("frames", p=_PREDICT)
    + "SELECT seq, frame, "
    + ", ".join(
        s6(f"CASE WHEN x1 IS NULL THEN 0e0 WHEN x2 IS NULL THEN {held} ELSE {moved} END", name)
        for name, held, moved in (
            ("tx", "x1", "x1 + cos(a1 - a2) * (x1 - x2) - sin(a1 - a2) * (y1 - y2)"),
            ("ty", "y1", "y1 + sin(a1 - a2) * (x1 - x2) + cos(a1 - a2) * (y1 - y2)"),
            ("tz", "z1", "z1 + z1 - z2"),
            ("cos_yaw", "cos(a1)", "cos(a1 + a1 - a2)"),
        )
    ).replace("THEN 0e0 WHEN x2 IS NULL THEN cos(a1)", "THEN 1e0 WHEN x2 IS NULL THEN cos(a1)")
    + " FROM p",
)
def constant_velocity(spark, sf):
    found = lm.predicted_pose(frames(spark, sf))
    yaw = 1.0 - 2.0 * (F.col("qz") * F.col("qz") + F.col("qy") * F.col("qy"))
    return found.select("seq", "frame", r6("tx"), r6("ty"), r6("tz"), r6(yaw, "cos_yaw"))


_HANGING = (
    "SELECT o.seq, o.id, o.frame, o.disparity, f.tx, f.ty, f.tz, max(CASE WHEN disparity > 0"
    " THEN o.frame END) OVER (PARTITION BY o.seq, o.id ORDER BY o.frame ROWS BETWEEN"
    " UNBOUNDED PRECEDING AND 1 PRECEDING) AS at FROM v_obs o JOIN v_frames f USING (seq, frame)"
)


@query(
    "e2_hanging_gate",
    with_views("obs", "frames", hanging=_HANGING)
    + "SELECT seq, id, frame, round(d, 6) + 0e0 AS moved_m, coalesce(d > 1, true) AS stale FROM"
    " (SELECT h.seq, h.id, h.frame, sqrt(power(f.tx - h.tx, 2) + power(f.ty - h.ty, 2)"
    " + power(f.tz - h.tz, 2)) AS d FROM hanging h LEFT JOIN v_frames f ON f.seq = h.seq"
    " AND f.frame = h.at WHERE h.disparity <= 0)",
)
def hanging(spark, sf):
    found = lm.hanging_gate(obs(spark, sf), frames(spark, sf))
    return found.withColumn("moved_m", r6("moved_m"))


@query(
    "e3_window_support",
    with_views("obs")
    + "SELECT seq, id, frame, support, support >= 2 AS live FROM (SELECT seq, id, frame,"
    " count(*) OVER (PARTITION BY seq, id ORDER BY frame RANGE BETWEEN 9 PRECEDING AND CURRENT ROW)"
    " AS support FROM v_obs WHERE disparity > 0)",
)
def window_support(spark, sf):
    return tk.window_support(obs(spark, sf))


def solutions(spark, sf):
    return obs(spark, sf).selectExpr(
        "seq", "frame AS solution", "id AS member", "u / 100 AS tx", "v / 100 AS ty", "disparity AS tz"
    )


_SHIFTS = (
    "SELECT seq, frame AS solution, id AS member, sqrt(power(u / 100 - lag(u / 100) OVER w, 2)"
    " + power(v / 100 - lag(v / 100) OVER w, 2) + power(disparity - lag(disparity) OVER w, 2))"
    " AS shift_m FROM v_obs WINDOW w AS (PARTITION BY seq, id ORDER BY frame)"
)


@query(
    "e4_window_pose_shift",
    with_views("obs", shifts=_SHIFTS)
    + f"SELECT seq, solution, {s6('max(shift_m)', 'max_shift_m')} FROM shifts"
    " WHERE shift_m IS NOT NULL GROUP BY seq, solution",
)
def pose_shift(spark, sf):
    found = lm.window_shift(lm.pose_shifts(solutions(spark, sf)))
    return found.withColumn("max_shift_m", r6("max_shift_m"))


@query(
    "f3_topk_shift",
    with_views("obs", shifts=_SHIFTS)
    + f"SELECT seq, solution, rank, member, {s6('shift_m')} FROM (SELECT *, row_number() OVER"
    " (PARTITION BY seq, solution ORDER BY shift_m DESC, member) AS rank FROM shifts"
    " WHERE shift_m IS NOT NULL) WHERE rank <= 3",
)
def topk_shift(spark, sf):
    found = lm.top_shifts(lm.pose_shifts(solutions(spark, sf)))
    return found.withColumn("shift_m", r6("shift_m"))


_FLOW = (
    "SELECT seq, frame, u - lag(u) OVER w AS du, v - lag(v) OVER w AS dv, frame - lag(frame) OVER w"
    " AS step FROM v_obs WINDOW w AS (PARTITION BY seq, id ORDER BY frame)"
)


@query(
    "e5_median_flow",
    with_views("obs", flow=_FLOW)
    + "SELECT seq, frame, count(*) AS survivors, "
    + ", ".join(
        s6(
            f"CASE WHEN count(*) >= 2 THEN list_sort(list({d}))[CAST(floor(count(*) / 2) AS BIGINT)"
            " + 1] END",
            n,
        )
        for d, n in (("du", "flow_u"), ("dv", "flow_v"))
    )
    + " FROM flow WHERE step = 1 GROUP BY seq, frame",
)
def flow(spark, sf):
    # Few ids last from one synthetic frame to the next, so two are enough here.
    found = tk.median_flow(obs(spark, sf), min_tracks=2)
    return found.withColumn("flow_u", r6("flow_u")).withColumn("flow_v", r6("flow_v"))


@query("e7_track_length", with_views("obs", tracked=_LENGTH) + "SELECT seq, frame, id, length FROM tracked")
def length(spark, sf):
    return tk.track_length(obs(spark, sf)).select("seq", "frame", "id", "length")


MAX_AGE = 3
_AGES = (
    "SELECT o.seq, o.id, o.frame, (c.id IS NOT NULL) AS mark,"
    " o.frame - row_number() OVER (PARTITION BY o.seq, o.id ORDER BY o.frame) AS island FROM v_obs o"
    " LEFT JOIN v_culls c ON c.seq = o.seq AND c.id = o.id AND c.frame = o.frame"
)
_AGED = (
    "SELECT seq, id, frame, frame - first_mark + 1 AS age FROM (SELECT *, min(CASE WHEN mark"
    " THEN frame END) OVER (PARTITION BY seq, id, island) AS first_mark FROM present)"
    f" WHERE first_mark IS NOT NULL AND frame BETWEEN first_mark AND first_mark + {MAX_AGE - 1}"
)


@query(
    "e8_presence_age",
    with_views("obs", "culls", present=_AGES, aged=_AGED)
    + f"SELECT seq, id, frame, age, age >= {MAX_AGE} AS dropped FROM aged",
)
def presence_age(spark, sf):
    return tk.presence_age(obs(spark, sf), view(spark, sf, "culls"), MAX_AGE)


@query(
    "i4_zombie_age",
    with_views("obs", "culls", present=_AGES, aged=_AGED)
    + "SELECT seq, count(DISTINCT frame) AS zombie_age_drops, count(*) AS zombie_age_drop_ids"
    f" FROM aged WHERE age = {MAX_AGE} - 1 GROUP BY seq",
)
def zombie_age(spark, sf):
    ages = tk.presence_age(obs(spark, sf), view(spark, sf, "culls"), MAX_AGE - 1)
    return tk.zombie_age_counts(ages)


@query(
    "f2_limit_frames",
    with_views("frames")
    + "SELECT seq, ts_ns, frame FROM v_frames QUALIFY row_number() OVER"
    " (PARTITION BY seq ORDER BY ts_ns) <= 25",
)
def limit_frames(spark, sf):
    return lg.limit_frames(frames(spark, sf).select("seq", "ts_ns", "frame"), 25)


@query(
    "f4_defer_topk",
    with_views("culls")
    + "SELECT seq, frame, id, row_number() OVER (PARTITION BY seq, frame ORDER BY id) AS rank"
    " FROM v_culls QUALIFY rank <= 1",
)
def defer_topk(spark, sf):
    return tk.smallest_ids(view(spark, sf, "culls"), 1).withColumn("rank", F.col("rank").cast("long"))


@query(
    "f5_evict_lowest_ids",
    with_views("obs")
    + "SELECT seq, frame, id, row_number() OVER (PARTITION BY seq, frame ORDER BY id) AS rank FROM"
    " (SELECT *, count(*) OVER w AS total, count(*) FILTER (status = 'valid') OVER w AS fixed"
    " FROM v_obs WINDOW w AS (PARTITION BY seq, frame)) WHERE status <> 'valid'"
    " AND 3 - fixed > 0 QUALIFY rank <= total - fixed",
)
def evict(spark, sf):
    tracks = obs(spark, sf).select("seq", "frame", "id", (F.col("status") != "valid").alias("evictable"))
    found = tk.evict_lowest_ids(tracks, 3)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(
    "f7_longest_tracks_first",
    with_views("obs") + "SELECT seq, id, count(*) AS length FROM v_obs GROUP BY seq, id",
)
def longest(spark, sf):
    ordered = tk.longest_tracks_first(tk.track_lifetable(obs(spark, sf)))
    return ordered.select("seq", "id", "length")


@query(
    "h4_rectified_stereo",
    with_views("obs", "frames")
    + "SELECT o.seq, o.frame, o.id, "
    + ", ".join(
        s6(e, n)
        for e, n in (
            ("u - disparity", "u_right"),
            ("40 / disparity", "depth"),
            (
                "tx + cos(2 * atan2(qz, qw)) * (u - 320) * 40 / disparity / 400"
                " - sin(2 * atan2(qz, qw)) * (v - 240) * 40 / disparity / 400",
                "x",
            ),
            (
                "ty + sin(2 * atan2(qz, qw)) * (u - 320) * 40 / disparity / 400"
                " + cos(2 * atan2(qz, qw)) * (v - 240) * 40 / disparity / 400",
                "y",
            ),
            ("tz + 40 / disparity", "z"),
        )
    )
    + " FROM v_obs o JOIN v_frames f USING (seq, frame) WHERE disparity > 0",
)
def rectified_stereo(spark, sf):
    rows = obs(spark, sf).where("disparity > 0").join(
        frames(spark, sf).select("seq", "frame", *g.POSE_COLUMNS), ["seq", "frame"]
    )
    u, v, d = F.col("u"), F.col("v"), F.col("disparity")
    world = cam.back_project_world(RIG, g.pose(), u, v, d)
    return rows.select(
        "seq",
        "frame",
        "id",
        r6(cam.right_pixel(u, d), "u_right"),
        r6(cam.stereo_depth(RIG, d), "depth"),
        *[r6(c, n) for c, n in zip(world, "xyz", strict=True)],
    )


_FAR = (
    "SELECT o.seq, o.frame, o.id, o.u, o.v, o.disparity, l.x, l.y, l.z, f.tx, f.ty, f.tz,"
    " 2 * atan2(f.qz, f.qw) AS a, cos(2 * atan2(f.qz, f.qw)) * (l.x - f.tx)"
    " + sin(2 * atan2(f.qz, f.qw)) * (l.y - f.ty) AS cx, -sin(2 * atan2(f.qz, f.qw)) * (l.x - f.tx)"
    " + cos(2 * atan2(f.qz, f.qw)) * (l.y - f.ty) AS cy, l.z - f.tz AS cz FROM v_obs o"
    " JOIN v_frames f USING (seq, frame) JOIN v_landmarks l ON o.seq = l.seq AND o.id = l.id"
    " WHERE disparity > 0"
)
_FAR_ERROR = (
    "SELECT *, CASE WHEN cz > 0 THEN sqrt(power(400 * cx / cz + 320 - u, 2)"
    " + power(400 * cy / cz + 240 - v, 2)) END AS e FROM far"
)


@query(
    "h8_far_return",
    with_views("obs", "frames", "landmarks", far=_FAR, judged=_FAR_ERROR)
    + f"SELECT seq, frame, id, {s6('e', 'error_px')}, (e IS NULL OR e > 300) AS refresh,"
    + ", ".join(
        s6(f"CASE WHEN e IS NULL OR e > 300 THEN {fresh} ELSE {n} END", n)
        for n, fresh in (
            ("x", "tx + (cos(a) * (u - 320) - sin(a) * (v - 240)) / 10 / disparity"),
            ("y", "ty + (sin(a) * (u - 320) + cos(a) * (v - 240)) / 10 / disparity"),
            ("z", "tz + 40 / disparity"),
        )
    )
    + " FROM judged",
)
def far_return(spark, sf):
    found = lm.far_return(
        obs(spark, sf), frames(spark, sf), view(spark, sf, "landmarks"), RIG, max_error_px=300.0
    )
    return found.select(
        "seq", "frame", "id", r6("error_px"), "refresh", *[r6(c) for c in "xyz"]
    )


_COUNTED = (
    "SELECT seq, segment_id, frame, is_keyframe,"
    " count(*) FILTER (is_keyframe) OVER w AS nk, count(*) FILTER (NOT is_keyframe) OVER w AS no"
    " FROM v_frames WHERE status = 'ok' WINDOW w AS (PARTITION BY seq, segment_id ORDER BY frame)"
)


@query(
    "i5_window_eviction",
    with_views("frames", counted=_COUNTED)
    + "SELECT f.seq, f.segment_id, f.frame, m.frame AS member_frame, m.is_keyframe FROM counted f"
    " JOIN counted m ON f.seq = m.seq AND f.segment_id = m.segment_id AND m.frame <= f.frame"
    " AND ((m.is_keyframe AND f.nk - m.nk < 7) OR (NOT m.is_keyframe"
    " AND f.no - m.no < 10 - least(f.nk, 7)))",
)
def window_eviction(spark, sf):
    return tk.window_members(frames(spark, sf).where("status = 'ok'"))


@query(
    "i6_skip_drop_policy",
    with_views("culls")
    + "SELECT seq, frame, id, CASE WHEN n < 2 THEN 'drop' WHEN rank <= 1 THEN 'defer' ELSE 'skip' END"
    " AS action FROM (SELECT *, count(*) OVER (PARTITION BY seq, frame) AS n, row_number() OVER"
    " (PARTITION BY seq, frame ORDER BY id) AS rank FROM v_culls)",
)
def skip_drop(spark, sf):
    return tk.skip_drop(view(spark, sf, "culls"), min_culled=2, defer_topk=1)


EVICTABLE = (
    "SELECT seq, frame, id, coalesce(marked >= run, false) AS evictable FROM (SELECT *, max(CASE WHEN before IS NULL OR before < frame - 1 THEN frame END)"
    " OVER (PARTITION BY seq, id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT o.seq, o.frame, o.id, lag(o.frame) OVER w AS before,"
    " max(c.frame) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS marked FROM v_obs o LEFT JOIN"
    " (SELECT * FROM v_culls QUALIFY count(*) OVER (PARTITION BY seq, frame) >= 2) c ON c.seq = o.seq AND c.frame = o.frame AND c.id = o.id"
    " WINDOW w AS (PARTITION BY o.seq, o.id ORDER BY o.frame)))"
)


@query("i6_evictable_tracks", with_views("obs", "culls") + EVICTABLE)
def evictable_tracks(spark, sf):
    return tk.mark_evictable(obs(spark, sf), view(spark, sf, "culls"), min_culled=2)


@query(
    "f5_evict_marked_tracks",
    with_views("obs", "culls", tracks=EVICTABLE)
    + "SELECT seq, frame, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY seq, frame ORDER BY evictable DESC, id) AS rank,"
    " count(*) OVER (PARTITION BY seq, frame) AS total, count(*) FILTER (NOT evictable) OVER (PARTITION BY seq, frame) AS fixed FROM tracks)"
    " WHERE evictable AND rank <= CASE WHEN fixed < 3 THEN total - fixed ELSE 0 END",
)
def evict_marked(spark, sf):
    found = tk.evict_lowest_ids(tk.mark_evictable(obs(spark, sf), view(spark, sf, "culls"), min_culled=2), 3)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(
    "d10_detector_totals",
    "SELECT o_orderkey % 10 AS seq, count(*) AS frames, CAST(sum(o_custkey % 60) AS BIGINT) AS tracked, CAST(sum(o_orderkey % 40) AS BIGINT) AS detected,"
    " CAST(sum(o_custkey % 9) AS BIGINT) AS fb_rejected, sum(o_custkey % 9) / CAST(sum(o_custkey % 60 + o_custkey % 9) AS DOUBLE) AS rejected_share,"
    " sum(o_orderkey % 40) / CAST(sum(o_custkey % 60 + o_orderkey % 40) AS DOUBLE) AS new_share FROM orders GROUP BY ALL",
)
def detector_totals(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey % 10 AS seq", "o_custkey % 60 AS tracked", "o_orderkey % 40 AS detected", "o_custkey % 9 AS fb_rejected"
    )
    return tk.detector_totals(rows)


@query(
    "i6_skip_drop_counts",
    with_views("culls")
    + "SELECT seq, count(*) FILTER (n >= 2) AS drops_skipped, count(*) FILTER (n >= 2) AS deferred_drops,"
    " count(*) FILTER (n >= 2) AS deferred_drop_ids FROM (SELECT seq, frame, count(*) AS n FROM v_culls"
    " GROUP BY seq, frame) GROUP BY seq",
)
def skip_drop_counts(spark, sf):
    actions = tk.skip_drop(view(spark, sf, "culls"), min_culled=2, defer_topk=1)
    return tk.skip_drop_counts(actions)


@query(
    "i9_accumulate_seed",
    with_views("obs")
    + ", firsts AS (SELECT seq, id, min(frame) AS first FROM v_obs WHERE disparity > 0 GROUP BY seq, id),"
    " seeds AS (SELECT seq, first AS seed_frame FROM firsts QUALIFY row_number() OVER"
    " (PARTITION BY seq ORDER BY first, id) = 10)"
    " SELECT o.seq, s.seed_frame, o.id, max(o.frame) AS frame, arg_max(o.u, o.frame) AS u"
    " FROM v_obs o JOIN seeds s ON o.seq = s.seq AND o.frame <= s.seed_frame WHERE o.disparity > 0"
    " GROUP BY o.seq, s.seed_frame, o.id",
)
def accumulate(spark, sf):
    return tk.accumulate_seed(obs(spark, sf)).select("seq", "seed_frame", "id", "frame", "u")


# With the survival and parallax rules out of play the choice can be followed row by row in SQL.
TIME_RULE = dict(min_tracks=2, min_survival=0.0, max_parallax_px=1e9)
KEYFRAME_SQL = (
    "WITH RECURSIVE v_obs AS ("
    + view_sql("obs")
    + "), v_frames AS ("
    + view_sql("frames")
    + "), rows AS (SELECT f.seq, f.frame, f.ts_ns, f.status = 'ok' AS ok, coalesce(o.n, 0) AS n,"
    " row_number() OVER (PARTITION BY f.seq ORDER BY f.ts_ns) AS i FROM v_frames f LEFT JOIN"
    " (SELECT seq, frame, count(*) AS n FROM v_obs GROUP BY seq, frame) o USING (seq, frame)),"
    " walk AS (SELECT seq, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS frame, 0 AS kfs,"
    " CAST(0 AS BIGINT) AS last_ns, false AS chosen FROM (SELECT DISTINCT seq FROM rows) UNION ALL"
    " SELECT r.seq, r.i, r.frame, CASE WHEN c AND r.ok THEN kfs + 1 ELSE kfs END,"
    " CASE WHEN c AND r.ok THEN r.ts_ns ELSE last_ns END, c FROM (SELECT r.*, w.kfs, w.last_ns,"
    " r.n > 0 AND (w.kfs < 2 OR r.n < 2 OR r.ts_ns - w.last_ns > 500000000) AS c"
    " FROM walk w JOIN rows r ON r.seq = w.seq AND r.i = w.i + 1) r)"
    " SELECT seq, frame FROM walk WHERE chosen"
)


def keyframes(spark, sf, **options):
    from posequery.operators.keyframes import nested_frames, select_keyframes
    from posequery.streaming.rules import KeyframeRule

    nested = nested_frames(frames(spark, sf), obs(spark, sf), 60_000_000_000)
    rule = KeyframeRule(400.0, 400.0, 320.0, 240.0, **options)
    return select_keyframes(nested, rule, 60_000_000_000)


@query("i3_keyframe_select", KEYFRAME_SQL)
def keyframe_select(spark, sf):
    return keyframes(spark, sf, **TIME_RULE)


def _rotation_sql(prefix: str) -> list[list[str]]:
    """Entries of the rotation matrix of the unit quaternion in columns ``prefix``qx .. ``prefix``qw."""
    x, y, z, w = (f"{prefix}q{c}" for c in "xyzw")
    one = lambda a, b: f"(1 - 2 * ({a} * {a} + {b} * {b}))"
    two = lambda a, b, sign, c, d: f"(2 * ({a} * {b} {sign} {c} * {d}))"
    return [
        [one(y, z), two(x, y, "-", z, w), two(x, z, "+", y, w)],
        [two(x, y, "+", z, w), one(x, z), two(y, z, "-", x, w)],
        [two(x, z, "-", y, w), two(y, z, "+", x, w), one(x, y)],
    ]


def _all_rules_sql(min_tracks: int, survival: str = "6e-1", parallax: str = "30", reach_ns: int = 500_000_000) -> str:
    """Keyframes by all four rules: frames near enough in time are compared first, then the choice is followed."""
    here, there = _rotation_sql("a."), _rotation_sql("b.")
    turn = [[" + ".join(f"{here[k][i]} * {there[k][j]}" for k in range(3)) for j in range(3)] for i in range(3)]
    ray = ["(b.u - 320) / 4e2", "(b.v - 240) / 4e2", "1"]
    turned = [" + ".join(f"({turn[i][j]}) * {ray[j]}" for j in range(3)) for i in range(3)]
    return (
        "WITH RECURSIVE v_obs AS (" + view_sql("obs") + "), v_frames AS (" + view_sql("frames") + "), posed AS (SELECT seq, frame, ts_ns,"
        " status = 'ok' AS ok, row_number() OVER (PARTITION BY seq ORDER BY ts_ns) AS i,"
        " last_value(CASE WHEN status = 'ok' THEN {'x': qx, 'y': qy, 'z': qz, 'w': qw} END IGNORE NULLS) OVER"
        " (PARTITION BY seq ORDER BY ts_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM v_frames),"
        " rows AS MATERIALIZED (SELECT p.seq, frame, ts_ns, ok, i, coalesce(o.n, 0) AS n, coalesce(q.x, 0) AS qx, coalesce(q.y, 0) AS qy,"
        " coalesce(q.z, 0) AS qz, coalesce(q.w, 1) AS qw FROM posed p LEFT JOIN"
        " (SELECT seq, frame, count(*) AS n FROM v_obs GROUP BY seq, frame) o USING (seq, frame)),"
        " seen AS (SELECT r.*, o.id, o.u, o.v FROM rows r JOIN v_obs o USING (seq, frame)),"
        f" ray AS (SELECT a.seq, a.i, b.i AS before, a.u, a.v, {turned[0]} AS x, {turned[1]} AS y, {turned[2]} AS z FROM seen a JOIN seen b"
        f" ON a.seq = b.seq AND a.id = b.id AND b.i < a.i AND a.ts_ns - b.ts_ns <= {reach_ns}),"
        " pair AS MATERIALIZED (SELECT seq, i, before, count(*) AS common, avg(sqrt(power(u - (x / z * 400 + 320), 2) + power(v - (y / z * 400 + 240), 2)))"
        " FILTER (z > 1e-6) AS moved FROM ray GROUP BY seq, i, before),"
        " walk AS (SELECT seq, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS frame, 0 AS kfs, CAST(0 AS BIGINT) AS last, CAST(0 AS BIGINT) AS last_ns,"
        " CAST(0 AS BIGINT) AS last_n, false AS chosen FROM (SELECT DISTINCT seq FROM rows) UNION ALL"
        " SELECT seq, i, frame, CASE WHEN c AND ok THEN kfs + 1 ELSE kfs END, CASE WHEN c AND ok THEN i ELSE last END,"
        " CASE WHEN c AND ok THEN ts_ns ELSE last_ns END, CASE WHEN c AND ok THEN n ELSE last_n END, c FROM"
        f" (SELECT r.*, w.kfs, w.last, w.last_ns, w.last_n, r.n > 0 AND (w.kfs < 2 OR r.n < {min_tracks} OR r.ts_ns - w.last_ns > {reach_ns}"
        f" OR coalesce(p.common, 0)::DOUBLE / greatest(w.last_n, 1) < {survival} OR coalesce(p.moved > {parallax}, false)) AS c"
        " FROM walk w JOIN rows r ON r.seq = w.seq AND r.i = w.i + 1 LEFT JOIN pair p ON p.seq = r.seq AND p.i = r.i AND p.before = w.last))"
        " SELECT seq, frame FROM walk WHERE chosen"
    )


@query("i3_keyframe_select_all_rules", _all_rules_sql(2))
def keyframe_select_all(spark, sf):
    return keyframes(spark, sf, min_tracks=2)
