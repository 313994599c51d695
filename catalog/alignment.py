"""Queries on time alignment and trajectory evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import query, r6, s6
from posequery.fixtures import view, view_sql, with_views
from posequery.operators import evaluate as ev
from posequery.operators import timejoin as tj
from posequery.session import cut

MAX_DT = tj.MAX_DT_NS
# Events lie minutes apart here; ten minutes keep chunks small at any size of the tables.
CHUNK_NS = 600_000_000_000
DELTA_NS, TOLERANCE_NS = 6 * 3_600_000_000_000, 30 * 60_000_000_000

# Brute force: every ground-truth row within the bound, best one per estimate row.
_ASSOC = (
    "SELECT e.run, e.seq, e.ts_ns, e.tx, e.ty, e.tz, e.qz, e.qw, g.ts_ns AS gt_ts_ns,"
    " g.tx AS gx, g.ty AS gy, g.tz AS gz, g.qz AS gqz, g.qw AS gqw, e.ts_ns - g.ts_ns AS dt_ns"
    f" FROM v_est e JOIN v_gt g ON e.seq = g.seq AND abs(e.ts_ns - g.ts_ns) <= {MAX_DT}"
    " QUALIFY row_number() OVER (PARTITION BY e.run, e.seq, e.ts_ns"
    " ORDER BY abs(e.ts_ns - g.ts_ns), g.ts_ns) = 1"
)
# In the plane the best rotation has a closed form.
_ALIGN = (
    "SELECT run, seq, count(*) AS n, avg(tx) AS ex, avg(ty) AS ey, avg(gx) AS gx, avg(gy) AS gy,"
    " atan2(covar_pop(gy, tx) - covar_pop(gx, ty), covar_pop(gx, tx) + covar_pop(gy, ty)) AS yaw"
    " FROM assoc GROUP BY run, seq"
)
_PLACED = (
    "SELECT a.*, cos(l.yaw) * (a.tx - l.ex) - sin(l.yaw) * (a.ty - l.ey) + l.gx AS ax,"
    " sin(l.yaw) * (a.tx - l.ex) + cos(l.yaw) * (a.ty - l.ey) + l.gy AS ay, l.yaw"
    " FROM assoc a JOIN align l USING (run, seq)"
)
_ANGLE = "degrees(2 * atan2(abs({s}), abs({c})))"
# Half angle of the remaining rotation, by the addition theorems.
_ATE = (
    "SELECT *, sqrt((ax - gx) ** 2 + (ay - gy) ** 2) AS et, "
    + _ANGLE.format(
        s="sin(yaw / 2 + atan2(qz, qw) - atan2(gqz, gqw))",
        c="cos(yaw / 2 + atan2(qz, qw) - atan2(gqz, gqw))",
    )
    + " AS er FROM placed"
)
ATE_CTES = {"assoc": _ASSOC, "align": _ALIGN, "placed": _PLACED, "ate": _ATE}


def stats_sql(value: str, prefix: str) -> str:
    return ", ".join(
        [
            s6(f"sqrt(avg({value} * {value}))", f"{prefix}rmse"),
            s6(f"avg({value})", f"{prefix}mean"),
            s6(f"median({value})", f"{prefix}median"),
            s6(f"stddev_pop({value})", f"{prefix}stddev"),
            s6(f"max({value})", f"{prefix}max"),
        ]
    )


def associated(spark: SparkSession, sf: str, est: str = "est") -> DataFrame:
    return tj.associate(view(spark, sf, est).drop("event_id"), view(spark, sf, "gt").drop("event_id"), width_ns=CHUNK_NS)


def pairs(spark: SparkSession, sf: str, est: str = "est") -> DataFrame:
    return cut(tj.matched_pairs(associated(spark, sf, est)), "pairs")


@query(
    "c1_associate",
    with_views("est", "gt", assoc=_ASSOC) + "SELECT run, seq, ts_ns, gt_ts_ns, dt_ns FROM assoc",
)
def associate(spark, sf):
    return tj.matched_pairs(associated(spark, sf)).select(
        "run", "seq", "ts_ns", F.col("gt.ts_ns").alias("gt_ts_ns"), "dt_ns"
    )


@query(
    "d3_ate",
    with_views("est", "gt", **ATE_CTES)
    + f"SELECT run, seq, count(*) AS n, {stats_sql('et', 'trans_')}, {stats_sql('er', 'rot_')}"
    " FROM ate GROUP BY run, seq",
)
def ate(spark, sf):
    report = ev.ate_report(pairs(spark, sf))
    return report.select(
        "run",
        "seq",
        "n",
        *[r6(f"{p}{s}") for p in ("trans_", "rot_") for s in ev.STAT_FIELDS],
    )


_PARTNER = (
    "SELECT a.run, a.seq, a.ts_ns, b.ts_ns AS partner_ts_ns, a.tx, a.ty, a.qz, a.qw, a.gx, a.gy,"
    " a.gqz, a.gqw, b.tx AS btx, b.ty AS bty, b.qz AS bqz, b.qw AS bqw, b.gx AS bgx, b.gy AS bgy,"
    " b.gqz AS bgqz, b.gqw AS bgqw FROM assoc a JOIN assoc b ON a.run = b.run AND a.seq = b.seq"
    f" AND abs(b.ts_ns - a.ts_ns - {DELTA_NS}) <= {TOLERANCE_NS}"
    " QUALIFY row_number() OVER (PARTITION BY a.run, a.seq, a.ts_ns"
    f" ORDER BY abs(b.ts_ns - a.ts_ns - {DELTA_NS}), b.ts_ns DESC) = 1"
)
_RPE = (
    "SELECT run, seq, sqrt("
    "power((cos(te) * (btx - tx) + sin(te) * (bty - ty))"
    " - (cos(tg) * (bgx - gx) + sin(tg) * (bgy - gy)), 2)"
    " + power((-sin(te) * (btx - tx) + cos(te) * (bty - ty))"
    " - (-sin(tg) * (bgx - gx) + cos(tg) * (bgy - gy)), 2)) AS et, "
    + _ANGLE.format(
        s="sin(atan2(bqz, bqw) - te / 2 - atan2(bgqz, bgqw) + tg / 2)",
        c="cos(atan2(bqz, bqw) - te / 2 - atan2(bgqz, bgqw) + tg / 2)",
    )
    + " AS er FROM (SELECT *, 2 * atan2(qz, qw) AS te, 2 * atan2(gqz, gqw) AS tg FROM partner)"
)


@query(
    "c2_rpe_partner",
    with_views("est", "gt", assoc=_ASSOC, partner=_PARTNER)
    + "SELECT a.run, a.seq, a.ts_ns, p.partner_ts_ns FROM assoc a LEFT JOIN partner p"
    " USING (run, seq, ts_ns)",
)
def rpe_partner(spark, sf):
    matched = tj.matched_pairs(associated(spark, sf))
    return tj.rpe_partner(matched, DELTA_NS, TOLERANCE_NS, 3 * TOLERANCE_NS).select(
        "run", "seq", "ts_ns", F.col("partner.ts_ns").alias("partner_ts_ns")
    )


@query(
    "d4_rpe",
    with_views("est", "gt", assoc=_ASSOC, partner=_PARTNER, rpe=_RPE)
    + "SELECT m.run, m.seq, pair_count, matched - pair_count AS dropped_no_partner,"
    " trans_rmse, trans_mean, trans_median, trans_stddev, trans_max,"
    " rot_rmse, rot_mean, rot_median, rot_stddev, rot_max FROM"
    " (SELECT run, seq, count(*) AS matched FROM assoc GROUP BY run, seq) m JOIN"
    f" (SELECT run, seq, count(*) AS pair_count, {stats_sql('et', 'trans_')},"
    f" {stats_sql('er', 'rot_')} FROM rpe GROUP BY run, seq) s USING (run, seq)",
)
def rpe(spark, sf):
    report = ev.rpe_report(pairs(spark, sf), DELTA_NS, TOLERANCE_NS, 3 * TOLERANCE_NS)
    return report.select(
        "run",
        "seq",
        "pair_count",
        "dropped_no_partner",
        *[r6(f"{p}{s}") for p in ("trans_", "rot_") for s in ev.STAT_FIELDS],
    )


# Beside the given runs one that lies far from its ground truth and one of which two thirds match nothing.
_MORE_EST = (
    "SELECT * FROM est_0 UNION ALL SELECT * REPLACE ('far' AS run, ts_ns + 4000000000000000 AS ts_ns) FROM est_0 WHERE seq = 1"
    " UNION ALL SELECT * REPLACE ('thin' AS run, ts_ns + CASE WHEN event_id % 3 = 0 THEN 0 ELSE 600000000 END AS ts_ns) FROM est_0 WHERE seq = 2"
)


def gated_pairs(spark, sf):
    """Matched pairs and the association report of the runs of ``_MORE_EST``."""
    est = view(spark, sf, "est")
    late = F.when(F.col("event_id") % 3 == 0, 0).otherwise(600_000_000)
    far = est.where("seq = 1").withColumns({"run": F.lit("far"), "ts_ns": F.col("ts_ns") + 4_000_000_000_000_000})
    thin = est.where("seq = 2").withColumns({"run": F.lit("thin"), "ts_ns": F.col("ts_ns") + late})
    gt = view(spark, sf, "gt").drop("event_id")
    found = cut(tj.associate(est.unionByName(far).unionByName(thin).drop("event_id"), gt, width_ns=CHUNK_NS), "associated")
    return cut(tj.matched_pairs(found), "pairs"), tj.association_report(found, gt)


_GATE = (
    "SELECT e.run, e.seq, est_total, coalesce(matched, 0) AS matched, coalesce(matched, 0) / est_total::DOUBLE AS match_rate,"
    " CASE WHEN coalesce(matched, 0) = 0 THEN 'no_overlap' WHEN matched < 3 THEN 'too_few_matches'"
    " WHEN matched / est_total::DOUBLE < 5e-1 THEN 'match_rate_too_low' END AS error_code FROM"
    " (SELECT run, seq, count(*) AS est_total FROM v_est GROUP BY run, seq) e LEFT JOIN"
    " (SELECT run, seq, count(*) AS matched FROM assoc GROUP BY run, seq) m ON e.run = m.run AND e.seq = m.seq"
)
_MORE_VIEWS = {"est_0": view_sql("est"), "v_est": _MORE_EST}
_STATS = [f"{p}{s}" for p in ("trans_", "rot_") for s in ev.STAT_FIELDS]


@query(
    "d3_ate_errors",
    with_views("gt", **_MORE_VIEWS, **ATE_CTES, gate=_GATE)
    + f"SELECT g.run, g.seq, est_total, matched, match_rate, error_code, s.n, {', '.join(_STATS)} FROM gate g LEFT JOIN"
    f" (SELECT run, seq, count(*) AS n, {stats_sql('et', 'trans_')}, {stats_sql('er', 'rot_')} FROM ate GROUP BY run, seq) s"
    " ON g.run = s.run AND g.seq = s.seq AND g.error_code IS NULL",
)
def ate_errors(spark, sf):
    matched, gate = gated_pairs(spark, sf)
    report = ev.for_every_run(ev.ate_report(matched), gate)
    return report.select("run", "seq", "est_total", "matched", "match_rate", "error_code", "n", *map(r6, _STATS))


@query(
    "d4_rpe_errors",
    with_views("gt", **_MORE_VIEWS, assoc=_ASSOC, partner=_PARTNER, rpe=_RPE, gate=_GATE)
    + "SELECT g.run, g.seq, est_total, g.matched, match_rate, coalesce(error_code, CASE WHEN pair_count IS NULL THEN 'no_delta_pairs' END)"
    " AS error_code, CASE WHEN error_code IS NULL THEN coalesce(pair_count, 0) END AS pair_count,"
    " CASE WHEN error_code IS NULL THEN g.matched - coalesce(pair_count, 0) END AS dropped_no_partner,"
    f" {', '.join(_STATS)} FROM gate g LEFT JOIN"
    f" (SELECT run, seq, count(*) AS pair_count, {stats_sql('et', 'trans_')}, {stats_sql('er', 'rot_')} FROM rpe GROUP BY run, seq) s"
    " ON g.run = s.run AND g.seq = s.seq AND g.error_code IS NULL",
)
def rpe_errors(spark, sf):
    matched, gate = gated_pairs(spark, sf)
    report = ev.for_every_run(ev.rpe_report(matched, DELTA_NS, TOLERANCE_NS, 3 * TOLERANCE_NS), gate)
    columns = ["run", "seq", "est_total", "matched", "match_rate", "error_code", "pair_count", "dropped_no_partner"]
    return report.select(*columns, *map(r6, _STATS))


@query(
    "c3_pair_exact",
    with_views("left", "right")
    + "SELECT l.seq, l.ts_ns FROM v_left l JOIN v_right r ON l.seq = r.seq AND l.ts_ns = r.ts_ns",
)
def pair_exact(spark, sf):
    return tj.pair_exact(view(spark, sf, "left"), view(spark, sf, "right"))


SOFT_NS = 3_000_000
# Up to sf0.01 no two stamps of one side lie within the tolerance of the same other stamp,
# so the greedy result is the join; denser tables have more pairs in the join, which uses a
# stamp more than once.  Dense streams are tested by brute force.
_SOFT = (
    "SELECT l.seq, l.ts_ns, r.ts_ns AS right_ts_ns FROM v_left l JOIN v_right r"
    f" ON l.seq = r.seq AND abs(l.ts_ns - r.ts_ns) <= {SOFT_NS}"
)


@query("c4_pair_soft", with_views("left", "right") + _SOFT)
def pair_soft(spark, sf):
    return tj.pair_soft(view(spark, sf, "left"), view(spark, sf, "right"), SOFT_NS, CHUNK_NS)


# With hours of tolerance a sequence has no gap: one stretch of stamps that all depend on each other.
DENSE_NS, DENSE_WIDTH_NS, DENSE_QUEUE = 6 * 3600 * 10**9, 86400 * 10**9, 9


def _pushes_sql(tolerance_ns: int, max_queue: int) -> str:
    """Pairs and counters of pushes in order, followed with the queue itself; ``seen`` has a row for each push."""
    return (
        with_views("left", "right").replace("WITH ", "WITH RECURSIVE ", 1)
        + ", stamp AS (SELECT seq, ts_ns, 0 AS side FROM v_left UNION ALL SELECT seq, ts_ns, 1 FROM v_right),"
        " push AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY ts_ns, side) AS i FROM stamp),"
        " seen AS (SELECT seq, 0::BIGINT AS i, 0::BIGINT AS ts_ns, 0 AS side, 0 AS waiting, []::BIGINT[] AS queue, NULL::BIGINT AS partner,"
        " false AS waits, false AS overflow FROM (SELECT DISTINCT seq FROM push) UNION ALL"
        " SELECT seq, i, ts_ns, side, CASE WHEN met IS NULL THEN side ELSE waiting END, CASE WHEN met IS NOT NULL THEN kept[2:]"
        f" WHEN len(mine) = {max_queue} THEN list_append(mine[2:], ts_ns) ELSE list_append(mine, ts_ns) END, met, met IS NULL,"
        f" met IS NULL AND len(mine) = {max_queue} FROM (SELECT *, CASE WHEN side <> waiting THEN kept[1] END AS met,"
        " CASE WHEN side = waiting THEN kept ELSE []::BIGINT[] END AS mine FROM (SELECT p.*, s.waiting, CASE WHEN p.side = s.waiting THEN s.queue"
        f" ELSE list_filter(s.queue, lambda q: q >= p.ts_ns - {tolerance_ns}) END AS kept"
        " FROM seen s JOIN push p ON p.seq = s.seq AND p.i = s.i + 1)))"
    )


@query(
    "c4_pair_soft_dense",
    _pushes_sql(DENSE_NS, DENSE_QUEUE)
    + " SELECT seq, CASE WHEN side = 0 THEN ts_ns ELSE partner END AS ts_ns,"
    " CASE WHEN side = 0 THEN partner ELSE ts_ns END AS right_ts_ns FROM seen WHERE partner IS NOT NULL",
)
def pair_soft_dense(spark, sf):
    return tj.pair_soft(view(spark, sf, "left"), view(spark, sf, "right"), DENSE_NS, DENSE_WIDTH_NS, DENSE_QUEUE)


@query(
    "d26_sync_report_queues",
    _pushes_sql(DENSE_NS, DENSE_QUEUE)
    + " SELECT seq, count(partner) AS emitted, count(*) FILTER (side = 0) AS pushed_left, count(*) FILTER (side = 1) AS pushed_right,"
    " count(*) FILTER (side = 0) - count(partner) - count(*) FILTER (side = 0 AND overflow) AS dropped_left,"
    " count(*) FILTER (side = 1) - count(partner) - count(*) FILTER (side = 1 AND overflow) AS dropped_right,"
    " count(*) FILTER (side = 0 AND overflow) AS overflow_left, count(*) FILTER (side = 1 AND overflow) AS overflow_right,"
    " coalesce(max(CASE WHEN waits THEN len(queue) ELSE 1 END) FILTER (side = 0), 0)::BIGINT AS longest_left,"
    " coalesce(max(CASE WHEN waits THEN len(queue) ELSE 1 END) FILTER (side = 1), 0)::BIGINT AS longest_right"
    " FROM seen WHERE i > 0 GROUP BY seq",
)
def sync_report_queues(spark, sf):
    return tj.steps_report(tj.sync_steps(view(spark, sf, "left"), view(spark, sf, "right"), DENSE_NS, DENSE_WIDTH_NS, DENSE_QUEUE))


@query(
    "c5_exact_intersection_count",
    with_views("left", "right")
    + "SELECT s.seq, count(r.ts_ns) AS common FROM"
    " (SELECT seq FROM v_left UNION SELECT seq FROM v_right) s"
    " LEFT JOIN v_left l USING (seq) LEFT JOIN v_right r ON l.seq = r.seq AND l.ts_ns = r.ts_ns"
    " GROUP BY s.seq",
)
def intersection_count(spark, sf):
    return tj.intersection_count(view(spark, sf, "left"), view(spark, sf, "right"))


@query(
    "d26_sync_report",
    with_views("left", "right", pairs=_SOFT)
    + "SELECT seq, pushed_left, pushed_right, emitted, pushed_left - emitted AS dropped_left,"
    " pushed_right - emitted AS dropped_right FROM"
    " (SELECT seq, count(*) AS pushed_left FROM v_left GROUP BY seq) JOIN"
    " (SELECT seq, count(*) AS pushed_right FROM v_right GROUP BY seq) USING (seq) JOIN"
    " (SELECT seq, count(*) AS emitted FROM pairs GROUP BY seq) USING (seq)",
)
def sync_report(spark, sf):
    return tj.steps_report(tj.sync_steps(view(spark, sf, "left"), view(spark, sf, "right"), SOFT_NS, CHUNK_NS)).select(
        "seq", "pushed_left", "pushed_right", "emitted", "dropped_left", "dropped_right"
    )


@query(
    "c6_pose_at",
    with_views("images", "gt")
    + "SELECT q.seq, q.ts_ns, coalesce(p.ts_ns, f.ts_ns) AS pose_ts_ns,"
    " coalesce(p.event_id, f.event_id) AS event_id FROM v_images q ASOF LEFT JOIN v_gt p"
    " ON q.seq = p.seq AND q.ts_ns >= p.ts_ns"
    " LEFT JOIN (SELECT seq, min(ts_ns) AS ts_ns, arg_min(event_id, ts_ns) AS event_id FROM v_gt"
    " GROUP BY seq) f ON q.seq = f.seq",
)
def pose_at(spark, sf):
    found = tj.pose_at(view(spark, sf, "images"), view(spark, sf, "gt"), CHUNK_NS)
    return found.select(
        "seq", "ts_ns", F.col("pose.ts_ns").alias("pose_ts_ns"), F.col("pose.event_id").alias("event_id")
    )


MAX_STEP_NS = 3_600_000_000_000
_MERGED = (
    "SELECT seq, ts_ns, side,"
    " lag(ts_ns) OVER (PARTITION BY seq ORDER BY ts_ns, side) AS before,"
    " max(CASE WHEN side = 1 THEN ts_ns END) OVER (PARTITION BY seq ORDER BY ts_ns, side"
    " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_image_ns,"
    " min(CASE WHEN side = 1 THEN ts_ns END) OVER (PARTITION BY seq ORDER BY ts_ns, side"
    " ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS image_ns,"
    " max(CASE WHEN side = 0 THEN ts_ns END) OVER (PARTITION BY seq ORDER BY ts_ns, side"
    " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS older,"
    " min(CASE WHEN side = 0 THEN ts_ns END) OVER (PARTITION BY seq ORDER BY ts_ns, side"
    " ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS newer"
    " FROM (SELECT seq, ts_ns, 0 AS side FROM v_imu UNION ALL SELECT seq, ts_ns, 1 FROM v_images)"
)
_INTERVALS = (
    "SELECT *, CASE WHEN side = 1 AND prev_image_ns IS NULL THEN 'init' WHEN side = 1 THEN 'end'"
    " ELSE 'sample' END AS kind, CASE WHEN side = 1 AND prev_image_ns IS NULL THEN 0"
    " ELSE ts_ns - before END AS dt_ns FROM merged WHERE image_ns IS NOT NULL"
    " AND (side = 1 OR prev_image_ns IS NOT NULL)"
    " AND NOT (side = 1 AND prev_image_ns IS NOT NULL AND coalesce(older = ts_ns, false))"
)


def _segments(spark, sf):
    return tj.imu_segments(view(spark, sf, "images"), view(spark, sf, "imu"), CHUNK_NS)


@query(
    "c7_imu_segments",
    with_views("imu", "images", merged=_MERGED, intervals=_INTERVALS)
    + "SELECT seq, image_ns, count(*) FILTER (kind = 'sample') AS samples,"
    " CAST(sum(dt_ns) AS BIGINT) AS sum_dt_ns, max(image_ns - prev_image_ns) AS interval_ns,"
    " max(dt_ns) AS longest_step_ns,"
    f" (max(dt_ns) > {MAX_STEP_NS} OR bool_or(kind <> 'sample' AND (older IS NULL OR newer IS NULL)))"
    " AS has_gap, bool_or(kind = 'init') AS is_init FROM intervals GROUP BY seq, image_ns",
)
def imu_segments(spark, sf):
    return tj.imu_segment_report(_segments(spark, sf), MAX_STEP_NS)


@query(
    "h14_interpolated_boundaries",
    with_views("imu", "images")
    + "SELECT i.seq, i.ts_ns, "
    + ", ".join(
        s6(
            f"a.{x} + (b.{x} - a.{x}) * CASE WHEN b.ts_ns > a.ts_ns"
            " THEN (i.ts_ns - a.ts_ns) / CAST(b.ts_ns - a.ts_ns AS DOUBLE) ELSE 0e0 END",
            x,
        )
        for x in ("ax", "wz")
    )
    + " FROM (SELECT seq, ts_ns, row_number() OVER (PARTITION BY seq ORDER BY ts_ns) AS n"
    " FROM v_images) i ASOF LEFT JOIN v_imu a ON i.seq = a.seq AND i.ts_ns >= a.ts_ns"
    " ASOF LEFT JOIN v_imu b ON i.seq = b.seq AND i.ts_ns <= b.ts_ns"
    " WHERE n > 1 AND coalesce(a.ts_ns <> i.ts_ns, true)",
)
def interpolated_boundaries(spark, sf):
    ends = _segments(spark, sf).where(F.col("kind") == "end")
    return ends.select("seq", "ts_ns", r6("ax"), r6("wz"))


@query(
    "c8_diag_segments",
    with_views("est", "est_diag")
    + "SELECT e.run, e.seq, e.ts_ns, d.segment_id FROM v_est e JOIN v_est_diag d"
    " ON e.run = d.run AND e.seq = d.seq AND e.ts_ns = d.ts_ns",
)
def diag_segments(spark, sf):
    rows = view(spark, sf, "est").select("run", "seq", "ts_ns")
    return ev.diag_segments(rows, view(spark, sf, "est_diag"))


@query(
    "d1_error_stats",
    "SELECT event_type, count(*) AS n, " + stats_sql("value", "") + " FROM events GROUP BY event_type",
)
def error_stats(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "value")
    stats = ev.error_stats(events, ["event_type"], {"": "value"})
    return stats.select("event_type", "n", *[r6(s) for s in ev.STAT_FIELDS])


@query(
    "d2_align_se3",
    with_views("est", "gt", assoc=_ASSOC, align=_ALIGN)
    + f"SELECT run, seq, n, {s6('cos(yaw)', 'cos_yaw')}, {s6('sin(yaw)', 'sin_yaw')},"
    f" {s6('gx - cos(yaw) * ex + sin(yaw) * ey', 'tx')},"
    f" {s6('gy - sin(yaw) * ex - cos(yaw) * ey', 'ty')} FROM align",
)
def align_se3(spark, sf):
    transform = ev.align_se3(tj.matched_pairs(associated(spark, sf)))
    qz, qw = F.col("align_qz"), F.col("align_qw")
    return transform.select(
        "run",
        "seq",
        "n",
        r6(1.0 - 2.0 * qz * qz, "cos_yaw"),
        r6(2.0 * qz * qw, "sin_yaw"),
        r6("align_tx").alias("tx"),
        r6("align_ty").alias("ty"),
    )


@query(
    "d5_association_report",
    with_views("est", "gt", assoc=_ASSOC)
    + "SELECT run, seq, est_total, matched, out_of_range AS dropped_out_of_range,"
    " est_total - matched - out_of_range AS dropped_over_threshold, est_first_ns, est_last_ns,"
    f" gt_first_ns, gt_last_ns, {s6('matched / CAST(est_total AS DOUBLE)', 'match_rate')},"
    " CASE WHEN matched = 0 THEN 'no_overlap' WHEN matched < 3 THEN 'too_few_matches'"
    " WHEN matched / CAST(est_total AS DOUBLE) < 0.5 THEN 'match_rate_too_low' END AS error_code"
    " FROM (SELECT e.run, e.seq, count(*) AS est_total, count(a.ts_ns) AS matched,"
    " count(*) FILTER (a.ts_ns IS NULL AND (e.ts_ns < gt_first_ns OR e.ts_ns > gt_last_ns))"
    " AS out_of_range, min(e.ts_ns) AS est_first_ns, max(e.ts_ns) AS est_last_ns,"
    " any_value(gt_first_ns) AS gt_first_ns, any_value(gt_last_ns) AS gt_last_ns"
    " FROM v_est e LEFT JOIN assoc a USING (run, seq, ts_ns) LEFT JOIN (SELECT seq,"
    " min(ts_ns) AS gt_first_ns, max(ts_ns) AS gt_last_ns FROM v_gt GROUP BY seq) g"
    " ON e.seq = g.seq GROUP BY e.run, e.seq)",
)
def association_report(spark, sf):
    report = tj.association_report(associated(spark, sf), view(spark, sf, "gt"))
    return report.withColumn("match_rate", r6("match_rate"))


_STREAMS = (
    "SELECT seq, ts_ns, 'imu' AS kind, 0 AS rank FROM v_imu UNION ALL"
    " SELECT seq, ts_ns, 'left', 1 FROM v_left UNION ALL SELECT seq, ts_ns, 'right', 2 FROM v_right"
)


def streams(spark, sf):
    from posequery.sources.sensors import replay_union

    return replay_union(view(spark, sf, "imu"), view(spark, sf, "left"), view(spark, sf, "right"))


@query(
    "d6_stream_summary",
    with_views("imu", "left", "right", streams=_STREAMS)
    + "SELECT seq, kind, count(*) AS count, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns"
    " FROM streams GROUP BY seq, kind",
)
def stream_summary(spark, sf):
    from posequery.sources.sensors import stream_summary as summarise

    return summarise(streams(spark, sf))


@query(
    "d9_percentiles",
    "SELECT event_type, "
    + ", ".join(s6(f"quantile_cont(value, {q})", n) for n, q in (("p10", 0.1), ("p50", 0.5), ("p95", 0.95)))
    + " FROM events GROUP BY event_type",
)
def percentiles(spark, sf):
    from posequery.plans.quantiles import exact_quantiles

    events = spark.read.parquet(f"{sf}/events.parquet")
    found = exact_quantiles(events, ["event_type"], "value", {"p10": 0.1, "p50": 0.5, "p95": 0.95})
    return found.select("event_type", r6("p10"), r6("p50"), r6("p95"))


_SEG_ASSOC = (
    "SELECT a.*, d.segment_id FROM assoc a JOIN v_est_diag d USING (run, seq, ts_ns)"
)


def _ate_by(source: str, keys: str) -> str:
    return (
        f"SELECT {keys}, sqrt(avg(power(cos(yaw) * (tx - ex) - sin(yaw) * (ty - ey) + cx - gx, 2)"
        " + power(sin(yaw) * (tx - ex) + cos(yaw) * (ty - ey) + cy - gy, 2))) AS ate"
        f" FROM {source} JOIN (SELECT {keys}, avg(tx) AS ex, avg(ty) AS ey, avg(gx) AS cx,"
        " avg(gy) AS cy, atan2(covar_pop(gy, tx) - covar_pop(gx, ty),"
        f" covar_pop(gx, tx) + covar_pop(gy, ty)) AS yaw FROM {source} GROUP BY {keys}"
        f" HAVING count(*) >= 3) USING ({keys}) GROUP BY {keys}"
    )


@query(
    "d18_segment_ate",
    with_views(
        "est",
        "gt",
        "est_diag",
        assoc=_ASSOC,
        seg=_SEG_ASSOC,
        own=_ate_by("seg", "run, seq, segment_id"),
        overall=_ate_by("seg", "run, seq"),
        size="SELECT run, seq, segment_id, count(*) AS frames FROM v_est"
        " JOIN v_est_diag USING (run, seq, ts_ns) GROUP BY run, seq, segment_id",
        shares="SELECT *, frames / CAST(sum(frames) OVER (PARTITION BY run, seq) AS DOUBLE) AS share"
        " FROM size LEFT JOIN own USING (run, seq, segment_id)",
    )
    + f"SELECT s.run, s.seq, s.segment_id, s.frames, {s6('s.share', 'share')},"
    f" {s6('s.ate', 'segment_ate')}, {s6('w.rms', 'weighted_rms')}, {s6('o.ate', 'global_ate')},"
    f" {s6('o.ate - w.rms', 'misalignment')} FROM shares s JOIN (SELECT run, seq,"
    " sqrt(sum(share * ate * ate)) AS rms FROM shares GROUP BY run, seq) w USING (run, seq)"
    " LEFT JOIN overall o USING (run, seq)",
)
def segment_ate(spark, sf):
    diag = view(spark, sf, "est_diag")
    matched = cut(ev.diag_segments(tj.matched_pairs(associated(spark, sf)), diag), "pairs")
    frames = ev.diag_segments(view(spark, sf, "est").select("run", "seq", "ts_ns"), diag)
    found = ev.segment_decomposition(matched, frames)
    return found.select(
        "run",
        "seq",
        "segment_id",
        "frames",
        *[r6(c) for c in ("share", "segment_ate", "weighted_rms", "global_ate", "misalignment")],
    )


@query(
    "d23_extent",
    with_views("gt")
    + "SELECT seq, "
    + ", ".join(
        f"{s6(f'min({a})', f'min_{a}')}, {s6(f'max({a})', f'max_{a}')},"
        f" {s6(f'(min({a}) + max({a})) / 2', f'centre_{a}')}"
        for a in ("tx", "ty", "tz")
    )
    + f", {s6('greatest(max(tx) - min(tx), max(ty) - min(ty), max(tz) - min(tz)) / 2', 'radius')}"
    " FROM v_gt GROUP BY seq",
)
def extent(spark, sf):
    from posequery.operators.ledger import extent as bounds

    found = bounds(view(spark, sf, "gt"), ["seq"])
    return found.select("seq", *[r6(c) for c in found.columns if c != "seq"])


@query(
    "e6_elapsed_seconds",
    with_views("gt")
    + f"SELECT seq, ts_ns, {s6('(ts_ns - min(ts_ns) OVER (PARTITION BY seq)) * 1e-9', 'elapsed_s')}"
    " FROM v_gt",
)
def elapsed(spark, sf):
    from posequery.operators.ledger import elapsed_seconds

    rows = elapsed_seconds(view(spark, sf, "gt").select("seq", "ts_ns"), ["seq"])
    return rows.select("seq", "ts_ns", r6("elapsed_s"))


@query(
    "f1_merge_replay_order",
    with_views("imu", "left", "right", streams=_STREAMS)
    + "SELECT seq, ts_ns, kind,"
    " row_number() OVER (PARTITION BY seq ORDER BY ts_ns, rank) - 1 AS event_index FROM streams",
)
def merge_order(spark, sf):
    from posequery.operators.ledger import merge_replay_order

    events = streams(spark, sf).select("seq", "ts_ns", "kind", "rank")
    return merge_replay_order(events, CHUNK_NS).select("seq", "ts_ns", "kind", "event_index")


@query(
    "g1_union_streams",
    with_views("imu", "left", "right", streams=_STREAMS)
    + "SELECT seq, ts_ns, kind, ax FROM streams LEFT JOIN (SELECT seq, ts_ns, ax, 'imu' AS kind"
    " FROM v_imu) USING (seq, ts_ns, kind)",
)
def union_streams(spark, sf):
    return streams(spark, sf).select("seq", "ts_ns", "kind", "ax")


@query(
    "g2_intersect_stamps",
    with_views("left", "right")
    + "SELECT seq, ts_ns FROM v_left INTERSECT SELECT seq, ts_ns FROM v_right",
)
def intersect_stamps(spark, sf):
    return view(spark, sf, "left").intersect(view(spark, sf, "right"))


@query(
    "g3_except_stamps",
    with_views("left", "right")
    + "SELECT 'left' AS side, seq, ts_ns FROM (SELECT * FROM v_left EXCEPT SELECT * FROM v_right)"
    " UNION ALL"
    " SELECT 'right', seq, ts_ns FROM (SELECT * FROM v_right EXCEPT SELECT * FROM v_left)",
)
def except_stamps(spark, sf):
    left, right = view(spark, sf, "left"), view(spark, sf, "right")
    return (
        left.subtract(right)
        .withColumn("side", F.lit("left"))
        .unionByName(right.subtract(left).withColumn("side", F.lit("right")))
        .select("side", "seq", "ts_ns")
    )
