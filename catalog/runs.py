"""Queries on run diagnostics and the run ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query, r6, s6
from catalog.alignment import ATE_CTES, CHUNK_NS, pairs
from posequery.fixtures import table, view, with_views
from posequery.functions import text as tx
from posequery.operators import evaluate as ev
from posequery.operators import ledger as lg
from posequery.sources import runs as rn

_STATUS = (
    "CASE WHEN frames = rejected THEN 'failed' WHEN ate IS NULL OR rpe IS NULL THEN 'eval_failed'"
    " WHEN failed > 1 THEN 'completed_with_failures' WHEN warnings > 0 THEN 'completed_with_warnings'"
    " ELSE 'completed' END"
)
_LEDGER = f"SELECT *, {_STATUS} AS status FROM v_runs"


def ledger(spark, sf):
    status = lg.run_status(
        F.col("frames") != F.col("rejected"),
        F.lit(True),
        F.col("ate").isNotNull(),
        F.col("rpe").isNotNull(),
        F.col("failed") - 1,
        F.col("warnings"),
    )
    return view(spark, sf, "runs").withColumn("status", status)


@query("b10_derive_run_status", with_views("runs", ledger=_LEDGER) + "SELECT sequence, commit, config, status FROM ledger")
def run_status(spark, sf):
    return ledger(spark, sf).select("sequence", "commit", "config", "status")


# Each month follows the one before; January has no predecessor.
_LINEAGE = (
    "SELECT DISTINCT commit, CASE WHEN CAST(substr(commit, 2) AS BIGINT) % 100 > 1 THEN"
    " concat('c', CAST(CAST(substr(commit, 2) AS BIGINT) - 1 AS VARCHAR(20))) END AS predecessor FROM {runs}"
)
_DELTAS = ["ate", "rpe", "completion", "segments", "reanchors", "failed"]
_COMPARED = (
    "SELECT l.sequence, l.config, l.commit, n.predecessor, "
    + ", ".join(f"l.{c} - p.{c} AS delta_{c}" for c in _DELTAS)
    + ", CASE WHEN p.ate <> 0 THEN 100 * (l.ate - p.ate) / p.ate END AS ate_percent,"
    " CASE WHEN p.ate IS NULL OR l.ate IS NULL THEN 'incomparable' WHEN l.ate < p.ate THEN 'improved'"
    " WHEN l.ate > p.ate THEN 'regressed' ELSE 'unchanged' END AS verdict"
    " FROM ledger l JOIN lineage n USING (commit) LEFT JOIN ledger p ON p.sequence = l.sequence"
    " AND p.config = l.config AND p.commit = n.predecessor"
)


def compared(spark, sf):
    rows = ledger(spark, sf)
    lineage = rows.selectExpr(
        "commit",
        "CASE WHEN CAST(substr(commit, 2) AS BIGINT) % 100 > 1 THEN"
        " concat('c', CAST(substr(commit, 2) AS BIGINT) - 1) END AS predecessor",
    ).distinct()
    return lg.compare_checkpoints(rows, lineage)


@query(
    "c12_compare_checkpoints",
    with_views("runs", ledger=_LEDGER, lineage=_LINEAGE.format(runs="v_runs"), compared=_COMPARED)
    + f"SELECT sequence, config, commit, predecessor, {s6('delta_ate')}, {s6('delta_rpe')},"
    f" {s6('delta_completion')}, delta_segments, delta_reanchors, delta_failed,"
    f" {s6('ate_percent')}, verdict FROM compared",
)
def compare_checkpoints(spark, sf):
    found = compared(spark, sf)
    for name in ("delta_ate", "delta_rpe", "delta_completion", "ate_percent"):
        found = found.withColumn(name, r6(name))
    return found


@query(
    "b12_quality_gates",
    with_views("runs", ledger=_LEDGER, lineage=_LINEAGE.format(runs="v_runs"), compared=_COMPARED)
    + "SELECT l.sequence, l.config, l.commit,"
    " coalesce(l.ate <= a.anchor_ate AND l.reanchors = 0, false) AS hard_pass,"
    " coalesce(c.delta_ate < 0, false) AS soft_pass FROM ledger l JOIN (SELECT sequence,"
    " avg(ate) AS anchor_ate FROM ledger GROUP BY sequence) a USING (sequence)"
    " LEFT JOIN compared c ON c.sequence = l.sequence AND c.config = l.config AND c.commit = l.commit",
)
def quality_gates(spark, sf):
    rows = ledger(spark, sf)
    anchors = rows.groupBy("sequence").agg(F.avg("ate").alias("anchor_ate"))
    return lg.quality_gates(rows, anchors, compared(spark, sf))


_ERRORS = (
    "SELECT e.run, e.seq, e.ts_ns, e.et, e.er, d.outliers_culled, d.ts_ns IS NOT NULL AS has_diag"
    " FROM ate e LEFT JOIN v_est_diag d USING (run, seq, ts_ns)"
)


@query(
    "c16_errors_with_diag",
    with_views("est", "gt", "est_diag", **ATE_CTES, errors=_ERRORS)
    + "SELECT run, seq, count(*) AS n, count(*) FILTER (NOT has_diag) AS without_diag,"
    " count(*) FILTER (et > 15e-3 AND outliers_culled = 0) AS large_without_cull"
    " FROM errors GROUP BY run, seq",
)
def errors_with_diag(spark, sf):
    matched = pairs(spark, sf)
    errors = ev.ate_errors(matched, ev.align_se3(matched))
    joined = lg.errors_with_diag(
        errors.select("run", "seq", "ts_ns", "err_trans_m"), view(spark, sf, "est_diag")
    )
    large = (F.col("err_trans_m") > 15e-3) & (F.col("outliers_culled") == 0)
    return joined.groupBy("run", "seq").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("has_diag")).alias("without_diag"),
        F.count_if(large).alias("large_without_cull"),
    )


_SEEN = (
    "SELECT *, status = 'ok' AND coalesce(segment_id > last_value(CASE WHEN status = 'ok' THEN"
    " segment_id END IGNORE NULLS) OVER (PARTITION BY run, seq ORDER BY frame ROWS BETWEEN"
    " UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS reanchor FROM v_frames"
)


def frames(spark, sf):
    return view(spark, sf, "frames")


@query(
    "d12_frame_counts",
    with_views("frames", seen=_SEEN)
    + "SELECT run, seq, count(*) AS image_frames, count(*) FILTER (status = 'ok') AS ok,"
    " count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'failed') AS failed,"
    " count(*) FILTER (low_connectivity) AS low_connectivity,"
    " count(*) FILTER (is_keyframe) AS total_keyframes,"
    " count(*) FILTER (NOT is_keyframe) AS total_track_only_frames,"
    " count(*) FILTER (status = 'rejected' AND message LIKE 'insufficient%') AS seed_rejected,"
    " count(*) FILTER (status = 'ok' AND pnp_success) AS pnp_successes,"
    " count(*) FILTER (status = 'ok' AND num_shared > 0 AND NOT pnp_success AND NOT reanchor)"
    " AS pnp_fallbacks, CAST(sum(outliers_culled) AS BIGINT) AS outliers_culled,"
    " CAST(sum(num_cheirality) AS BIGINT) AS num_cheirality FROM seen GROUP BY run, seq",
)
def frame_counts(spark, sf):
    return lg.frame_counts(frames(spark, sf))


#: Rounds of renewed optimisation of a frame, and the ids that its run culled.
REOPT = "(CASE WHEN outliers_culled > 0 THEN frame % 3 ELSE 0 END)"
LIVE_SQL = (
    "SELECT f.run, f.seq, image_frames, coalesce(u.n, 0) AS outliers_culled_unique, outlier_reopts, pnp_fallbacks FROM"
    f" (SELECT run, seq, count(*) AS image_frames, CAST(sum({REOPT}) AS BIGINT) AS outlier_reopts,"
    " count(*) FILTER (status = 'ok' AND num_shared > 0 AND NOT pnp_success AND NOT reanchor) AS pnp_fallbacks FROM seen"
    " GROUP BY run, seq) f LEFT JOIN (SELECT run, seq, count(DISTINCT id) AS n FROM v_culls JOIN v_frames USING (seq, frame)"
    " GROUP BY run, seq) u ON u.run = f.run AND u.seq = f.seq"
)


@query("d12_unique_culls_and_reopts", with_views("frames", "culls", seen=_SEEN) + LIVE_SQL)
def unique_culls(spark, sf):
    rows = frames(spark, sf).withColumn("outlier_reopt_rounds", F.expr(REOPT))
    culls = view(spark, sf, "culls").join(rows.select("run", "seq", "frame"), ["seq", "frame"])
    counts = lg.frame_counts(rows, culls=culls)
    return counts.select("run", "seq", "image_frames", "outliers_culled_unique", "outlier_reopts", "pnp_fallbacks")


@query(
    "d17_segment_summary",
    with_views("frames", seen=_SEEN)
    + "SELECT run, seq, count(*) FILTER (reanchor) AS reanchors,"
    " CASE WHEN bool_or(status = 'ok') THEN count(*) FILTER (reanchor) + 1 ELSE 0 END AS segments,"
    " count(*) FILTER (status = 'rejected'"
    " AND message = 'insufficient observations to seed new segment') AS seed_rejected_new,"
    " count(*) FILTER (status = 'rejected'"
    " AND message = 'insufficient observations to seed first segment') AS seed_rejected_first,"
    " min(frame) FILTER (reanchor) AS first_reanchor FROM seen GROUP BY run, seq",
)
def segment_summary(spark, sf):
    return lg.segment_summary(frames(spark, sf))


@query(
    "e10_first_divergence",
    with_views("frames", seen=_SEEN)
    + "SELECT run, seq, min(frame) FILTER (max_window_pose_shift_m > 0.5) AS first_shift,"
    " min(frame) FILTER (status = 'failed') AS first_failed,"
    " min(frame) FILTER (reanchor) AS first_segment_change FROM seen GROUP BY run, seq",
)
def first_divergence(spark, sf):
    return lg.first_divergence(frames(spark, sf))


_WALL = "(rectify_s + frontend_s + estimator_s)"


@query(
    "d13_completion_coverage_rtf",
    with_views("frames")
    + f"SELECT run, seq, {s6('ok / CAST(n AS DOUBLE)', 'completion_rate')},"
    f" {s6('CASE WHEN span > 0 THEN coalesce(pose_span, 0) / CAST(span AS DOUBLE) ELSE 0e0 END', 'coverage_rate')},"
    f" {s6('span * 1e-9 / wall', 'rtf')} FROM (SELECT run, seq, count(*) AS n,"
    " count(*) FILTER (status = 'ok') AS ok, max(ts_ns) - min(ts_ns) AS span,"
    " max(ts_ns) FILTER (status = 'ok') - min(ts_ns) FILTER (status = 'ok') AS pose_span,"
    f" sum({_WALL}) AS wall FROM v_frames GROUP BY run, seq)",
)
def completion(spark, sf):
    rows = frames(spark, sf).withColumn("wall_s", F.expr(_WALL))
    found = lg.completion(rows)
    return found.select("run", "seq", *[r6(c) for c in ("completion_rate", "coverage_rate", "rtf")])


_STAGES = ["rectify", "frontend", "estimator"]


@query(
    "d11_stage_timing",
    with_views("frames")
    + " UNION ALL ".join(
        f"SELECT run, seq, '{s}' AS stage, {s6(f'avg({s}_s)', 'mean_s')},"
        f" {s6(f'quantile_cont({s}_s, 0.95)', 'p95_s')}, {s6(f'max({s}_s)', 'max_s')}"
        " FROM v_frames GROUP BY run, seq"
        for s in _STAGES
    ),
)
def stage_timing(spark, sf):
    found = lg.stage_timing(frames(spark, sf), _STAGES)
    return found.select("run", "seq", "stage", r6("mean_s"), r6("p95_s"), r6("max_s"))


def config(spark, sf):
    """Part columns as configuration entries; numbers in the fixed text form."""
    part = table(spark, sf, "part")
    entries = F.array(
        F.struct(F.lit("tracker.brand").alias("key"), F.col("p_brand").alias("value")),
        F.struct(F.lit("solver.sigma").alias("key"), tx.g17(F.col("p_retailprice") / 7).alias("value")),
        F.struct(F.lit("window.size").alias("key"), F.col("p_size").cast("string").alias("value")),
        F.struct(
            F.lit("enable.cull").alias("key"),
            F.when(F.col("p_size") % 2 == 0, "true").otherwise("false").alias("value"),
        ),
    )
    return part.select(F.col("p_partkey").alias("run"), F.explode(entries).alias("e")).select(
        "run", "e.key", "e.value"
    )


_CANONICAL = (
    "SELECT p_partkey AS run, concat('enable.cull=', CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false'"
    " END, chr(10), 'solver.sigma=', printf('%.17g', p_retailprice / 7), chr(10), 'tracker.brand=',"
    " p_brand, chr(10), 'window.size=', CAST(p_size AS VARCHAR), chr(10)) AS text FROM part"
)


@query(
    "d19_config_hash",
    f"WITH canonical AS ({_CANONICAL}) SELECT run, text, substr(lpad(lower(to_hex(CAST(list_reduce("
    "list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(text) + 1),"
    " lambda i: ascii(substr(text, CAST(i AS BIGINT), 1))::HUGEINT)),"
    " lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
    " AS UBIGINT))), 16, '0'), 1, 8) AS config_hash FROM canonical",
)
def config_hash(spark, sf):
    return lg.config_hash(config(spark, sf))


@query(
    "d20_suite_integrity",
    with_views("runs", ledger=_LEDGER)
    + "SELECT commit, count(*) AS runs, count(DISTINCT sequence) AS sequences,"
    " count(DISTINCT commit) AS commits, count(DISTINCT config) AS configs,"
    " count(*) FILTER (status LIKE 'completed%') AS completed,"
    " (SELECT count(DISTINCT sequence) FROM ledger) - count(DISTINCT sequence) AS missing,"
    " ((SELECT count(DISTINCT sequence) FROM ledger) = count(DISTINCT sequence)"
    " AND count(DISTINCT config) = 1) AS consistent FROM ledger GROUP BY commit",
)
def suite_integrity(spark, sf):
    rows = ledger(spark, sf)
    return lg.suite_integrity(rows, rows.select("sequence"), ["commit"])


@query(
    "d20_suite_statuses",
    with_views("runs", ledger=_LEDGER)
    + "SELECT commit, status, count(*) AS runs, count(*) / CAST(sum(count(*)) OVER (PARTITION BY commit) AS DOUBLE) AS share"
    " FROM ledger GROUP BY commit, status",
)
def suite_statuses(spark, sf):
    return lg.suite_statuses(ledger(spark, sf), ["commit"])


# A run's configuration: its label, a window that one sequence sets apart, nothing for runs with two warnings.
_RUN_KEY = "concat(sequence, '/', commit, '/', config)"
_WINDOW = "CASE WHEN segments % 5 = 4 THEN '12' ELSE '10' END"


@query(
    "d20_suite_texts",
    with_views("runs")
    + f"SELECT commit, config, count(*) AS runs, count(*) FILTER (warnings = 2) AS bare, count(DISTINCT text) AS texts,"
    " count(DISTINCT text) AS hashes, count(DISTINCT text) = 1 AND count(*) FILTER (warnings = 2) = 0 AS identical FROM"
    f" (SELECT *, CASE WHEN warnings <> 2 THEN concat('label=', config, chr(10), 'window=', {_WINDOW}, chr(10)) END AS text FROM v_runs)"
    " GROUP BY commit, config",
)
def suite_texts(spark, sf):
    runs = view(spark, sf, "runs").withColumn("run", F.expr(_RUN_KEY))
    entries = F.array(F.struct(F.lit("window").alias("key"), F.expr(_WINDOW).alias("value")), F.struct(F.lit("label").alias("key"), F.col("config").alias("value")))
    config_rows = runs.where("warnings <> 2").select("run", F.explode(entries).alias("e")).select("run", "e.*")
    return lg.suite_texts(runs.select("commit", "config", "run"), config_rows, ["commit", "config"])


_POSE_ROW = "seq, ts_ns, tx, ty, tz, qx, qy, qz, qw"


@query(
    "d21_artifact_identity",
    with_views("est", "est_b")
    + f", changed AS (SELECT seq FROM (SELECT {_POSE_ROW} FROM v_est EXCEPT SELECT {_POSE_ROW} FROM"
    f" v_est_b) UNION SELECT seq FROM (SELECT {_POSE_ROW} FROM v_est_b EXCEPT SELECT {_POSE_ROW}"
    " FROM v_est)) SELECT a.seq, left_n, right_n, left_n = right_n AND a.seq NOT IN"
    " (SELECT seq FROM changed) AS identical FROM (SELECT seq, count(*) AS left_n FROM v_est"
    " GROUP BY seq) a JOIN (SELECT seq, count(*) AS right_n FROM v_est_b GROUP BY seq) b USING (seq)",
)
def artifact_identity(spark, sf):
    columns = ["ts_ns", "tx", "ty", "tz", "qx", "qy", "qz", "qw"]
    return lg.artifact_identity(view(spark, sf, "est"), view(spark, sf, "est_b"), ["seq"], columns)


_BINS = (
    "SELECT seq, id, count(*) AS length FROM v_obs GROUP BY seq, id"
)


@query(
    "d22_histogram",
    with_views("obs", tracks=_BINS)
    + ", limits AS (SELECT seq, least(50, greatest(10, max(length))) AS bins,"
    " CASE WHEN min(length) = max(length) THEN min(length) - 0.5 ELSE min(length) END::DOUBLE AS lo,"
    " CASE WHEN min(length) = max(length) THEN max(length) + 0.5 ELSE max(length) END::DOUBLE AS hi"
    " FROM tracks GROUP BY seq) SELECT seq, bin, "
    + s6("any_value(lo + bin * (hi - lo) / bins)", "edge")
    + ", count(*) AS n FROM (SELECT *, CAST(least(floor((length - lo) / ((hi - lo) / bins)), bins - 1)"
    " AS BIGINT) AS bin FROM tracks JOIN limits USING (seq)) GROUP BY seq, bin",
)
def histogram(spark, sf):
    from posequery.operators.tracks import track_lifetable

    found = lg.histogram(track_lifetable(view(spark, sf, "obs")), ["seq"], "length")
    return found.withColumn("edge", r6("edge"))


@query(
    "d24_anchor_jumps",
    with_views("frames")
    + ", steps AS (SELECT run, seq, sqrt(power(tx - lag(tx) OVER w, 2) + power(ty - lag(ty) OVER w, 2)"
    " + power(tz - lag(tz) OVER w, 2)) AS step FROM v_frames WHERE status = 'ok'"
    " WINDOW w AS (PARTITION BY run, seq ORDER BY frame))"
    " SELECT run, seq, count(*) FILTER (step > 5) AS jumps,"
    f" {s6('coalesce(avg(step) FILTER (step > 5), 0)', 'mean_jump_m')} FROM steps GROUP BY run, seq",
)
def anchor_jumps(spark, sf):
    found = lg.anchor_jumps(frames(spark, sf))
    return found.withColumn("mean_jump_m", r6("mean_jump_m"))


NOMINAL_NS, LONG_NS = 600_000_000_000, 5_400_000_000_000


@query(
    "d25_stream_gaps",
    with_views("left")
    + ", spaced AS (SELECT seq, ts_ns, lag(ts_ns) OVER w AS prev_ns, row_number() OVER w AS position"
    " FROM v_left WINDOW w AS (PARTITION BY seq ORDER BY ts_ns)), numbered AS (SELECT *,"
    " position - row_number() OVER (PARTITION BY seq ORDER BY ts_ns) AS island FROM spaced"
    f" WHERE ts_ns - prev_ns > {LONG_NS}) SELECT seq, min(prev_ns) AS from_ns, max(ts_ns) AS to_ns,"
    f" count(*) AS intervals, CAST(sum(round((ts_ns - prev_ns) / {NOMINAL_NS}e0) - 1) AS BIGINT)"
    " AS missing FROM numbered GROUP BY seq, island",
)
def stream_gaps(spark, sf):
    return lg.stream_gaps(view(spark, sf, "left"), ["seq"], NOMINAL_NS, LONG_NS, CHUNK_NS)


@query(
    "d27_suite_average",
    with_views("runs", ledger=_LEDGER)
    + f"SELECT commit, config, count(ate) AS evaluated, {s6('avg(ate)', 'mean_ate')},"
    f" {s6('''avg(ate) FILTER (status LIKE 'completed%')''', 'mean_ate_completed')}"
    " FROM ledger GROUP BY commit, config",
)
def suite_average(spark, sf):
    found = lg.suite_average(ledger(spark, sf), ["commit", "config"])
    return found.withColumn("mean_ate", r6("mean_ate")).withColumn(
        "mean_ate_completed", r6("mean_ate_completed")
    )


def _share(condition: str, name: str) -> str:
    return s6(f"avg(CASE WHEN {condition} THEN 1e0 ELSE 0e0 END)", name)


@query(
    "d28_frontend_health",
    with_views("frames")
    + f"SELECT run, seq, {s6('quantile_cont(num_obs, 0.5)', 'median_obs')},"
    f" {_share('num_obs < 50', 'low_obs_share')}, {_share('num_shared < 10', 'low_shared_share')},"
    " count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'failed') AS failed, "
    + _share("status = 'ok' AND num_shared > 0 AND NOT pnp_success", "fallback_share")
    + " FROM v_frames GROUP BY run, seq",
)
def frontend_health(spark, sf):
    found = lg.frontend_health(frames(spark, sf))
    doubles = [n for n, t in found.dtypes if t == "double"]
    return found.select([r6(c) if c in doubles else F.col(c) for c in found.columns])


@query(
    "d30_cull_size_histogram",
    with_views("frames")
    + "SELECT run, seq, outliers_culled, count(*) AS frames FROM v_frames GROUP BY ALL",
)
def cull_histogram(spark, sf):
    return lg.cull_size_histogram(frames(spark, sf))


@query(
    "e11_run_divergence",
    with_views("est", "est_b")
    + ", apart AS (SELECT a.seq, a.ts_ns, sqrt(power(a.tx - b.tx, 2) + power(a.ty - b.ty, 2)"
    " + power(a.tz - b.tz, 2)) AS d FROM v_est a JOIN v_est_b b USING (seq, ts_ns))"
    f" SELECT seq, first_ns, ts_ns, {s6('d', 'apart_m')} FROM apart JOIN (SELECT seq,"
    " min(ts_ns) FILTER (d > 0) AS first_ns FROM apart GROUP BY seq) USING (seq) WHERE ts_ns >= first_ns",
)
def run_divergence(spark, sf):
    found = lg.run_divergence(view(spark, sf, "est"), view(spark, sf, "est_b"))
    return found.withColumn("apart_m", r6("apart_m"))


@query(
    "f6_ledger_sort",
    with_views("runs") + "SELECT sequence, commit, config FROM v_runs",
)
def ledger_sort(spark, sf):
    return lg.ledger_sort(view(spark, sf, "runs").select("sequence", "commit", "config"))


def _summaries(spark, sf):
    """Ledger rows as the JSON text of their summary files, some of it broken."""
    rows = ledger(spark, sf)
    summary = F.to_json(
        F.struct(
            "status",
            "sequence",
            F.struct(F.col("commit").alias("git_commit_short"), F.col("dirty").alias("git_dirty")).alias("code"),
            F.lit("cfg").alias("config_label"),
            F.col("config").alias("config_hash"),
            F.struct(
                F.col("completion").alias("completion_rate"),
                F.when(F.col("cents_odd"), F.lit("n/a")).otherwise(F.col("segments").cast("string")).alias("segments"),
            ).alias("trajectory"),
            F.struct(F.struct(F.col("ate").alias("rmse")).alias("trans")).alias("ate"),
            F.struct(F.struct(F.col("rpe").alias("rmse")).alias("trans")).alias("rpe"),
            F.struct("reanchors").alias("robustness"),
            F.struct("wall_s").alias("timing"),
        )
    )
    text = F.when(F.col("warnings") == 2, F.concat(F.lit("["), summary, F.lit("]"))).otherwise(summary)
    return rows.withColumn("cents_odd", F.col("frames") % 2 == 1).select(
        F.concat_ws("/", "sequence", "commit", "config", F.lit("summary.json")).alias("path"), text.alias("value")
    )


_TABLE = (
    "SELECT sequence, commit, CASE WHEN dirty THEN 'yes' ELSE 'no' END AS dirty,"
    " concat('cfg_', config) AS config, status,"
    + ",".join(
        f" coalesce(printf('%.6g', {c}), '') AS {n}"
        for c, n in (("ate", "ate_trans_rmse"), ("rpe", "rpe_trans_rmse"), ("completion", "completion_rate"))
    )
    + ", '' AS coverage_rate, CASE WHEN frames % 2 = 1 THEN '' ELSE CAST(segments AS VARCHAR) END"
    " AS segments, CAST(reanchors AS VARCHAR) AS reanchors, '' AS rtf, printf('%.6g', wall_s) AS wall_s"
    " FROM ledger WHERE warnings <> 2"
)


@query("a15_bench_table", with_views("runs", ledger=_LEDGER) + _TABLE)
def bench_table(spark, sf):
    rows, _ = rn.parse_summaries(_summaries(spark, sf))
    return rn.bench_table(rows)


@query(
    "a15_bench_table_markdown",
    with_views("runs", ledger=_LEDGER, t=_TABLE)
    + "SELECT concat('| ', " + ", ' | ', ".join(rn.TABLE_COLUMNS) + ", ' |') AS value FROM t",
)
def bench_markdown(spark, sf):
    rows, _ = rn.parse_summaries(_summaries(spark, sf))
    return rn.markdown_lines(rn.bench_table(rows))


@query(
    "a14_write_run_ledger",
    with_views("runs")
    + "SELECT sequence, commit, config, CASE WHEN reanchors = 3 AND config = '5' THEN 'invalid_key'"
    " WHEN segments % 2 <> 0 THEN 'write' WHEN dirty THEN 'overwrite_with_warning' ELSE 'refuse' END"
    " AS decision FROM v_runs",
)
def ledger_write(spark, sf):
    from posequery.session import fresh_path

    runs = view(spark, sf, "runs").select(
        "sequence",
        "commit",
        "config",
        "dirty",
        "segments",
        "ate",
        F.lit("cfg").alias("config_label"),
        F.when((F.col("reanchors") == 3) & (F.col("config") == "5"), "").otherwise(F.col("config")).alias("config_hash"),
    )
    path = fresh_path(spark, "ledger")
    incoming = runs.drop("config", "segments")
    rn.write_run_ledger(incoming.where(runs["segments"] % 2 == 0), path)
    keyed = runs.withColumnRenamed("config", "original").drop("segments")
    plan = rn.write_run_ledger(keyed, path)
    return plan.select("sequence", "commit", F.col("original").alias("config"), "decision")
