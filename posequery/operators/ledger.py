"""Run diagnostics and the ledger of runs: counts, status, comparison, identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posequery.functions import geometry as g
from posequery.functions.stats import ratio
from posequery.functions.text import fnv1a64_hex
from posequery.operators.tracks import FRAMES
from posequery.plans.ordered import Scan, ordered_scan
from posequery.plans.quantiles import exact_quantiles
from posequery.session import cut

RUN = ["run", "seq"]
# Rejection messages that count as failed seeding.
SEED_REJECTIONS = [
    "insufficient observations to seed new segment",
    "insufficient observations to seed first segment",
]


def run_status(
    has_trajectory: Column,
    has_groundtruth: Column,
    has_ate: Column,
    has_rpe: Column,
    failed_frames: Column,
    warnings: Column,
) -> Column:
    return (
        F.when(~has_trajectory, "failed")
        .when(~(has_groundtruth & has_ate & has_rpe), "eval_failed")
        .when(failed_frames > 0, "completed_with_failures")
        .when(warnings > 0, "completed_with_warnings")
        .otherwise("completed")
    )


def _with_reanchor(frames: DataFrame, width: int) -> DataFrame:
    """Frames with ``reanchor``: the segment grew since the last accepted frame."""
    ok = F.col("status") == "ok"
    seen = ordered_scan(
        frames,
        RUN,
        ["frame"],
        width,
        last_segment=Scan("last_before", F.when(ok, F.col("segment_id"))),
    )
    grew = ok & F.coalesce(F.col("segment_id") > F.col("last_segment"), F.lit(False))
    return seen.withColumn("reanchor", grew)


def frame_counts(frames: DataFrame, width: int = FRAMES, culls: DataFrame | None = None, pnp_init: bool = True) -> DataFrame:
    """Counters of a run over its diagnostics.

    With ``culls`` (``run, seq, frame, id``) come ``outliers_culled_unique``, ids that a run culled at
    least once, and ``outlier_reopts``, the sum of the frames' ``outlier_reopt_rounds``.  Where a run was made
    without starting from PnP (``pnp_init``), nothing falls back and ``pnp_fallbacks`` is 0.
    """
    ok = F.col("status") == "ok"

    def total(name: str) -> Column:
        return F.sum(name).cast("long").alias(name)

    counts = (
        _with_reanchor(frames, width)
        .groupBy(*RUN)
        .agg(
            F.count(F.lit(1)).alias("image_frames"),
            *[
                F.count_if(F.col("status") == s).alias(s)
                for s in ("ok", "rejected", "failed")
            ],
            F.count_if("low_connectivity").alias("low_connectivity"),
            F.count_if("is_keyframe").alias("total_keyframes"),
            F.count_if(~F.col("is_keyframe")).alias("total_track_only_frames"),
            F.count_if(
                (F.col("status") == "rejected") & F.col("message").isin(SEED_REJECTIONS)
            ).alias("seed_rejected"),
            F.count_if(ok & F.col("pnp_success")).alias("pnp_successes"),
            F.count_if(
                F.lit(pnp_init) & ok & (F.col("num_shared") > 0) & ~F.col("pnp_success") & ~F.col("reanchor")
            ).alias("pnp_fallbacks"),
            total("outliers_culled"),
            total("num_cheirality"),
            *([] if culls is None else [F.coalesce(F.sum("outlier_reopt_rounds"), F.lit(0)).cast("long").alias("outlier_reopts")]),
        )
    )
    if culls is None:
        return counts
    unique = culls.select(*RUN, "id").distinct().groupBy(*RUN).agg(F.count(F.lit(1)).alias("outliers_culled_unique"))
    return counts.join(unique, RUN, "left").na.fill(0, ["outliers_culled_unique"])


def segment_summary(frames: DataFrame, width: int = FRAMES) -> DataFrame:
    """Re-anchors, segments and seed rejections of a run."""
    ok = F.col("status") == "ok"
    rejected = F.col("status") == "rejected"
    reanchors = F.count_if("reanchor")
    return (
        _with_reanchor(frames, width)
        .groupBy(*RUN)
        .agg(
            reanchors.alias("reanchors"),
            F.when(F.bool_or(ok), reanchors + 1)
            .otherwise(F.lit(0).cast("long"))
            .alias("segments"),
            *[
                F.count_if(rejected & (F.col("message") == text)).alias(name)
                for text, name in zip(
                    SEED_REJECTIONS, ("seed_rejected_new", "seed_rejected_first"), strict=True
                )
            ],
            F.min(F.when(F.col("reanchor"), F.col("frame"))).alias("first_reanchor"),
        )
    )


def completion(frames: DataFrame) -> DataFrame:
    """Completion rate, coverage rate and real-time factor of a run.

    ``wall_s`` is the summed time of the frames; the factor is null without it.
    """
    ok = F.col("status") == "ok"
    stamp = F.col("ts_ns")
    spans = frames.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(ok).alias("ok"),
        (F.max(stamp) - F.min(stamp)).alias("image_span_ns"),
        (F.max(F.when(ok, stamp)) - F.min(F.when(ok, stamp))).alias("pose_span_ns"),
        F.sum("wall_s").alias("wall_s"),
    )
    span_s = F.col("image_span_ns") * 1e-9
    return spans.select(
        *RUN,
        ratio(F.col("ok"), F.col("frames")).alias("completion_rate"),
        ratio(
            F.coalesce("pose_span_ns", F.lit(0).cast("long")), F.col("image_span_ns")
        ).alias("coverage_rate"),
        F.when((F.col("wall_s") > 0) & (span_s > 0), span_s / F.col("wall_s")).alias("rtf"),
    )


def stage_timing(frames: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Mean, 95th percentile and maximum of each stage of a run."""
    stacked = frames.select(
        *RUN,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(s).alias("stage"), F.col(f"{s}_s").alias("seconds"))
                    for s in stages
                ]
            )
        ).alias("m"),
    ).select(*RUN, "m.stage", "m.seconds")
    keys = [*RUN, "stage"]
    totals = stacked.groupBy(*keys).agg(
        F.avg("seconds").alias("mean_s"), F.max("seconds").alias("max_s")
    )
    return totals.join(exact_quantiles(stacked, keys, "seconds", {"p95_s": 0.95}), keys, "left")


def canonical_text(config: DataFrame) -> DataFrame:
    """Sorted ``key=value`` lines of each run.  ``value`` is text already formatted."""
    entries = F.array_sort(F.collect_list(F.struct("key", "value")))
    return config.groupBy("run").agg(
        F.array_join(
            F.transform(
                entries, lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit("\n"))
            ),
            "",
        ).alias("text")
    )


def config_hash(config: DataFrame) -> DataFrame:
    """First eight hex digits of the hash of the canonical text."""
    return canonical_text(config).select(
        "run", "text", F.substring(fnv1a64_hex(F.col("text")), 1, 8).alias("config_hash")
    )


def suite_statuses(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``status, runs, share`` for each status that occurs in a suite (``keys``)."""
    counts = runs.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("runs"))
    totals = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    return counts.join(totals, list(keys)).select(*keys, "status", "runs", (F.col("runs") / F.col("_all")).alias("share"))


def suite_texts(runs: DataFrame, config: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether all runs of a suite (``keys``) were made with one canonical configuration text, to the byte.

    ``runs`` hold the suite's keys and ``run``, ``config`` the entries ``run, key, value``.  A run without
    entries is ``bare`` and spoils the suite, as texts that differ do; ``hashes`` counts their short hashes,
    which must be as many as the texts.
    """
    texts = config_hash(config)
    return (
        runs.select(*keys, "run")
        .join(texts, "run", "left")
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.count_if(F.col("text").isNull()).alias("bare"),
            F.count_distinct("text").alias("texts"),
            F.count_distinct("config_hash").alias("hashes"),
        )
        .withColumn("identical", (F.col("texts") == 1) & (F.col("bare") == 0))
    )


def suite_integrity(runs: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per suite (``keys``): sequences present and missing, code and config ids, statuses."""
    suites = runs.select(*keys).distinct()
    wanted = expected.select("sequence").distinct()
    total = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_distinct("sequence").alias("sequences"),
        F.count_distinct("commit").alias("commits"),
        F.count_distinct("config").alias("configs"),
        F.count_if(F.col("status").startswith("completed")).alias("completed"),
    )
    present = (
        runs.select(*keys, "sequence")
        .distinct()
        .join(wanted, "sequence", "left_semi")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("present"))
    )
    size = wanted.agg(F.count(F.lit(1)).alias("expected")).scalar()
    return (
        suites.join(total, list(keys))
        .join(present, list(keys), "left")
        .select(
            *keys,
            "runs",
            "sequences",
            "commits",
            "configs",
            "completed",
            (size - F.coalesce("present", F.lit(0).cast("long"))).alias("missing"),
        )
        .withColumn(
            "consistent",
            (F.col("missing") == 0) & (F.col("commits") == 1) & (F.col("configs") == 1),
        )
    )


def artifact_digest(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Order-free digest of each group: row count and combined row hashes.

    Both hash aggregates merge on the map side, so a group of any size stays cheap.
    """
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64(*columns)).alias("digest_xor"),
        F.sum(F.xxhash64(F.lit("second"), *columns).bitwiseAND(F.lit((1 << 31) - 1))).alias(
            "digest_sum"
        ),
    )


def artifact_identity(
    left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Whether two runs hold the same rows, per group."""
    a = artifact_digest(left, keys, columns)
    b = artifact_digest(right, keys, columns)
    for name in ("n", "digest_xor", "digest_sum"):
        a = a.withColumnRenamed(name, f"left_{name}")
        b = b.withColumnRenamed(name, f"right_{name}")
    same = F.lit(True)
    for name in ("n", "digest_xor", "digest_sum"):
        same = same & F.col(f"left_{name}").eqNullSafe(F.col(f"right_{name}"))
    return a.join(b, list(keys), "full_outer").select(
        *keys,
        F.coalesce("left_n", F.lit(0).cast("long")).alias("left_n"),
        F.coalesce("right_n", F.lit(0).cast("long")).alias("right_n"),
        same.alias("identical"),
    )


def compare_checkpoints(ledger: DataFrame, lineage: DataFrame) -> DataFrame:
    """Each run beside its predecessor by declared lineage, with deltas and a verdict.

    ``lineage`` maps ``commit`` to ``predecessor``; a run without one is kept with nulls.
    """
    past = ledger.select(
        "sequence",
        "config",
        F.col("commit").alias("predecessor"),
        *[
            F.col(c).alias(f"prev_{c}")
            for c in ("ate", "rpe", "completion", "segments", "reanchors", "failed")
        ],
    )
    joined = ledger.join(lineage, "commit").join(
        past, ["sequence", "config", "predecessor"], "left"
    )
    change = F.col("ate") - F.col("prev_ate")
    return joined.select(
        "sequence",
        "config",
        "commit",
        "predecessor",
        *[
            (F.col(c) - F.col(f"prev_{c}")).alias(f"delta_{c}")
            for c in ("ate", "rpe", "completion", "segments", "reanchors", "failed")
        ],
        F.when(F.col("prev_ate") != 0, 100.0 * change / F.col("prev_ate")).alias("ate_percent"),
        F.when(F.col("prev_ate").isNull() | F.col("ate").isNull(), "incomparable")
        .when(change < 0, "improved")
        .when(change > 0, "regressed")
        .otherwise("unchanged")
        .alias("verdict"),
    )


def quality_gates(ledger: DataFrame, anchors: DataFrame, compared: DataFrame) -> DataFrame:
    """Hard gate against an anchor ATE without re-anchoring; soft gate against the predecessor."""
    keys = ["sequence", "config", "commit"]
    hard = (F.col("ate") <= F.col("anchor_ate")) & (F.col("reanchors") == 0)
    return (
        ledger.select(*keys, "ate", "reanchors")
        .join(anchors, "sequence")
        .join(compared.select(*keys, "delta_ate"), keys, "left")
        .select(
            *keys,
            F.coalesce(hard, F.lit(False)).alias("hard_pass"),
            F.coalesce(F.col("delta_ate") < 0, F.lit(False)).alias("soft_pass"),
        )
    )


def suite_average(ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean ATE over all sequences of a suite and over the completed ones."""
    return ledger.groupBy(*keys).agg(
        F.count("ate").alias("evaluated"),
        F.avg("ate").alias("mean_ate"),
        F.avg(F.when(F.col("status").startswith("completed"), F.col("ate"))).alias(
            "mean_ate_completed"
        ),
    )


def frontend_health(frames: DataFrame, min_obs: int = 50, min_shared: int = 10) -> DataFrame:
    """Median observations and the shares of weak frames of a run."""
    ok = F.col("status") == "ok"

    def share(condition: Column) -> Column:
        return F.avg(F.when(condition, 1.0).otherwise(0.0))

    totals = frames.groupBy(*RUN).agg(
        share(F.col("num_obs") < min_obs).alias("low_obs_share"),
        share(F.col("num_shared") < min_shared).alias("low_shared_share"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        share(ok & (F.col("num_shared") > 0) & ~F.col("pnp_success")).alias("fallback_share"),
    )
    middle = exact_quantiles(frames, RUN, "num_obs", {"median_obs": 0.5})
    return totals.join(middle, RUN, "left")


def cull_size_histogram(frames: DataFrame) -> DataFrame:
    return frames.groupBy(*RUN, "outliers_culled").agg(F.count(F.lit(1)).alias("frames"))


def histogram(
    rows: DataFrame, keys: Sequence[str], value: str, bins: int | None = None
) -> DataFrame:
    """Equal-width histogram per group over its own range, the last bin closed.

    Without ``bins`` their number is the largest value, at least 10 and at most 50.
    A single-valued group spans half a unit on either side.
    """
    # Equal values are one row with a count before they meet their group's limits.
    rows = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w"))
    limits = rows.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    count = (
        F.lit(bins)
        if bins is not None
        else F.least(F.lit(50), F.greatest(F.lit(10), F.floor("hi").cast("int")))
    )
    flat = F.col("lo") == F.col("hi")
    limits = limits.select(
        *keys,
        count.alias("bins"),
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).cast("double").alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).cast("double").alias("hi"),
    )
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    index = F.least(F.floor((F.col(value) - F.col("lo")) / width), F.col("bins") - 1)
    return (
        rows.join(limits, list(keys))
        .groupBy(*keys, "bins", "lo", "hi", index.cast("long").alias("bin"))
        .agg(F.sum("_w").alias("n"))
        .select(
            *keys,
            "bin",
            (F.col("lo") + F.col("bin") * width).alias("edge"),
            "n",
        )
    )


def extent(poses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bounds of the positions, their centre and the equal-aspect radius."""
    axes = ["tx", "ty", "tz"]
    bounds = poses.groupBy(*keys).agg(
        *[F.min(a).alias(f"min_{a}") for a in axes], *[F.max(a).alias(f"max_{a}") for a in axes]
    )
    return bounds.select(
        "*",
        *[((F.col(f"min_{a}") + F.col(f"max_{a}")) / 2).alias(f"centre_{a}") for a in axes],
        (F.greatest(*[F.col(f"max_{a}") - F.col(f"min_{a}") for a in axes]) / 2).alias("radius"),
    )


def anchor_jumps(frames: DataFrame, threshold_m: float = 5.0, width: int = FRAMES) -> DataFrame:
    """Steps between accepted poses above a threshold: count and mean."""
    accepted = frames.where(F.col("status") == "ok").select(*RUN, "frame", "tx", "ty", "tz")
    before = ordered_scan(
        accepted, RUN, ["frame"], width, prev=Scan("lag", F.struct("tx", "ty", "tz"))
    )
    step = g.length(
        g.subtract(
            g.Vec(*[F.col(c) for c in ("tx", "ty", "tz")]),
            g.Vec(*[F.col(f"prev.{c}") for c in ("tx", "ty", "tz")]),
        )
    )
    steps = before.select(*RUN, step.alias("step_m"))
    jump = F.when(F.col("step_m") > threshold_m, F.col("step_m"))
    return steps.groupBy(*RUN).agg(
        F.count(jump).alias("jumps"),
        F.coalesce(F.avg(jump), F.lit(0.0)).alias("mean_jump_m"),
    )


def stream_gaps(
    stamps: DataFrame,
    keys: Sequence[str],
    nominal_ns: int,
    threshold_ns: int,
    width_ns: int,
) -> DataFrame:
    """Runs of successive intervals longer than a threshold, with the samples they lack."""
    keys = list(keys)
    one = F.lit(1).cast("long")
    spaced = ordered_scan(
        stamps.select(*keys, "ts_ns"),
        keys,
        ["ts_ns"],
        width_ns,
        once=True,
        prev_ns=Scan("lag", F.col("ts_ns")),
        position=Scan("sum", one),
    )
    interval = F.col("ts_ns") - F.col("prev_ns")
    # The few long intervals are written, so that numbering them does not scan the stream again.
    long_ones = cut(spaced.where(interval > threshold_ns).withColumn("interval_ns", interval), "gaps")
    numbered = ordered_scan(
        long_ones, keys, ["ts_ns"], width_ns, nth=Scan("sum", one)
    ).withColumn("island", F.col("position") - F.col("nth"))
    lacking = F.round(F.col("interval_ns") / F.lit(nominal_ns)) - 1
    return (
        numbered.groupBy(*keys, "island")
        .agg(
            F.min("prev_ns").alias("from_ns"),
            F.max("ts_ns").alias("to_ns"),
            F.count(F.lit(1)).alias("intervals"),
            F.sum(lacking).cast("long").alias("missing"),
        )
        .drop("island")
    )


def first_divergence(frames: DataFrame, max_shift_m: float = 0.5, width: int = FRAMES) -> DataFrame:
    """First frame with a large shift, first failed frame, first change of segment."""
    seen = _with_reanchor(frames, width)
    frame = F.col("frame")
    return seen.groupBy(*RUN).agg(
        F.min(F.when(F.col("max_window_pose_shift_m") > max_shift_m, frame)).alias("first_shift"),
        F.min(F.when(F.col("status") == "failed", frame)).alias("first_failed"),
        F.min(F.when(F.col("reanchor"), frame)).alias("first_segment_change"),
    )


def _raw_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    columns = ["tx", "ty", "tz"]
    left = a.select("seq", "ts_ns", *columns)
    right = b.select("seq", "ts_ns", *[F.col(c).alias(f"other_{c}") for c in columns])
    apart = g.length(
        g.subtract(
            g.Vec(*[F.col(c) for c in columns]),
            g.Vec(*[F.col(f"other_{c}") for c in columns]),
        )
    )
    return left.join(right, ["seq", "ts_ns"]).select("seq", "ts_ns", apart.alias("apart_m"))


def run_divergence(a: DataFrame, b: DataFrame, epsilon_m: float = 0.0) -> DataFrame:
    """Rows from the first stamp on where two runs' raw positions differ, with the distance."""
    apart = _raw_distance(a, b)
    first = apart.groupBy("seq").agg(
        F.min(F.when(F.col("apart_m") > epsilon_m, F.col("ts_ns"))).alias("first_ns")
    )
    return (
        apart.join(first, "seq")
        .where(F.col("ts_ns") >= F.col("first_ns"))
        .select("seq", "first_ns", "ts_ns", "apart_m")
    )


def errors_with_diag(errors: DataFrame, diag: DataFrame) -> DataFrame:
    """Per-sample errors beside the diagnostics of their frame; ``has_diag`` marks gaps."""
    keys = ["run", "seq", "ts_ns"]
    return errors.join(
        diag.withColumn("has_diag", F.lit(True)), keys, "left"
    ).withColumn("has_diag", F.coalesce("has_diag", F.lit(False)))


def elapsed_seconds(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Seconds since the first stamp of the group; the difference is taken in integers."""
    start = rows.groupBy(*keys).agg(F.min("ts_ns").alias("start_ns"))
    return (
        rows.join(start, list(keys))
        .withColumn("elapsed_s", (F.col("ts_ns") - F.col("start_ns")) * 1e-9)
        .drop("start_ns")
    )


def merge_replay_order(streams: DataFrame, width_ns: int) -> DataFrame:
    """Events with their index in replay order: by stamp, then inertial, left, right."""
    return ordered_scan(
        streams,
        ["seq"],
        ["ts_ns", "rank"],
        width_ns,
        event_index=Scan("sum", F.lit(1).cast("long")),
    ).withColumn("event_index", F.col("event_index") - 1)


def limit_frames(frames: DataFrame, n: int) -> DataFrame:
    """The first ``n`` frames of each sequence, cut on the map side."""
    order = Window.partitionBy("seq").orderBy("ts_ns")
    return (
        frames.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")
    )


def ledger_sort(ledger: DataFrame) -> DataFrame:
    return ledger.orderBy("sequence", "commit", "config")
