"""Track and frame tables from observation rows ``seq, frame, id, u, v, disparity, status``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posequery.functions.camera import Rig, stereo_depth
from posequery.functions.stats import percentile_of_sorted, upper_median_of_sorted
from posequery.plans.ordered import Scan, ordered_scan
from posequery.plans.quantiles import exact_quantiles
from posequery.plans.spread import join_per_key
from posequery.session import cut

# Default chunk of a frame-ordered scan.
FRAMES = 4096
STATUSES = ["valid", "no_right_match", "invalid_disparity", "depth_out_of_range"]


def admit_observations(obs: DataFrame) -> DataFrame:
    """Valid rows with their disparity, unmatched rows of older tracks with zero, no others.

    ``length`` is the track length so far.
    """
    stable = (F.col("status") == "no_right_match") & (F.col("length") >= 2)
    valid = F.col("status") == "valid"
    return obs.where(valid | stable).withColumn(
        "disparity", F.when(valid, F.col("disparity")).otherwise(F.lit(0.0))
    )


def classify_stereo_match(
    rig: Rig,
    vertical_error: Column,
    disparity: Column,
    max_epipolar_px: float = 1.5,
    min_disparity_px: float = 2.0,
    min_depth_m: float = 0.3,
    max_depth_m: float = 25.0,
) -> Column:
    """Status and rejection cause of a right-image match, in the order of the checks."""
    depth = rig.fx * rig.baseline / F.when(disparity != 0, disparity)

    def outcome(status: str, cause: str | None) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(cause).cast("string").alias("cause"))

    return (
        F.when(
            F.abs(vertical_error) > max_epipolar_px, outcome("invalid_disparity", "epipolar")
        )
        .when(disparity <= min_disparity_px, outcome("invalid_disparity", "disparity"))
        .when(
            (depth < min_depth_m) | (depth > max_depth_m),
            outcome("depth_out_of_range", "depth"),
        )
        .otherwise(outcome("valid", None))
    )


def track_length(obs: DataFrame, width: int = FRAMES) -> DataFrame:
    """Observation rows with ``length``: the running count of their id."""
    return ordered_scan(
        obs, ["seq", "id"], ["frame"], width, length=Scan("sum", F.lit(1).cast("long"))
    )


def track_lifetable(obs: DataFrame) -> DataFrame:
    """First and last frame and number of observations per track."""
    return obs.groupBy("seq", "id").agg(
        F.min("frame").alias("first_frame"),
        F.max("frame").alias("last_frame"),
        F.count(F.lit(1)).alias("length"),
    )


def frame_stats(obs: DataFrame) -> DataFrame:
    """Counts by status, epipolar percentiles and track length summary per frame.

    A frame holds at most as many rows as the tracker has slots, so the percentiles
    are taken within one group.
    """
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    grouped = obs.groupBy("seq", "frame").agg(
        F.count(F.lit(1)).alias("tracks"),
        *counts,
        F.sort_array(F.collect_list("epipolar")).alias("_epipolar"),
        F.sort_array(F.collect_list("length")).alias("_length"),
        F.max("length").alias("track_length_max"),
    )
    return grouped.select(
        "seq",
        "frame",
        "tracks",
        *STATUSES,
        percentile_of_sorted(F.col("_epipolar"), 0.5).alias("epipolar_median_px"),
        percentile_of_sorted(F.col("_epipolar"), 0.95).alias("epipolar_p95_px"),
        upper_median_of_sorted(F.col("_length")).alias("track_length_median"),
        "track_length_max",
    )


def frontend_totals(frames: DataFrame) -> DataFrame:
    """Per sequence totals over the frame table of :func:`frame_stats`."""
    observed = F.sum("tracks")
    totals = frames.groupBy("seq").agg(
        F.count(F.lit(1)).alias("frames"),
        F.min("tracks").alias("min_tracks"),
        (observed / F.count(F.lit(1))).alias("mean_tracks"),
        *[
            F.when(observed > 0, F.sum(s) / observed).otherwise(F.lit(0.0)).alias(f"{s}_rate")
            for s in STATUSES
        ],
        observed.alias("observations"),
    )
    # Both metrics go through one pass, a row for each, told apart by a key.
    metrics = ["epipolar_median_px", "epipolar_p95_px"]
    stacked = frames.select("seq", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("px")) for m in metrics))).alias("m"))
    ranked = exact_quantiles(stacked.select("seq", "m.*"), ["seq", "metric"], "px", {"middle": 0.5, "high": 0.95})
    pick = lambda metric, column: F.max(F.when(F.col("metric") == metric, F.col(column))).alias(metric)
    return totals.join(ranked.groupBy("seq").agg(pick(metrics[0], "middle"), pick(metrics[1], "high")), "seq", "left")


def detector_totals(frames: DataFrame) -> DataFrame:
    """Per sequence sums of the frame file's ``detected``, ``tracked`` and ``fb_rejected``, and shares of them.

    ``rejected_share`` is what the check backwards took off the tracks that were tried,
    ``new_share`` what detection added to all tracks; null where nothing was counted.
    """
    names = ["tracked", "detected", "fb_rejected"]
    sums = [F.sum(n).cast("long").alias(n) for n in names]
    totals = frames.groupBy("seq").agg(F.count(F.lit(1)).alias("frames"), *sums)
    share = lambda part, *of: F.col(part) / F.nullif(sum(F.col(c) for c in of), F.lit(0))
    return totals.select("*", share("fb_rejected", "tracked", "fb_rejected").alias("rejected_share"), share("detected", "tracked", "detected").alias("new_share"))


def shared_landmarks(obs: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Per frame: stereo observations, and those whose id is a live landmark."""
    live = landmarks.select("seq", "id").distinct().withColumn("live", F.lit(True))
    return (
        obs.select("seq", "frame", "id", "disparity")
        .join(live, ["seq", "id"], "left")
        .groupBy("seq", "frame")
        .agg(
            F.count_if(F.col("disparity") > 0).alias("num_disparity"),
            F.count_if((F.col("disparity") > 0) & F.col("live")).alias("num_shared"),
        )
    )


def first_culled(culls: DataFrame) -> DataFrame:
    """The growing set of culled ids as a table of first culls."""
    return culls.groupBy("seq", "id").agg(F.min("frame").alias("first_cull"))


def zombie_tracks(obs: DataFrame, culls: DataFrame) -> DataFrame:
    """Observations of ids that were culled in an earlier frame."""
    return (
        obs.join(first_culled(culls), ["seq", "id"])
        .where(F.col("frame") > F.col("first_cull"))
        .select("seq", "frame", "id", "first_cull")
    )


def block_rebirth(candidates: DataFrame, culls: DataFrame) -> DataFrame:
    """Candidate rows whose id has never been culled up to their frame."""
    known = first_culled(culls)
    joined = candidates.join(known, ["seq", "id"], "left")
    return joined.where(
        F.col("first_cull").isNull() | (F.col("first_cull") >= F.col("frame"))
    ).drop("first_cull")


def distinct_culled(culls: DataFrame) -> DataFrame:
    """Total and distinct culled ids per sequence."""
    per_id = culls.groupBy("seq", "id").agg(F.count(F.lit(1)).alias("times"))
    return per_id.groupBy("seq").agg(
        F.sum("times").alias("culled"), F.count(F.lit(1)).alias("culled_unique")
    )


def median_flow(obs: DataFrame, min_tracks: int = 5, width: int = FRAMES) -> DataFrame:
    """Component-wise upper median of pixel displacement per frame, null when few tracks last."""
    before = ordered_scan(
        obs.select("seq", "id", "frame", "u", "v"),
        ["seq", "id"],
        ["frame"],
        width,
        prev=Scan("lag", F.struct("frame", "u", "v")),
    )
    moved = before.where(F.col("prev.frame") == F.col("frame") - 1).select(
        "seq",
        "frame",
        (F.col("u") - F.col("prev.u")).alias("du"),
        (F.col("v") - F.col("prev.v")).alias("dv"),
    )
    enough = F.col("survivors") >= min_tracks
    per_frame = moved.groupBy("seq", "frame").agg(
        F.count(F.lit(1)).alias("survivors"),
        F.sort_array(F.collect_list("du")).alias("_du"),
        F.sort_array(F.collect_list("dv")).alias("_dv"),
    )
    return per_frame.select(
        "seq",
        "frame",
        "survivors",
        F.when(enough, upper_median_of_sorted(F.col("_du"))).alias("flow_u"),
        F.when(enough, upper_median_of_sorted(F.col("_dv"))).alias("flow_v"),
    )


def presence_age(
    obs: DataFrame, marks: DataFrame, max_age: int = 5, width: int = FRAMES
) -> DataFrame:
    """Ages of marked ids while they stay present, frame after frame.

    A mark starts at age 1 and each following frame with the id adds one; an absent
    frame forgets it; at ``max_age`` the track is dropped.  Marks of a track that is
    already marked change nothing, so a run of presence (an island of ``frame -
    position``) is decided by its first mark.
    """
    if max_age < 1:
        raise ValueError("max_age must be at least 1")
    marked = obs.select("seq", "id", "frame").join(
        marks.select("seq", "id", "frame").distinct().withColumn("mark", F.lit(True)),
        ["seq", "id", "frame"],
        "left",
    )
    placed = ordered_scan(
        marked, ["seq", "id"], ["frame"], width, position=Scan("sum", F.lit(1).cast("long"))
    ).withColumn("island", F.col("frame") - F.col("position"))
    islands = (
        placed.groupBy("seq", "id", "island")
        .agg(
            F.min(F.when(F.col("mark"), F.col("frame"))).alias("first_mark"),
            F.max("frame").alias("last_frame"),
        )
        .where(F.col("first_mark").isNotNull())
    )
    until = F.least("last_frame", F.col("first_mark") + F.lit(max_age - 1))
    aged = islands.select(
        "seq", "id", "first_mark", F.explode(F.sequence("first_mark", until)).alias("frame")
    )
    age = F.col("frame") - F.col("first_mark") + 1
    return aged.select("seq", "id", "frame", age.alias("age"), (age >= max_age).alias("dropped"))


def zombie_age_counts(ages: DataFrame) -> DataFrame:
    """Frames with an age drop, and dropped ids, per sequence."""
    per_frame = (
        ages.where("dropped").groupBy("seq", "frame").agg(F.count(F.lit(1)).alias("ids"))
    )
    return per_frame.groupBy("seq").agg(
        F.count(F.lit(1)).alias("zombie_age_drops"), F.sum("ids").alias("zombie_age_drop_ids")
    )


def keyframe_links(frames: DataFrame, width: int = FRAMES) -> DataFrame:
    """Frames with ``kf_frame``: the latest accepted keyframe before each frame."""
    accepted = F.col("is_keyframe") & (F.col("status") == "ok")
    return ordered_scan(
        frames,
        ["seq"],
        ["frame"],
        width,
        kf_frame=Scan("last_before", F.when(accepted, F.col("frame"))),
    )


def keyframe_snapshot(obs: DataFrame, links: DataFrame) -> DataFrame:
    """Observations of a frame beside those of its last keyframe, by id.

    ``links`` is ``seq, frame, kf_frame`` and may carry further columns.
    """
    current = obs.select("seq", "frame", "id", "u", "v").join(
        links.where(F.col("kf_frame").isNotNull()), ["seq", "frame"]
    )
    past = obs.select(
        "seq",
        F.col("frame").alias("kf_frame"),
        "id",
        F.col("u").alias("kf_u"),
        F.col("v").alias("kf_v"),
    )
    return current.join(past, ["seq", "kf_frame", "id"])


def survival_ratio(obs: DataFrame, links: DataFrame) -> DataFrame:
    """Share of the last keyframe's ids still present, per frame."""
    sizes = obs.groupBy("seq", "frame").agg(F.count(F.lit(1)).alias("size"))
    common = (
        keyframe_snapshot(obs, links.select("seq", "frame", "kf_frame"))
        .groupBy("seq", "frame")
        .agg(F.count(F.lit(1)).alias("common"))
    )
    kept = F.coalesce("common", F.lit(0).cast("long"))
    return (
        links.select("seq", "frame", "kf_frame")
        .where(F.col("kf_frame").isNotNull())
        .join(common, ["seq", "frame"], "left")
        .join(
            sizes.select("seq", F.col("frame").alias("kf_frame"), "size"),
            ["seq", "kf_frame"],
            "left",
        )
        .select(
            "seq",
            "frame",
            "kf_frame",
            kept.alias("common"),
            (kept / F.greatest(F.coalesce("size", F.lit(0).cast("long")), F.lit(1))).alias(
                "survival"
            ),
        )
    )


def window_members(
    frames: DataFrame, max_frames: int = 10, max_keyframes: int = 7, width: int = FRAMES
) -> DataFrame:
    """Frames held by the sliding window after each accepted frame.

    The oldest keyframe leaves beyond ``max_keyframes``, then the oldest non-keyframe
    beyond ``max_frames``.  So the window is the latest ``k <= max_keyframes``
    keyframes and the latest ``max_frames - k`` others, and members are found by
    counting: each frame asks for at most ``max_frames`` positions of its sequence.
    ``frames`` are accepted rows ``seq, segment_id, frame, is_keyframe``.
    """
    if not 0 < max_keyframes < max_frames:
        raise ValueError("max_keyframes must lie between 0 and max_frames")
    keys = ["seq", "segment_id"]
    one = F.col("is_keyframe").cast("long")
    counted = ordered_scan(
        frames.select(*keys, "frame", "is_keyframe"),
        keys,
        ["frame"],
        width,
        n_key=Scan("sum", one),
        n_other=Scan("sum", 1 - one),
    )
    held = F.least("n_key", F.lit(max_keyframes))
    others = F.least("n_other", F.lit(max_frames) - held)

    def wanted(flag: bool, last: Column, size: Column) -> Column:
        positions = F.when(
            size > 0, F.sequence(last - size + 1, last)
        ).otherwise(F.array().cast("array<bigint>"))
        return F.transform(
            positions, lambda p: F.struct(F.lit(flag).alias("is_keyframe"), p.alias("position"))
        )

    asked = counted.select(
        *keys,
        "frame",
        F.explode(
            F.concat(wanted(True, F.col("n_key"), held), wanted(False, F.col("n_other"), others))
        ).alias("w"),
    ).select(*keys, "frame", "w.is_keyframe", "w.position")
    position = F.when(F.col("is_keyframe"), F.col("n_key")).otherwise(F.col("n_other"))
    members = counted.select(
        *keys, "is_keyframe", position.alias("position"), F.col("frame").alias("member_frame")
    )
    return asked.join(members, [*keys, "is_keyframe", "position"]).select(
        *keys, "frame", "member_frame", "is_keyframe"
    )


def window_support(obs: DataFrame, span: int = 10, width: int = FRAMES) -> DataFrame:
    """Stereo observations per id within the last ``span`` frames, and the live flag.

    Rows near the end of a chunk are copied to the next one, so a chunk holds all it
    needs.
    """
    if span >= width:
        raise ValueError("span must be below the chunk width")
    chunk = F.col("frame") - F.pmod(F.col("frame"), F.lit(width))
    ahead = F.col("frame") + F.lit(span - 1)
    copies = F.array_distinct(F.array(chunk, ahead - F.pmod(ahead, F.lit(width))))
    spread = (
        obs.where(F.col("disparity") > 0)
        .select("seq", "id", "frame", chunk.alias("own"), F.explode(copies).alias("_chunk"))
    )
    recent = (
        Window.partitionBy("seq", "id", "_chunk").orderBy("frame").rangeBetween(-(span - 1), 0)
    )
    return (
        spread.withColumn("support", F.count(F.lit(1)).over(recent))
        .where(F.col("own") == F.col("_chunk"))
        .select("seq", "id", "frame", "support", (F.col("support") >= 2).alias("live"))
    )


def accumulate_seed(
    obs: DataFrame, min_ids: int = 10, accepted: Column | None = None
) -> DataFrame:
    """Observations that seed the first segment: the latest stereo row per id.

    Stereo rows are gathered over frames until ``min_ids`` different ids are known; the
    frame that completes them is ``seed_frame``.  ``accepted`` may restrict the rows
    that count.  The frame follows from the ``min_ids`` smallest first sightings.
    """
    stereo = obs.where(F.col("disparity") > 0)
    if accepted is not None:
        stereo = stereo.where(accepted)
    first_seen = stereo.groupBy("seq", "id").agg(F.min("frame").alias("first"))
    rank = F.row_number().over(Window.partitionBy("seq").orderBy("first", "id"))
    seeded = (
        first_seen.withColumn("rank", rank)
        .where(F.col("rank") <= min_ids)
        .groupBy("seq")
        .agg(F.max("first").alias("seed_frame"), F.count(F.lit(1)).alias("ids"))
        .where(F.col("ids") == min_ids)
        .select("seq", "seed_frame")
    )
    latest = F.max_by(F.struct("frame", "u", "v", "disparity"), "frame").alias("latest")
    return (
        join_per_key(stereo, seeded, ["seq"])
        .where(F.col("frame") <= F.col("seed_frame"))
        .groupBy("seq", "seed_frame", "id")
        .agg(latest)
        .select(
            "seq", "seed_frame", "id", "latest.frame", "latest.u", "latest.v", "latest.disparity"
        )
    )


def skip_drop(
    culls: DataFrame, min_culled: int = 4, defer_topk: int = 0
) -> DataFrame:
    """What happens to each culled id: ``drop`` now, ``defer`` to the next frame, or ``skip``.

    A frame with ``mean_culled`` ids or more is skipped; its ``defer_topk`` smallest
    ids are queued.  ``min_culled <= 0`` never skips.
    """
    per_frame = Window.partitionBy("seq", "frame")
    ranked = culls.select(
        "seq",
        "frame",
        "id",
        F.count(F.lit(1)).over(per_frame).alias("n_culled"),
        F.row_number().over(per_frame.orderBy("id")).alias("rank"),
    )
    skipped = (F.col("n_culled") >= min_culled) & F.lit(min_culled > 0)
    return ranked.select(
        "seq",
        "frame",
        "id",
        F.when(~skipped, "drop")
        .when(F.col("rank") <= defer_topk, "defer")
        .otherwise("skip")
        .alias("action"),
    )


def skip_drop_counts(actions: DataFrame) -> DataFrame:
    """Skipped frames, flushes and flushed ids per sequence."""
    per_frame = actions.groupBy("seq", "frame").agg(
        F.bool_or(F.col("action") != "drop").alias("skipped"),
        F.count_if(F.col("action") == "defer").alias("deferred"),
    )
    return per_frame.groupBy("seq").agg(
        F.count_if("skipped").alias("drops_skipped"),
        F.count_if(F.col("deferred") > 0).alias("deferred_drops"),
        F.sum("deferred").alias("deferred_drop_ids"),
    )


def mark_evictable(obs: DataFrame, culls: DataFrame, min_culled: int = 4, width: int = FRAMES) -> DataFrame:
    """``seq, frame, id, evictable`` of every observed track; feeds :func:`evict_lowest_ids`.

    Where a frame's culls are skipped (:func:`skip_drop`), its culled tracks may be evicted from the
    next frame on, until a frame misses them; a track that comes back starts unmarked.
    """
    skipped = skip_drop(culls, min_culled).where("action <> 'drop'").select("seq", "frame", "id", F.lit(True).alias("_mark"))
    # A scan uses its input twice and here one follows another, so what they read is written.
    rows = cut(obs.select("seq", "frame", "id").join(skipped, ["seq", "frame", "id"], "left"), "tracks")
    seen = ordered_scan(
        rows, ["seq", "id"], ["frame"], width,
        _before=Scan("lag", F.col("frame")), _marked=Scan("last_before", F.when(F.col("_mark"), F.col("frame"))),
    )
    seen = cut(seen, "seen")
    begins = F.when(F.col("_before").isNull() | (F.col("_before") < F.col("frame") - 1), F.col("frame"))
    runs = ordered_scan(seen, ["seq", "id"], ["frame"], width, _run=Scan("last", begins))
    return runs.select("seq", "frame", "id", F.coalesce(F.col("_marked") >= F.col("_run"), F.lit(False)).alias("evictable"))


def smallest_ids(culls: DataFrame, k: int) -> DataFrame:
    """The ``k`` smallest culled ids of each frame."""
    order = Window.partitionBy("seq", "frame").orderBy("id")
    return (
        culls.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("seq", "frame", "id", "rank")
    )


def evict_lowest_ids(tracks: DataFrame, max_tracks: int) -> DataFrame:
    """Evictable tracks that make room: the lowest ids, ``deficit - room`` of them per frame.

    ``tracks`` are ``seq, frame, id, evictable``.
    """
    per_frame = Window.partitionBy("seq", "frame")
    fixed = F.count_if(~F.col("evictable")).over(per_frame)
    total = F.count(F.lit(1)).over(per_frame)
    deficit = F.lit(max_tracks) - fixed
    need = F.when(deficit > 0, deficit - (F.lit(max_tracks) - total)).otherwise(F.lit(0))
    sized = tracks.withColumn("need", need)
    ranked = sized.withColumn(
        "rank", F.row_number().over(per_frame.orderBy(F.desc("evictable"), "id"))
    )
    return ranked.where(F.col("evictable") & (F.col("rank") <= F.col("need"))).select(
        "seq", "frame", "id", "rank"
    )


def longest_tracks_first(lifetable: DataFrame) -> DataFrame:
    return lifetable.orderBy(F.desc("length"), "seq", "id")


def heavy_frames(frames: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Frames worth full detail: any cull, many iterations, a large shift, an index range if given."""
    ranged = F.lit(False) if first is None or last is None else F.col("frame").between(first, last)
    return frames.where(
        ranged
        | (F.col("outliers_culled") > 0)
        | (F.col("lm_iterations") >= 100)
        | (F.col("max_window_pose_shift_m") > 0.5)
    )


def low_connectivity(shared: Column, initialized: Column, min_shared: int = 10) -> Column:
    return initialized & (shared > 0) & (shared < min_shared)


# Texts that other operators look for.
SEED_FIRST = "insufficient observations to seed first segment"
GATHERING = "accumulating seed observations (first segment)"


def admission_gates(
    frames: DataFrame,
    width: int = FRAMES,
    min_inliers: int = 10,
    min_seed: int = 10,
    enable_reanchor: bool = True,
    seed_obs: DataFrame | None = None,
) -> DataFrame:
    """``rejection`` of each frame: the first gate it fails, null when admitted.

    With ``seed_obs`` (``seq, frame, id, disparity``) frames too poor to seed the first segment by
    themselves seed it together: stereo ids are gathered until ``min_seed`` different ones are
    known, and gathering starts anew after a frame that is rich enough alone.

    ``frames`` carry ``seq, frame, ts_ns, status, num_obs, bad_obs, num_disparity,
    num_shared, is_keyframe``.  A frame is initialised once an earlier one was
    accepted; time must pass the last accepted frame.
    """
    accepted = F.when(F.col("status") == "ok", F.col("ts_ns"))
    seen = ordered_scan(
        frames, ["seq"], ["frame"], width, last_ok_ns=Scan("last_before", accepted)
    )
    started = F.col("last_ok_ns").isNotNull()
    broken = started & (F.col("num_shared") == 0)
    key = F.col("is_keyframe")
    short = F.col("num_disparity") < min_seed
    judged = seen.withColumn("initialized", started).withColumn(
        "rejection",
        F.when(F.col("num_obs") == 0, "empty observations")
        .when(F.col("bad_obs") > 0, "non-finite pixel or negative disparity")
        .when(
            started & (F.col("ts_ns") <= F.col("last_ok_ns")),
            "timestamp not strictly increasing",
        )
        .when(broken & F.lit(not enable_reanchor), "zero shared landmarks with window")
        .when(broken & ~key, "zero shared landmarks (non-keyframe)")
        .when(~started & ~key, "not initialised (non-keyframe)")
        .when(
            ~key & (F.col("num_shared") < min_inliers),
            "insufficient shared landmarks (non-keyframe)",
        )
        .when(broken & short, "insufficient observations to seed new segment")
        .when(~started & short, SEED_FIRST),
    )
    return judged if seed_obs is None else _gathered(judged, seed_obs, min_seed, width)


def _gathered(judged: DataFrame, obs: DataFrame, min_seed: int, width: int) -> DataFrame:
    """``judged`` frames, those that fail to seed the first segment by what is gathered so far.

    An id counts in the frame that shows it first since gathering began, so the number of different
    ids is a running sum over frames; no frame looks back at others.
    """
    rich = ~F.col("initialized") & F.col("rejection").isNull()
    poor = F.col("rejection") == SEED_FIRST
    turns = cut(ordered_scan(judged, ["seq"], ["frame"], width, _turn=Scan("sum", F.when(rich, 1).otherwise(0).cast("long"))), "turns")
    asked = turns.where(poor).select("seq", "frame", "_turn")
    seen = obs.where(F.col("disparity") > 0).select("seq", "frame", "id").join(asked, ["seq", "frame"])
    new = seen.groupBy("seq", "_turn", "id").agg(F.min("frame").alias("frame")).groupBy("seq", "_turn", "frame").agg(F.count(F.lit(1)).alias("_new"))
    counted = asked.join(new, ["seq", "_turn", "frame"], "left").na.fill(0, ["_new"])
    known = ordered_scan(counted, ["seq", "_turn"], ["frame"], width, _known=Scan("sum", F.col("_new"))).select("seq", "frame", "_known")
    found = turns.join(known, ["seq", "frame"], "left")
    waits = F.when(F.col("_known") < min_seed, GATHERING)
    return found.withColumn("rejection", F.when(poor, waits).otherwise(F.col("rejection"))).drop("_turn", "_known")
