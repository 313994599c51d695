"""Residuals of observations against frame poses and landmarks, and what follows from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posequery.functions import geometry as g
from posequery.functions.camera import (
    Rig,
    back_project,
    stereo_residual,
    to_left_camera,
)
from posequery.operators.tracks import FRAMES
from posequery.plans.ordered import Scan, ordered_scan


def reproject(obs: DataFrame, frames: DataFrame, landmarks: DataFrame, rig: Rig) -> DataFrame:
    """Observation rows with the camera-frame depth and stereo residual of their landmark.

    ``frames`` carry body poses per ``seq, frame``; ``landmarks`` world points per
    ``seq, id``.  Rows without pose or landmark are left out.  Poses are joined last, so
    that aggregates per landmark combine before they shuffle.
    """
    poses = frames.select("seq", "frame", *g.POSE_COLUMNS)
    points = landmarks.select("seq", "id", "x", "y", "z")
    joined = (
        obs.select("seq", "frame", "id", "u", "v", "disparity")
        .join(points, ["seq", "id"])
        .join(poses, ["seq", "frame"])
    )
    camera = to_left_camera(g.pose(), g.vec(""))
    placed = joined.select(
        "seq",
        "frame",
        "id",
        "u",
        "v",
        "disparity",
        *[c.alias(f"c{n}") for c, n in zip(camera, "xyz", strict=True)],
    )
    residual = stereo_residual(rig, g.vec("c"), F.col("u"), F.col("v"), F.col("disparity"))
    return placed.select(
        "seq",
        "frame",
        "id",
        "u",
        "v",
        "disparity",
        F.col("cz").alias("depth"),
        *[c.alias(n) for c, n in zip(residual, ("r_left", "r_right", "r_v"), strict=True)],
    )


def squared_residual() -> Column:
    return F.col("r_left") ** 2 + F.col("r_right") ** 2 + F.col("r_v") ** 2


def residual_norm() -> Column:
    return F.sqrt(squared_residual())


def reprojection_rms(
    residuals: DataFrame, keys: Sequence[str], kept: DataFrame | None = None
) -> DataFrame:
    """Root mean square residual of the stereo rows per group.

    ``kept`` limits the rows to landmarks still alive.
    """
    stereo = residuals.where(F.col("disparity") > 0)
    if kept is not None:
        stereo = stereo.join(kept.select("seq", "id").distinct(), ["seq", "id"], "left_semi")
    return stereo.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("factors"), F.sqrt(F.avg(squared_residual())).alias("rms_px")
    )


def cull_landmarks(
    residuals: DataFrame, max_mean_px: float = 4.0, min_factors: int = 4
) -> DataFrame:
    """Per landmark: stereo factors, mean residual, behind-camera flag and verdict.

    A landmark behind any camera that saw it in stereo goes first; of the others those
    with enough factors and a large mean residual are culled.
    """
    scored = (
        residuals.where(F.col("disparity") > 0)
        .groupBy("seq", "id")
        .agg(
            F.count(F.lit(1)).alias("factors"),
            F.avg(residual_norm()).alias("mean_px"),
            F.bool_or(F.col("depth") <= 0).alias("behind"),
        )
    )
    return scored.withColumn(
        "verdict",
        F.when(F.col("behind"), "cheirality")
        .when(
            (F.col("factors") >= min_factors) & (F.col("mean_px") > max_mean_px), "mean_residual"
        )
        .otherwise("keep"),
    )


def behind_camera_counts(residuals: DataFrame) -> DataFrame:
    """Factors and landmarks behind a camera, per frame."""
    behind = (F.col("disparity") > 0) & (F.col("depth") <= 0)
    return residuals.groupBy("seq", "frame").agg(F.count_if(behind).alias("behind_factors"))


def residual_probe(residuals: DataFrame) -> DataFrame:
    """Mean and largest of the landmarks' mean residuals, and the id of the largest.

    Equal maxima, to nine decimals, resolve to the smaller id: behind the camera all residuals
    are equal, but their means differ by the order of summing.
    """
    per_landmark = (
        residuals.where(F.col("disparity") > 0)
        .groupBy("seq", "id")
        .agg(F.avg(residual_norm()).alias("mean_px"))
    )
    return per_landmark.groupBy("seq").agg(
        F.avg("mean_px").alias("res_mean_px"),
        F.max("mean_px").alias("res_max_px"),
        F.max_by("id", F.struct(F.round("mean_px", 9), -F.col("id"))).alias("res_max_id"),
    )


def predicted_pose(frames: DataFrame, width: int = FRAMES) -> DataFrame:
    """Constant-velocity prediction per accepted frame.

    The last motion is repeated; one earlier pose is kept as is; none gives identity.
    """
    accepted = frames.where(F.col("status") == "ok").select("seq", "frame", *g.POSE_COLUMNS)
    own = g.pose_struct(g.pose())
    twice = ordered_scan(
        accepted,
        ["seq"],
        ["frame"],
        width,
        once=True,
        prev=Scan("lag", own),
        prevprev=Scan("lag", own, offset=2),
    )
    last, before = g.pose("prev"), g.pose("prevprev")
    step = g.pose_between(before, last)
    moved = twice.select("seq", "frame", "prev", "prevprev", g.pose_struct(step).alias("step"))
    predicted = g.pose_compose(last, g.pose("step"))
    identity = [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    held = [*last.t, *last.q]
    ahead = [*predicted.t, *predicted.q]
    return moved.select(
        "seq",
        "frame",
        *[
            F.when(F.col("prev").isNull(), F.lit(i))
            .when(F.col("prevprev").isNull(), h)
            .otherwise(a)
            .alias(n)
            for n, i, h, a in zip(g.POSE_COLUMNS, identity, held, ahead, strict=True)
        ],
    )


def hanging_gate(
    obs: DataFrame, frames: DataFrame, max_move_m: float = 1.0, width: int = FRAMES
) -> DataFrame:
    """Zero-disparity rows with ``stale``: the body moved too far since the last stereo row.

    No stereo row on record is stale; a limit of zero or less never is.
    """
    body = frames.select("seq", "frame", "tx", "ty", "tz")
    placed = obs.select("seq", "id", "frame", "disparity").join(body, ["seq", "frame"])
    here = F.struct("tx", "ty", "tz")
    seen = ordered_scan(
        placed,
        ["seq", "id"],
        ["frame"],
        width,
        stereo_at=Scan("last_before", F.when(F.col("disparity") > 0, here)),
    )
    moved = g.length(
        g.subtract(
            g.Vec(*[F.col(f"stereo_at.{c}") for c in ("tx", "ty", "tz")]),
            g.Vec(*[F.col(c) for c in ("tx", "ty", "tz")]),
        )
    )
    stale = F.when(F.lit(max_move_m <= 0), F.lit(False)).otherwise(
        F.coalesce(moved > max_move_m, F.lit(True))
    )
    return seen.where(F.col("disparity") <= 0).select(
        "seq", "id", "frame", moved.alias("moved_m"), stale.alias("stale")
    )


def pose_shifts(solutions: DataFrame, width: int = FRAMES) -> DataFrame:
    """Displacement of each member frame between successive solutions.

    ``solutions`` are ``seq, solution, member, tx, ty, tz``.
    """
    before = ordered_scan(
        solutions,
        ["seq", "member"],
        ["solution"],
        width,
        prev=Scan("lag", F.struct("tx", "ty", "tz")),
    )
    shift = g.length(
        g.subtract(
            g.Vec(*[F.col(c) for c in ("tx", "ty", "tz")]),
            g.Vec(*[F.col(f"prev.{c}") for c in ("tx", "ty", "tz")]),
        )
    )
    return before.where(F.col("prev").isNotNull()).select(
        "seq", "solution", "member", shift.alias("shift_m")
    )


def top_shifts(shifts: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` largest shifts of each solution, largest first."""
    order = Window.partitionBy("seq", "solution").orderBy(F.desc("shift_m"), "member")
    return (
        shifts.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("seq", "solution", "rank", "member", "shift_m")
    )


def window_shift(shifts: DataFrame) -> DataFrame:
    """Largest shift of each solution."""
    return shifts.groupBy("seq", "solution").agg(F.max("shift_m").alias("max_shift_m"))


def far_return(
    obs: DataFrame, frames: DataFrame, landmarks: DataFrame, rig: Rig, max_error_px: float = 6.0
) -> DataFrame:
    """Landmark point to use at a stereo return: the stored one, or a fresh back-projection.

    A stored point is refreshed when it is behind the camera or its left pixel is off by
    more than ``max_error_px``; a limit of zero or less never refreshes.
    """
    # Values that are used again get columns of their own; inlined they make code too long to be compiled.
    back = g.pose_inverse(g.pose()).t
    poses = frames.select("seq", "frame", *g.POSE_COLUMNS, *[c.alias(f"b{n}") for c, n in zip(back, "xyz", strict=True)])
    joined = (
        obs.where(F.col("disparity") > 0)
        .select("seq", "frame", "id", "u", "v", "disparity")
        .join(poses, ["seq", "frame"])
        .join(landmarks.select("seq", "id", "x", "y", "z"), ["seq", "id"])
    )
    seen = back_project(rig, F.col("u"), F.col("v"), F.col("disparity"))
    joined = joined.select("*", *[c.alias(f"s{n}") for c, n in zip(seen, "xyz", strict=True)])
    camera = g.pose_apply(g.Pose(g.vec("b"), g.quat_conjugate(g.pose().q)), g.vec(""))
    fresh = g.pose_apply(g.pose(), g.vec("s"))
    placed = joined.select(
        "*",
        *[c.alias(f"c{n}") for c, n in zip(camera, "xyz", strict=True)],
        *[c.alias(f"f{n}") for c, n in zip(fresh, "xyz", strict=True)],
    )
    point = g.vec("c")
    depth = F.when(point.z > 0, point.z)
    error = F.sqrt(
        (rig.fx * point.x / depth + rig.cx - F.col("u")) ** 2
        + (rig.fy * point.y / depth + rig.cy - F.col("v")) ** 2
    )
    judged = placed.withColumn("error_px", error).withColumn(
        "refresh",
        F.lit(max_error_px > 0)
        & (F.col("error_px").isNull() | (F.col("error_px") > max_error_px)),
    )
    return judged.select(
        "seq", "frame", "id", "error_px", "refresh", *[F.when(F.col("refresh"), F.col(f"f{n}")).otherwise(F.col(n)).alias(n) for n in "xyz"]
    )


def pose_rms(residuals: DataFrame) -> DataFrame:
    """Stereo RMS of a candidate pose per frame over all its inliers.

    Zero-disparity inliers count in the denominator only; a point behind the camera or
    a non-finite residual makes the value null.
    """
    stereo = F.col("disparity") > 0
    squared = F.when(stereo, squared_residual()).otherwise(F.lit(0.0))
    bad = stereo & (
        (F.col("depth") <= 0) | squared.isNull() | F.isnan(squared) | (squared == float("inf"))
    )
    value = F.sqrt(F.sum(squared) / F.count(F.lit(1)))
    return residuals.groupBy("seq", "frame").agg(
        F.when(~F.coalesce(F.bool_or(bad), F.lit(False)), value).alias("rms_px")
    )


def arbitrate(proposal: DataFrame, guess: DataFrame, sigma_px: float = 1.0) -> DataFrame:
    """Accept a proposed pose unless it is worse than the guess by more than one sigma.

    Both sides are :func:`pose_rms` tables; an undefined proposal is refused, an
    undefined guess accepts.
    """
    both = proposal.select("seq", "frame", F.col("rms_px").alias("proposal_px")).join(
        guess.select("seq", "frame", F.col("rms_px").alias("guess_px")), ["seq", "frame"], "left"
    )
    accept = F.col("proposal_px").isNotNull() & (
        F.col("guess_px").isNull() | (F.col("proposal_px") <= F.col("guess_px") + sigma_px)
    )
    return both.withColumn("accepted", accept)


def compensated_parallax(snapshot: DataFrame, rig: Rig) -> DataFrame:
    """Mean pixel motion since the last keyframe after removing rotation.

    ``snapshot`` holds ``u, v, kf_u, kf_v`` and the quaternions ``rot_*`` (current) and
    ``kf_rot_*`` (keyframe).  Rays turned behind the camera are skipped.
    """
    current = g.Quat(*[F.col(f"rot_{c}") for c in "xyzw"])
    keyframe = g.Quat(*[F.col(f"kf_rot_{c}") for c in "xyzw"])
    between = g.quat_multiply(g.quat_conjugate(current), keyframe)
    turned = snapshot.select(
        "seq",
        "frame",
        "u",
        "v",
        "kf_u",
        "kf_v",
        *[c.alias(f"d{n}") for c, n in zip(between, "xyzw", strict=True)],
    )
    ray = g.quat_rotate(
        g.Quat(*[F.col(f"d{n}") for n in "xyzw"]),
        g.Vec((F.col("kf_u") - rig.cx) / rig.fx, (F.col("kf_v") - rig.cy) / rig.fy, F.lit(1.0)),
    )
    rays = turned.select(
        "seq", "frame", "u", "v", *[c.alias(f"y{n}") for c, n in zip(ray, "xyz", strict=True)]
    ).where(F.col("yz") > 1e-6)
    du = F.col("u") - (F.col("yx") / F.col("yz") * rig.fx + rig.cx)
    dv = F.col("v") - (F.col("yy") / F.col("yz") * rig.fy + rig.cy)
    return rays.groupBy("seq", "frame").agg(
        F.count(F.lit(1)).alias("rays"), F.avg(F.sqrt(du * du + dv * dv)).alias("parallax_px")
    )
