"""Trajectory evaluation: rigid alignment, absolute and relative pose error."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posequery.functions import geometry as g
from posequery.functions.stats import moments
from posequery.operators.timejoin import (
    MINUTE_NS,
    RPE_DELTA_NS,
    RPE_TOLERANCE_NS,
    rpe_partner,
)
from posequery.plans.quantiles import exact_quantiles
from posequery.session import cut

# Fixed value: smallest accepted ratio of the second to the first singular value.
RANK_TOLERANCE = 1e-8
STAT_FIELDS = ["rmse", "mean", "median", "stddev", "max"]


def error_stats(
    errors: DataFrame, keys: Sequence[str], values: Mapping[str, str]
) -> DataFrame:
    """rmse, mean, median, population stddev and max per group, and the row count ``n``.

    ``values`` maps output prefixes to columns; their medians are found in one pass.
    """
    keys = list(keys)
    spread = [F.count(F.lit(1)).alias("n")]
    for prefix, column in values.items():
        spread += [c.alias(f"{prefix}{n}") for n, c in moments(F.col(column)).items()]
    stacked = errors.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(p).alias("metric"), F.col(c).alias("value"))
                    for p, c in values.items()
                ]
            )
        ).alias("m"),
    ).select(*keys, "m.metric", "m.value")
    medians = (
        exact_quantiles(stacked, [*keys, "metric"], "value", {"median": 0.5})
        .groupBy(*keys)
        .agg(
            *[F.max(F.when(F.col("metric") == p, F.col("median"))).alias(f"{p}median") for p in values]
        )
    )
    totals = errors.groupBy(*keys).agg(*spread)
    joined = totals.join(medians, keys, "left") if keys else totals.crossJoin(medians)
    return joined.na.fill(0.0, [f"{p}median" for p in values])


_MOMENTS = [f"c{i}{j}" for i in range(3) for j in range(3)]
_MEANS = [f"{side}{i}" for side in "eg" for i in range(3)]


def _quaternions(m: np.ndarray) -> np.ndarray:
    """Unit quaternions of a stack of rotation matrices, scalar last."""
    outer = np.empty((len(m), 4, 4))
    outer[:, :3, :3] = m + m.transpose(0, 2, 1)
    trace = np.trace(m, axis1=1, axis2=2)
    for i in range(3):
        outer[:, i, i] = 1.0 + 2.0 * m[:, i, i] - trace
        j, k = (i + 1) % 3, (i + 2) % 3
        outer[:, i, 3] = outer[:, 3, i] = m[:, k, j] - m[:, j, k]
    outer[:, 3, 3] = 1.0 + trace
    largest = np.argmax(np.diagonal(outer, axis1=1, axis2=2), axis=1)
    rows = outer[np.arange(len(m)), largest]
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _transform_kernel(rank_tolerance: float):
    def kernel(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.stack([s.to_numpy(dtype=float) for s in batch], axis=1)
            usable = np.isfinite(values).all(axis=1)
            values = np.where(usable[:, None], values, 0.0)
            u, sigma, vt = np.linalg.svd(values[:, :9].reshape(-1, 3, 3))
            first = np.where(sigma[:, 0] > 0, sigma[:, 0], 1.0)
            solid = usable & (sigma[:, 0] > 0) & (sigma[:, 1] / first >= rank_tolerance)
            u[np.linalg.det(u @ vt) < 0, :, 2] *= -1.0
            rotation = u @ vt
            shift = values[:, 12:] - np.einsum("nij,nj->ni", rotation, values[:, 9:12])
            frame = pd.DataFrame(
                np.hstack([shift, _quaternions(rotation)]), columns=g.POSE_COLUMNS
            )
            frame["ok"] = solid
            yield frame

    kernel.__annotations__ = {
        "batches": Iterator[tuple[pd.Series, ...]],
        "return": Iterator[pd.DataFrame],
    }
    fields = ", ".join([f"{c} double" for c in g.POSE_COLUMNS] + ["ok boolean"])
    return F.pandas_udf(kernel, fields)


def align_se3(
    pairs: DataFrame,
    keys: Sequence[str] = ("run", "seq"),
    rank_tolerance: float = RANK_TOLERANCE,
) -> DataFrame:
    """Least-squares rigid transform from estimate to ground truth, without scale.

    Means and centred covariances are mergeable aggregates, so a group of any size is
    reduced on the map side; only one 3x3 matrix per group reaches the kernel.
    """
    est, gt = ["tx", "ty", "tz"], ["gt.tx", "gt.ty", "gt.tz"]
    aggregates = [F.count(F.lit(1)).alias("n")]
    aggregates += [F.avg(c).alias(f"e{i}") for i, c in enumerate(est)]
    aggregates += [F.avg(c).alias(f"g{i}") for i, c in enumerate(gt)]
    aggregates += [
        F.covar_pop(gc, ec).alias(f"c{i}{j}")
        for i, gc in enumerate(gt)
        for j, ec in enumerate(est)
    ]
    sums = pairs.groupBy(*keys).agg(*aggregates)
    solved = sums.withColumn("solved", _transform_kernel(rank_tolerance)(*_MOMENTS, *_MEANS))
    code = F.when(F.col("n") < 3, "too_few_matches").when(~F.col("solved.ok"), "degenerate")
    return solved.select(
        *keys,
        "n",
        code.alias("error_code"),
        *[F.when(code.isNull(), F.col(f"solved.{c}")).alias(f"align_{c}") for c in g.POSE_COLUMNS],
    )


def ate_errors(
    pairs: DataFrame, transforms: DataFrame, keys: Sequence[str] = ("run", "seq")
) -> DataFrame:
    """Per matched row: aligned position, translation error (m), rotation error (deg)."""
    transform = g.Pose(
        g.Vec(*[F.col(f"align_{c}") for c in g.POSE_COLUMNS[:3]]),
        g.Quat(*[F.col(f"align_{c}") for c in g.POSE_COLUMNS[3:]]),
    )
    aligned = g.pose_apply(transform, g.pose().t)
    joined = pairs.join(
        transforms.where(F.col("error_code").isNull()).drop("n", "error_code"), list(keys)
    )
    placed = joined.select(
        *pairs.columns,
        *[c.alias(f"aligned_{n}") for c, n in zip(aligned, "xyz", strict=True)],
        *[
            c.alias(f"turned_{n}")
            for c, n in zip(g.quat_multiply(transform.q, g.pose().q), "xyzw", strict=True)
        ],
    )
    truth = g.pose("gt")
    difference = g.subtract(g.vec("aligned_"), truth.t)
    turned = g.Quat(*[F.col(f"turned_{n}") for n in "xyzw"])
    return placed.select(
        *[c for c in pairs.columns],
        "aligned_x",
        "aligned_y",
        "aligned_z",
        g.length(difference).alias("err_trans_m"),
        g.rotation_angle_deg(g.quat_multiply(g.quat_conjugate(truth.q), turned)).alias(
            "err_rot_deg"
        ),
    )


def _two_stats(errors: DataFrame, keys: Sequence[str]) -> DataFrame:
    return error_stats(errors, keys, {"trans_": "err_trans_m", "rot_": "err_rot_deg"})


def ate_report(pairs: DataFrame, keys: Sequence[str] = ("run", "seq")) -> DataFrame:
    """Absolute trajectory error per group, with ``error_code`` where undefined.

    ``pairs`` is read several times; pass it through ``session.cut`` when costly.
    """
    transforms = cut(align_se3(pairs, keys), "transforms")
    errors = cut(
        ate_errors(pairs, transforms, keys).select(*keys, "err_trans_m", "err_rot_deg"), "errors"
    )
    return transforms.select(*keys, "n", "error_code").join(
        _two_stats(errors, keys).drop("n"), list(keys), "left"
    )


def ate_rmse(pairs: DataFrame, keys: Sequence[str] = ("run", "seq")) -> DataFrame:
    """``trans_rmse`` per group alone, for those that can be aligned: sums, no medians, nothing written."""
    errors = ate_errors(pairs, align_se3(pairs, keys), keys)
    return errors.groupBy(*keys).agg(F.sqrt(F.avg(F.col("err_trans_m") ** 2)).alias("trans_rmse"))


def rpe_errors(partners: DataFrame) -> DataFrame:
    """Relative pose error of each row; null where it has no partner."""
    motions = partners.select(
        "run",
        "seq",
        "ts_ns",
        g.pose_struct(g.pose_between(g.pose(), g.pose("partner"))).alias("est_motion"),
        g.pose_struct(g.pose_between(g.pose("gt"), g.pose("partner.gt"))).alias("gt_motion"),
    )
    error = g.pose_between(g.pose("gt_motion"), g.pose("est_motion"))
    return motions.select(
        "run",
        "seq",
        "ts_ns",
        g.length(error.t).alias("err_trans_m"),
        g.rotation_angle_deg(error.q).alias("err_rot_deg"),
    )


def rpe_report(
    pairs: DataFrame,
    delta_ns: int = RPE_DELTA_NS,
    tolerance_ns: int = RPE_TOLERANCE_NS,
    width_ns: int = MINUTE_NS,
) -> DataFrame:
    """Relative pose error per run and sequence; pairs plus dropped rows equal matches."""
    keys = ["run", "seq"]
    partners = rpe_partner(pairs, delta_ns, tolerance_ns, width_ns)
    errors = cut(rpe_errors(partners).select(*keys, "err_trans_m", "err_rot_deg"), "errors")
    found = F.col("err_trans_m").isNotNull()
    counts = errors.groupBy(*keys).agg(
        F.count_if(found).alias("pair_count"), F.count_if(~found).alias("dropped_no_partner")
    )
    stats = _two_stats(errors.where(found), keys).drop("n")
    return counts.join(stats, keys, "left").withColumn(
        "error_code", F.when(F.col("pair_count") == 0, "no_delta_pairs")
    )


def for_every_run(report: DataFrame, association: DataFrame) -> DataFrame:
    """An error report with one row per run of ``association_report``.

    A run that did not associate well enough has that ``error_code`` and null errors, also
    where it has no matched rows and so no row in ``report``.
    """
    keys = ["run", "seq"]
    gate = association.select(*keys, "est_total", "matched", "match_rate", F.col("error_code").alias("gate"))
    values = [c for c in report.columns if c not in (*keys, "error_code")]
    return gate.join(report, keys, "left").select(
        *keys,
        "est_total",
        "matched",
        "match_rate",
        F.coalesce("gate", "error_code").alias("error_code"),
        *[F.when(F.col("gate").isNull(), F.col(c)).alias(c) for c in values],
    )


def diag_segments(rows: DataFrame, diag: DataFrame) -> DataFrame:
    """Rows with the ``segment_id`` of their diagnostics; others are left out."""
    return rows.join(
        diag.select("run", "seq", "ts_ns", "segment_id"), ["run", "seq", "ts_ns"]
    )


def segment_decomposition(pairs: DataFrame, frames: DataFrame) -> DataFrame:
    """Per segment its own ATE and frame share; per run the weighted RMS beside the global.

    ``pairs`` are matched rows with ``segment_id``; ``frames`` are all estimate rows with
    ``segment_id``.  A segment whose ATE is undefined stays null and adds nothing.
    """
    run = ["run", "seq"]
    segment = [*run, "segment_id"]
    own = ate_rmse(pairs, segment).withColumnRenamed("trans_rmse", "segment_ate")
    size = frames.groupBy(*segment).agg(F.count(F.lit(1)).alias("frames"))
    total = size.groupBy(*run).agg(F.sum("frames").alias("run_frames"))
    shares = (
        size.join(total, run)
        .withColumn("share", F.col("frames") / F.col("run_frames"))
        .join(own, segment, "left")
    )
    weighted = shares.groupBy(*run).agg(
        F.sqrt(
            F.coalesce(F.sum(F.col("share") * F.col("segment_ate") ** 2), F.lit(0.0))
        ).alias("weighted_rms")
    )
    overall = ate_rmse(pairs, run).withColumnRenamed("trans_rmse", "global_ate")
    return (
        shares.join(weighted, run)
        .join(overall, run, "left")
        .withColumn("misalignment", F.col("global_ate") - F.col("weighted_rms"))
    )
