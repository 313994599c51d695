"""Analytic trajectories and brute-force twins of the evaluation operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from posequery.operators import evaluate as ev
from posequery.operators import timejoin as tj

START = 1_700_000_000_000_000_123
POSE = "run string, seq long, ts_ns long, tx double, ty double, tz double, qx double, qy double, qz double, qw double"
MS = 1_000_000


def climb(n, step_ns=40 * MS):
    """A parabola that rises steadily, turning at 0.6 rad/s: position (2t, t^2, t/2)."""
    for i in range(n):
        t = i * step_ns * 1e-9
        yield [START + i * step_ns, 2 * t, t * t, t / 2, 0.0, 0.0, math.sin(0.3 * t), math.cos(0.3 * t)]


def frame(spark, rows, run="a"):
    return spark.createDataFrame([(run, 1, *r) for r in rows], POSE)


def moved(rows, yaw=-0.8, shift=(12.0, 5.0, -2.5)):
    c, s = math.cos(yaw), math.sin(yaw)
    qz, qw = math.sin(yaw / 2), math.cos(yaw / 2)
    for t, x, y, z, *q in rows:
        yield [
            t,
            c * x - s * y + shift[0],
            s * x + c * y + shift[1],
            z + shift[2],
            0.0,
            0.0,
            qw * q[2] + qz * q[3],
            qw * q[3] - qz * q[2],
        ]


def pairs(spark, est, gt, **options):
    gt_frame = frame(spark, gt).drop("run")
    return tj.matched_pairs(tj.associate(frame(spark, est), gt_frame, **options))


def test_identical_and_moved_trajectories_have_no_error(spark):
    base = list(climb(50))
    for est in (base, list(moved(base))):
        matched = pairs(spark, est, base)
        row = ev.ate_report(matched).first()
        assert row.n == 50 and row.error_code is None
        assert row.trans_max == pytest.approx(0, abs=1e-9)
        assert row.rot_max == pytest.approx(0, abs=1e-6)
        rpe = ev.rpe_report(matched, 1_200 * MS, 15 * MS, tj.MINUTE_NS).first()
        assert (rpe.pair_count, rpe.dropped_no_partner) == (20, 30)
        assert rpe.trans_max == pytest.approx(0, abs=1e-9)


def slipping(rows, speed):
    """``rows`` that slide along y by ``speed`` metres a second."""
    return [[t, x, y + speed * (t - START) * 1e-9, *rest] for t, x, y, *rest in rows]


@pytest.mark.parametrize("step_ms, n, delta_ms, steps", [(40, 70, 1_200, 30), (70, 60, 1_000, 14), (30, 80, 400, 13)])
def test_slip_shows_in_relative_error(spark, step_ms, n, delta_ms, steps):
    base = list(climb(n, step_ms * MS))
    est = list(moved(slipping(base, 0.07)))
    row = ev.rpe_report(pairs(spark, est, base), delta_ms * MS, 25 * MS, tj.MINUTE_NS).first()
    assert (row.pair_count, row.dropped_no_partner) == (n - steps, steps)
    for value in (row.trans_rmse, row.trans_max, row.trans_median):
        assert value == pytest.approx(0.07 * steps * step_ms * 1e-3, abs=1e-9)
    assert row.rot_max == pytest.approx(0, abs=1e-6)


def test_turning_too_fast_shows_in_relative_rotation(spark):
    base = list(climb(40))
    fast = []
    for t, x, y, z, *_ in base:
        half = (0.6 + math.radians(8.0)) * (t - START) * 1e-9 / 2
        fast.append([t, x, y, z, 0.0, 0.0, math.sin(half), math.cos(half)])
    row = ev.rpe_report(pairs(spark, fast, base), 520 * MS, 5 * MS, tj.MINUTE_NS).first()
    assert row.rot_rmse == pytest.approx(8.0 * 0.52, abs=1e-9)


def test_scale_is_not_absorbed(spark):
    base = list(climb(45))
    middle = np.mean([r[1:4] for r in base], axis=0)
    scaled = [[t, *(0.75 * np.array([x, y, z])).tolist(), *q] for t, x, y, z, *q in base]
    spread = math.sqrt(np.mean([np.sum((np.array(r[1:4]) - middle) ** 2) for r in base]))
    assert ev.ate_report(pairs(spark, scaled, base)).first().trans_rmse == pytest.approx(0.25 * spread, rel=1e-9)


def test_alignment_degenerate_cases(spark):
    def code(points):
        rows = [[START + i * 50 * MS, *map(float, p), 0.0, 0.0, 0.0, 1.0] for i, p in enumerate(points)]
        return ev.align_se3(pairs(spark, rows, rows)).first().error_code

    assert code([(-2, 1, 4), (3, 1, 4), (3, 6, 4), (0, 2, 4), (1, 5, 4)]) is None
    assert code([(0.5 * i - 1, 3.0 - i, 0.25 * i) for i in range(7)]) == "degenerate"
    assert code([(-2.0, 0.5, 7.0)] * 6) == "degenerate"
    assert code([(5, 0, 1), (6, 2, 1)]) == "too_few_matches"


def test_alignment_far_from_origin(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(50, 3))
    yaw, shift = 0.7, np.array([1e4, -2e4, 3e4])
    turn = np.array([[math.cos(yaw), -math.sin(yaw), 0], [math.sin(yaw), math.cos(yaw), 0], [0, 0, 1]])
    target = points @ turn.T + shift
    stamps = [START + i * 50 * MS for i in range(50)]
    est = [[t, *map(float, p), 0.0, 0.0, 0.0, 1.0] for t, p in zip(stamps, points)]
    gt = [[t, *map(float, p), 0.0, 0.0, 0.0, 1.0] for t, p in zip(stamps, target)]
    row = ev.align_se3(pairs(spark, est, gt)).first()
    assert 2 * math.atan2(row.align_qz, row.align_qw) == pytest.approx(yaw, abs=1e-9)
    assert [row.align_tx, row.align_ty, row.align_tz] == pytest.approx(list(shift), abs=1e-6)


def test_mirrored_points_are_not_reflected(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(30, 3))
    stamps = [START + i * 50 * MS for i in range(30)]
    est = [[t, *map(float, p), 0.0, 0.0, 0.0, 1.0] for t, p in zip(stamps, points)]
    gt = [[t, *map(float, p * [1, 1, -1]), 0.0, 0.0, 0.0, 1.0] for t, p in zip(stamps, points)]
    row = ev.align_se3(pairs(spark, est, gt)).first()
    norm = math.sqrt(sum(row[f"align_q{c}"] ** 2 for c in "xyzw"))
    assert norm == pytest.approx(1.0, abs=1e-12)
    assert ev.ate_report(pairs(spark, est, gt)).first().trans_rmse > 0.1


def nearest(stamps, target, prefer_later):
    best = min(stamps, key=lambda s: (abs(s - target), -s if prefer_later else s))
    return best


@pytest.mark.parametrize("seed", range(3))
def test_association_and_partner_match_brute_force(spark, seed):
    rng = random.Random(seed)
    gt = sorted(rng.sample(range(0, 4000), 300))
    est = sorted(rng.sample(range(-200, 4200), 250))
    def rows(stamps):
        return [[t, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0] for t in stamps]
    found = tj.associate(frame(spark, rows(est)), frame(spark, rows(gt)).drop("run"), 6, 97)
    got = {r.ts_ns: r.m for r in found.select("ts_ns", F.col("gt.ts_ns").alias("m")).collect()}
    want = {}
    for t in est:
        best = nearest(gt, t, False)
        want[t] = best if abs(best - t) <= 6 else None
    assert got == want
    matched = tj.matched_pairs(found)
    delta, tolerance = 60, 9
    partners = tj.rpe_partner(matched, delta, tolerance, 97)
    got = {r.ts_ns: r.p for r in partners.select("ts_ns", F.col("partner.ts_ns").alias("p")).collect()}
    kept = [t for t in est if want[t] is not None]
    for t in kept:
        best = nearest(kept, t + delta, True)
        assert got[t] == (best if abs(best - t - delta) <= tolerance else None)


def test_association_report_counters_and_codes(spark):
    def rows(stamps):
        return [[t, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0] for t in stamps]
    gt = frame(spark, rows(range(0, 100, 10))).drop("run")

    def report(stamps):
        return tj.association_report(tj.associate(frame(spark, rows(stamps)), gt, 2, 50), gt).first()

    row = report([-50, 1, 15, 31, 42, 55, 500])
    assert (row.matched, row.dropped_out_of_range, row.dropped_over_threshold) == (3, 2, 2)
    assert row.error_code == "match_rate_too_low"
    assert report([-50, 500]).error_code == "no_overlap"
    assert report([0, 10]).error_code == "too_few_matches"
    assert report([0, 10, 20]).error_code is None


def test_option_checks(spark):
    empty = frame(spark, [])
    with pytest.raises(ValueError):
        tj.rpe_partner(empty, 0, 0)
    with pytest.raises(ValueError):
        tj.rpe_partner(empty, 10, 10)
    with pytest.raises(ValueError):
        tj.associate(empty, empty.drop("run"), -1)
    with pytest.raises(ValueError):
        tj.pair_soft(empty, empty, -1)


def test_undefined_reports_keep_their_row(spark):
    line = [[START + i * 50 * MS, float(i), 0.0, 0.0, 0.0, 0.0, 0.0, 1.0] for i in range(10)]
    matched = pairs(spark, line, line)
    row = ev.ate_report(matched).first()
    assert row.error_code == "degenerate" and row.trans_rmse is None
    row = ev.rpe_report(matched, 10_000 * MS, 20 * MS, tj.MINUTE_NS).first()
    assert row.error_code == "no_delta_pairs" and row.dropped_no_partner == 10


def test_every_run_has_a_row(spark):
    report = spark.createDataFrame([("a", 1, None, 0.5), ("b", 1, None, 0.0)], "run string, seq long, error_code string, trans_rmse double")
    rows = [("a", 1, 9, 9, 1.0, None), ("b", 1, 50, 5, 0.1, "match_rate_too_low"), ("c", 1, 7, 0, 0.0, "no_overlap")]
    kind = "run string, seq long, est_total long, matched long, match_rate double, error_code string"
    out = ev.for_every_run(report, spark.createDataFrame(rows, kind)).orderBy("run").collect()
    assert [(r.run, r.error_code, r.trans_rmse) for r in out] == [
        ("a", None, 0.5), ("b", "match_rate_too_low", None), ("c", "no_overlap", None)
    ]
