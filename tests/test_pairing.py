"""Stereo pairing: analytic cases, brute force, and batch against push order."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest

from posequery.operators import timejoin as tj
from posequery.streaming.rules import SyncHandler

STAMPS = "seq long, ts_ns long"


def sides(spark, left, right):
    return (
        spark.createDataFrame([(1, t) for t in left], STAMPS),
        spark.createDataFrame([(1, t) for t in right], STAMPS),
    )


def two_pointer(left, right, tolerance):
    out, i, j = [], 0, 0
    while i < len(left) and j < len(right):
        gap = left[i] - right[j]
        if abs(gap) <= tolerance:
            out.append((left[i], right[j]))
            i, j = i + 1, j + 1
        elif gap < 0:
            i += 1
        else:
            j += 1
    return out


def soft(spark, left, right, tolerance, width=50):
    rows = tj.pair_soft(*sides(spark, left, right), tolerance, width).collect()
    return sorted((r.ts_ns, r.right_ts_ns) for r in rows)


def test_greedy_is_not_nearest(spark):
    assert soft(spark, [0, 5], [4], 9) == [(0, 4)]


@pytest.mark.parametrize("seed", range(4))
def test_soft_pairing_matches_two_pointers(spark, seed):
    rng = random.Random(seed)
    left = sorted(rng.sample(range(600), rng.randint(20, 150)))
    right = sorted(rng.sample(range(600), rng.randint(20, 150)))
    tolerance = rng.choice([0, 1, 3, 8])
    assert soft(spark, left, right, tolerance) == two_pointer(left, right, tolerance)


def test_exact_pairs_and_counters(spark):
    left, right = sides(spark, [10, 20, 40], [10, 20, 30, 40, 50, 60, 70])
    pairs = tj.pair_exact(left, right)
    assert sorted(r.ts_ns for r in pairs.collect()) == [10, 20, 40]
    report = tj.sync_report(left, right, pairs).first()
    assert (report.emitted, report.dropped_left, report.dropped_right) == (3, 0, 4)
    assert tj.intersection_count(left, right).first().common == 3


def fed(handler, rows):
    return [out for camera, stamp in rows for out in handler.feed(SimpleNamespace(camera=camera, ts_ns=stamp))]


@pytest.mark.parametrize("seed", range(6))
def test_handler_equals_two_pointers_in_any_interleaving(seed):
    rng = random.Random(100 + seed)
    left, right = (sorted(rng.sample(range(400), rng.randint(1, 90))) for _ in "lr")
    tolerance = rng.choice([0, 2, 7, 30])
    queues = {"left": list(left), "right": list(right)}
    handler, out = SyncHandler(tolerance), []
    while queues["left"] or queues["right"]:
        side = rng.choice([s for s in queues if queues[s]])
        out += fed(handler, [(side, queues[side].pop(0))])
        again = SyncHandler(tolerance)
        again.load(handler.dump())
        handler = again
    pairs = [(a, b) for kind, a, b, _, _ in out if kind == "pair"]
    assert pairs == two_pointer(left, right, tolerance)
    (report,) = fed(handler, [("end", 0)])
    counts = report[-1]
    assert report[3] is None and counts["emitted"] == len(pairs)
    for side, stamps in (("left", left), ("right", right)):
        assert counts[f"pushed_{side}"] == len(stamps) == len(pairs) + counts[f"dropped_{side}"]
        assert counts[f"overflow_{side}"] == 0


@pytest.mark.parametrize("seed", range(6))
def test_rows_of_a_trigger_at_once_equal_one_by_one(seed):
    rng = random.Random(200 + seed)
    tolerance = rng.choice([0, 2, 7, 30])
    rows = [(rng.choice(["left", "right"]), stamp) for stamp in range(400) if rng.random() < 0.6]
    rows[-20] = ("right", 5)  # a fault, at which it ends
    one, many, pairs = SyncHandler(tolerance), SyncHandler(tolerance), []
    want = [(a, b) for kind, a, b, _, _ in fed(one, rows[:-20]) if kind == "pair"]
    for start in range(0, len(rows), 50):
        batch = pd.DataFrame(rows[start : start + 50], columns=["camera", "ts_ns"])
        taken, out = many.take(batch)
        assert taken == min(len(batch), len(rows) - 20 - start)
        pairs += zip(out["ts_ns"].tolist(), out["right_ts_ns"].tolist()) if out else []
        if taken < len(batch):
            break
    assert pairs == want and many.dump() == one.dump()


def test_bounded_queue_counts_what_it_gives_up():
    handler = SyncHandler(0, max_queue=3)
    out = fed(handler, [("right", 7 * k) for k in range(8)] + [("left", 14), ("left", 42), ("end", 0)])
    assert [o[1:3] for o in out if o[0] == "pair"] == [(42, 42)]
    counts = out[-1][-1]
    assert (counts["overflow_right"], counts["longest_right"]) == (5, 3)
    assert (counts["dropped_left"], counts["dropped_right"]) == (1, 2)


@pytest.mark.parametrize(
    "bad, status", [(("left", 31), "duplicate"), (("left", 12), "out_of_order"), (("rear", 90), "invalid")]
)
def test_first_fault_answers_all_that_follows(bad, status):
    out = fed(SyncHandler(), [("left", 31), ("right", 31), bad, ("right", 77), ("left", 77), ("end", 0)])
    assert [o[0] for o in out] == ["pair", "fault", "fault", "fault", "report"]
    assert {o[3] for o in out[1:]} == {status}


@pytest.mark.parametrize("options", [(-3,), (0, 0)])
def test_handler_rejects_options(options):
    with pytest.raises(ValueError):
        SyncHandler(*options)


def test_repeated_stamps_count_in_pairs(spark):
    left, right = sides(spark, [1, 5, 5, 9], [5, 5, 5, 9, 12])
    assert [tuple(r) for r in tj.intersection_count(left, right).collect()] == [(1, 7)]


def test_soft_pairing_slides_no_frame_over_the_tolerance(spark, monkeypatch):
    # A frame of a fixed width costs as many rows a row as the tolerance spans.
    plans, counters = [], tj.counters
    monkeypatch.setattr(tj, "counters", lambda rows, *rest: plans.append(rows._jdf.queryExecution().toString()) or counters(rows, *rest))
    assert soft(spark, range(0, 90, 3), range(1, 90, 2), 40) == two_pointer(range(0, 90, 3), range(1, 90, 2), 40)
    assert len(plans) == 1 and "RangeFrame" not in plans[0]
