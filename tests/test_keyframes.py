"""Keyframe rule cases, and the parallel batch form against a plain loop and the stream handler."""

import random
from types import SimpleNamespace

import numpy as np
import pytest

from posequery.operators import keyframes
from posequery.operators.keyframes import nested_frames, select_keyframes
from posequery.streaming.rules import KeyframeHandler, KeyframeRule, rotation_matrix

RULE = KeyframeRule(400.0, 400.0, 320.0, 240.0)
MS = 1_000_000


def frame(ts_ms, n, at, first_id=0, accepted=True, rotation=(0.0, 0.0, 0.0, 1.0), index=None):
    return SimpleNamespace(
        frame=ts_ms if index is None else index,
        ts_ns=ts_ms * MS,
        accepted=accepted,
        own_rotation=list(rotation),
        ids=list(range(first_id, first_id + n)) or None,
        us=[at[0]] * n,
        vs=[at[1]] * n,
    )


def decide(*frames):
    handler = KeyframeHandler(RULE)
    return [handler.feed(f)[0][1] for f in frames]


SEEDS = [frame(40, 12, (210, 60)), frame(95, 12, (260, 60))]


@pytest.mark.parametrize(
    "third, expected",
    [
        (frame(130, 12, (260, 60)), False),
        (frame(130, 12, (260, 89)), False),
        (frame(130, 12, (260, 91)), True),
        (frame(130, 12, (237, 78)), False),
        (frame(130, 12, (235, 78)), True),
        (frame(130, 12, (260, 60), first_id=4), False),
        (frame(130, 12, (260, 60), first_id=5), True),
        (frame(595, 12, (260, 60)), False),
        (frame(596, 12, (260, 60)), True),
        (frame(130, 9, (260, 60)), True),
        (frame(2595, 0, (0, 0)), False),
    ],
)
def test_rules(third, expected):
    assert decide(*SEEDS, third) == [True, True, expected]


def test_first_two_need_acceptance():
    lost = frame(15, 14, (30, 400), accepted=False)
    assert decide(lost, *[frame(t, 14, (30, 400)) for t in (55, 85, 140, 222)]) == [True, True, True, False, False]


def test_pure_rotation_is_no_parallax():
    half = 0.05
    turn = (0.0, np.sin(half), 0.0, np.cos(half))
    first = frame(100, 12, (320, 240))
    ray = rotation_matrix(np.array(turn)).T @ np.array([0.0, 0.0, 1.0])
    turned = (ray[0] / ray[2] * 400 + 320, ray[1] / ray[2] * 400 + 240)
    rows = [first, frame(150, 12, (320, 240)), frame(200, 12, (320, 240), rotation=turn), frame(250, 12, turned)]
    assert decide(*rows) == [True, True, False, False]
    rows[2] = frame(200, 12, (320, 240))
    assert decide(*rows) == [True, True, False, True]


@pytest.mark.parametrize("seed", range(3))
def test_batch_equals_loop(spark, seed, monkeypatch):
    monkeypatch.setattr(keyframes, "_GROUP", 3)  # groups of groups of chunks
    rng = random.Random(seed)
    frames, t = [], 0
    u, base = 100.0, 0
    for i in range(400):
        t += rng.choice([50, 50, 50, 60, 120, 700 if rng.random() < 0.1 else 50])
        u += rng.uniform(-2, 9)
        base += rng.choice([0, 0, 1, 2])
        n = rng.choice([12, 14, 16, 16, 16, 3 if rng.random() < 0.3 else 15, 0 if rng.random() < 0.2 else 15])
        half = rng.uniform(-0.01, 0.01)
        rotation = (0.0, float(np.sin(half)), 0.0, float(np.cos(half)))
        frames.append(frame(t, n, (u, 100.0), base, rng.random() < 0.8, rotation, i))
    handler = KeyframeHandler(RULE)
    want = [f.frame for f in frames if handler.feed(f)[0][1]]
    table = spark.createDataFrame(
        [(1, f.frame, f.ts_ns, "ok" if f.accepted else "rejected", *f.own_rotation) for f in frames],
        "seq long, frame long, ts_ns long, status string, qx double, qy double, qz double, qw double",
    )
    obs = spark.createDataFrame(
        [(1, f.frame, i, u_, v_) for f in frames for i, u_, v_ in zip(f.ids or [], f.us, f.vs)],
        "seq long, frame long, id long, u double, v double",
    )
    width = 2_000 * MS
    found = select_keyframes(nested_frames(table, obs, width), RULE, width)
    assert 0.1 < len(want) / len(frames) < 0.9
    assert sorted(r.frame for r in found.collect()) == want


def test_frames_of_a_chunk_are_compared_at_once():
    rng = np.random.default_rng(3)
    stamps = np.cumsum(rng.integers(20, 160, 60)) * MS
    seen = [np.sort(rng.choice(20, rng.integers(0, 15), replace=False)) for _ in stamps]
    pixels = [rng.uniform(0, 480, (2, len(ids))) for ids in seen]
    half = rng.uniform(-0.8, 0.8, len(stamps))
    turns = keyframes._rotations(np.stack([0 * half, np.sin(half), 0 * half, np.cos(half)], 1))
    sizes = np.array([len(ids) for ids in seen])
    rule = KeyframeRule(400.0, 400.0, 320.0, 240.0, min_tracks=1, min_survival=0.3, max_parallax_px=300.0)
    near = keyframes._compared(rule, stamps, sizes, turns, np.concatenate(seen), np.concatenate(pixels, 1))
    rows = [{"ts_ns": t, "ids": i, "uv": p, "rotation": r} for t, i, p, r in zip(stamps, seen, pixels, turns)]
    found, want = [], []
    for late, row in enumerate(rows):
        for early in range(late):
            if sizes[late] and stamps[late] - stamps[early] <= rule.max_interval_ns:
                common, moved = near.get(late * len(rows) + early, (0, False))
                found.append(common / max(sizes[early], 1) < rule.min_survival or moved)
                want.append(rule.wants(row, 2, rows[early]))
    assert found == want and 0.2 < np.mean(want) < 0.9 and any(m for _, m in near.values())
