"""Replay order on streams, stream state taken over from a batch, restarts, and the bounded counter."""

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from posequery.operators import timejoin as tj
from posequery.plans import clamps
from posequery.streaming import replay
from posequery.streaming import stateful as st
from posequery.streaming.rules import SyncHandler

MS = 1_000_000


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Every partition of a stateful stream starts a worker of its own in each trigger."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


EVENTS = "seq long, ts_ns long, kind string, sensor string, cause string"


def event(ms, kind, seq=1, sensor=None, cause=None):
    return (seq, ms * MS, kind, sensor or kind, cause)


def run(spark, folder, batches, schema, build, per_run=True):
    """Rows of the stream after feeding ``batches``, from one checkpoint; one run a batch or one for all."""
    source = f"{folder}/in"
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        if per_run or k == len(batches) - 1:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
            writer = build(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
            writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").collect()


def replayed(spark, tmp_path, batches, lateness_ms=100):
    rows = run(spark, tmp_path, batches, EVENTS, lambda s: replay.ordered_replay(s, lateness_ms))
    placed = sorted((r for r in rows if r.position is not None), key=lambda r: (r.seq, r.position))
    return placed, [r for r in rows if r.position is None]


def test_order_is_restored_across_triggers(spark, tmp_path):
    batches = [
        [event(50, "right"), event(50, "left"), event(10, "imu")],
        [event(50, "imu"), event(20, "left"), event(400, "imu"), event(350, "left", seq=2)],
        [event(390, "right"), event(380, "left")],
        [event(400, "end"), event(352, "end", seq=2), event(351, "imu", seq=2)],
    ]
    placed, rest = replayed(spark, tmp_path, batches)
    assert not rest
    assert [(r.position, r.ts_ns // MS, r.kind) for r in placed if r.seq == 1] == [
        (0, 10, "imu"), (1, 20, "left"), (2, 50, "imu"), (3, 50, "left"), (4, 50, "right"),
        (5, 380, "left"), (6, 390, "right"), (7, 400, "imu"), (8, 400, "end"),
    ]
    assert [(r.ts_ns // MS, r.kind, r.state) for r in placed if r.seq == 2] == [(350, "left", "event"), (351, "imu", "event"), (352, "end", "end")]


def test_timers_let_go_without_an_end(spark, tmp_path):
    placed, rest = replayed(spark, tmp_path, [[event(t, "imu") for t in (30, 10, 20)], [event(5000, "left", seq=9)], [event(6000, "left", seq=9)]])
    assert [(r.seq, r.ts_ns // MS) for r in placed][:3] == [(1, 10), (1, 20), (1, 30)] and not rest


def test_read_error_is_not_a_clean_end_and_stays(spark, tmp_path):
    batches = [
        [event(10, "left"), event(10, "error", sensor="right", cause="record=2: not an image"), event(20, "imu"), event(20, "end")],
        [event(30, "left"), event(40, "end")],
    ]
    placed, rest = replayed(spark, tmp_path, batches)
    assert [(r.kind, r.state) for r in placed] == [("left", "event"), ("error", "error")]
    assert placed[1].sensor == "right" and placed[1].cause == "record=2: not an image"
    assert sorted((r.ts_ns // MS, r.kind, r.state) for r in rest) == [
        (20, "end", "after error"), (20, "imu", "after error"), (30, "left", "after error"), (40, "end", "after error"),
    ]


def test_rows_after_a_clean_end_and_late_ones_are_told(spark, tmp_path):
    batches = [
        [event(250, "imu"), event(251, "end"), event(5, "imu", seq=2), event(300, "imu", seq=2)],
        [event(252, "imu"), event(310, "imu", seq=2), event(311, "sonar", seq=2)],
        [event(150, "imu", seq=2), event(320, "end", seq=2)],
        [event(315, "left", seq=2)],
    ]
    placed, rest = replayed(spark, tmp_path, batches)
    assert [(r.seq, r.ts_ns // MS, r.state) for r in placed] == [
        (1, 250, "event"), (1, 251, "end"), (2, 5, "event"), (2, 150, "event"), (2, 300, "event"), (2, 310, "event"), (2, 320, "end"),
    ]
    assert sorted((r.seq, r.ts_ns // MS, r.state) for r in rest) == [(1, 252, "after end"), (2, 311, "unknown"), (2, 315, "after end")]


@pytest.mark.parametrize("seed", range(2))
def test_any_arrival_within_the_lateness(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [event(t, k, seq) for seq in (1, 2) for k in ("imu", "left", "right") for t in rng.sample(range(1, 3000), 60)]
    arrival = sorted(rows, key=lambda r: r[1] + rng.randrange(90 * MS))
    batches = [arrival[k : k + 60] for k in range(0, len(arrival), 60)] + [[event(3001, "end", 1), event(3001, "end", 2)]]
    placed, rest = replayed(spark, tmp_path, batches)
    want = sorted(((r[0], r[1], replay.RANKS[r[2]]) for r in rows))
    assert not rest and [(r.seq, r.ts_ns, replay.RANKS[r.kind]) for r in placed if r.kind != "end"] == want


PUSHES = "seq long, camera string, ts_ns long, arrival long"


def pushes(left, right, seq=1):
    rows = [(seq, "left", t, 4 * t) for t in left] + [(seq, "right", t, 4 * t + 1) for t in right]
    return sorted(rows, key=lambda r: r[3])


def sync_rows(rows):
    pairs = sorted((r.seq, r.ts_ns, r.right_ts_ns) for r in rows if r.kind == "pair")
    return pairs, {r.seq: dict(r.counts) for r in rows if r.kind == "report"}


@pytest.mark.parametrize("max_queue", [None, 2])
def test_stream_goes_on_from_a_batch_and_after_a_restart(spark, tmp_path, max_queue):
    rng = random.Random(4)
    left, right = (sorted(rng.sample(range(900), 120)) for _ in "lr")
    rows = pushes(left, right) + pushes(right, left, 2)
    end = [(s, "end", 900, 9000) for s in (1, 2)]
    build = lambda s, initial=None: st.stereo_sync(s, 3, max_queue, initial)
    slices = [[r for r in rows if low <= r[2] < low + 300] for low in (0, 300, 600)]
    whole = sync_rows(run(spark, f"{tmp_path}/once", [*slices, end], PUSHES, build, per_run=False))
    again = sync_rows(run(spark, f"{tmp_path}/many", [*slices, end], PUSHES, build))
    assert whole == again
    early = [spark.createDataFrame([(r[0], r[2]) for r in slices[0] if r[1] == side], "seq long, ts_ns long") for side in ("left", "right")]
    state = tj.sync_state(tj.sync_steps(*early, 3, 50, max_queue))
    resumed = sync_rows(run(spark, f"{tmp_path}/resumed", [*slices[1:], end], PUSHES, lambda s: build(s, state)))
    assert resumed[1] == whole[1]
    assert resumed[0] == [p for p in whole[0] if max(p[1:]) >= 300]


@pytest.mark.parametrize("seed, max_queue", [(0, None), (1, 1), (2, 3), (3, None)])
def test_batch_counters_equal_the_handler(spark, monkeypatch, seed, max_queue):
    monkeypatch.setattr(clamps, "_GROUP", 3)  # groups of groups of chunks
    rng = random.Random(seed)
    left, right = (sorted(rng.sample(range(2000), rng.choice([40, 700]))) for _ in "lr")
    tolerance = rng.choice([0, 2, 15])
    handler = SyncHandler(tolerance, max_queue)
    out = [o for r in pushes(left, right) for o in handler.feed(SimpleNamespace(camera=r[1], ts_ns=r[2]))]
    (report,) = handler.feed(SimpleNamespace(camera="end", ts_ns=0))
    stamps = [spark.createDataFrame([(1, t) for t in side], "seq long, ts_ns long") for side in (left, right)]
    steps = tj.sync_steps(*stamps, tolerance, 16 + tolerance, max_queue)
    assert {k: v for k, v in tj.steps_report(steps).first().asDict().items() if k != "seq"} == report[-1]
    pairs = sorted((r.ts_ns, r.right_ts_ns) for r in tj.pairs_of(steps).collect())
    assert pairs == sorted(o[1:3] for o in out if o[0] == "pair")


def test_composed_steps_equal_a_walk():
    rng = np.random.default_rng(0)
    n = 400
    add, low = rng.integers(-3, 4, n), rng.integers(-6, 2, n)
    high = low + rng.integers(0, 7, n)
    first = np.maximum.accumulate(np.where(rng.random(n) < 0.05, np.arange(n), 0))
    a, lo, hi = clamps.composed(add, low, high, first)
    for start in (-9, 0, 5):
        x = start
        for i in range(n):
            x = start if first[i] == i else x
            x = min(high[i], max(low[i], x + add[i]))
            assert x == min(hi[i], max(lo[i], start + a[i]))


def test_one_long_stretch_is_spread(spark):
    left = spark.range(40_000).select(F.lit(1).cast("long").alias("seq"), (F.col("id") * 10).alias("ts_ns"))
    right = left.withColumn("ts_ns", F.col("ts_ns") + 3)
    steps = tj.sync_steps(left, right, 25, 5_000)  # 80 chunks, no gap above the tolerance
    report = tj.steps_report(steps).first()
    assert (report.emitted, report.dropped_left, report.longest_left) == (40_000, 0, 1)


class Held:
    """A state of one key, kept in memory."""

    def __init__(self):
        self.rows = None

    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.rows

    def update(self, row):
        self.rows = row

    put = update

    def appendList(self, rows):
        self.rows = [*(self.rows or []), *rows]

    def clear(self):
        self.rows = None


def test_only_the_span_of_the_lateness_waits():
    waiting, at = Held(), Held()
    handle = SimpleNamespace(getListState=lambda *_: waiting, getValueState=lambda *_: at, registerTimer=lambda _: None)
    processor = replay._Replay(100)
    processor.init(handle)
    rows = pd.DataFrame([event(t, "imu") for t in random.Random(3).sample(range(1000), 1000)], columns=[c.split()[0] for c in EVENTS.split(", ")])
    out = pd.concat(processor.handleInputRows((1,), iter([rows]), None))
    kept = len(waiting.get())
    assert kept <= 101 and out["position"].tolist() == [*range(1000 - kept)]
    assert out["ts_ns"].tolist() == [t * MS for t in range(1000 - kept)]
