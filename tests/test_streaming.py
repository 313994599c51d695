"""Streams over several micro-batches, and the registry against its SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
import check
from posequery.streaming import stateful as st

SF = "/root/testdata/sf0.001"
EVENTS = "seq long, camera string, ts_ns long, arrival long"


def feed(spark, tmp_path, batches, build):
    """Run the stream once per batch from one checkpoint."""
    source = str(tmp_path / "in")
    for batch in batches:
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        job = (
            build(stream)
            .writeStream.format("parquet")
            .option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True)
            .start()
        )
        job.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_sync_state_survives_batches_and_faults_stick(spark, tmp_path):
    batches = [
        [(1, "left", 10, 1), (2, "left", 5, 1), (2, "left", 5, 2)],
        [(1, "right", 10, 2), (1, "left", 20, 3), (2, "right", 5, 3)],
        [(1, "end", 0, 4), (2, "end", 0, 4)],
    ]
    rows = feed(spark, tmp_path, batches, st.stereo_sync)
    assert [(r.seq, r.ts_ns, r.right_ts_ns) for r in rows if r.kind == "pair"] == [(1, 10, 10)]
    faults = [(r.seq, r.status) for r in rows if r.kind == "fault"]
    assert faults == [(2, "duplicate"), (2, "duplicate")]
    reports = {r.seq: r for r in rows if r.kind == "report"}
    assert reports[1].counts["emitted"] == 1 and reports[1].counts["dropped_left"] == 1
    assert reports[2].status == "duplicate" and reports[2].counts["dropped_left"] == 1


def test_late_rows_stop_a_sequence(spark, tmp_path):
    batches = [
        [(1, "left", 10, 5)],
        [(1, "right", 10, 4), (2, "left", 1, 1)],
        [(1, "right", 10, 6), (2, "right", 1, 2), (1, "end", 0, 7), (2, "end", 0, 3)],
    ]
    rows = feed(spark, tmp_path, batches, st.stereo_sync)
    assert [(r.seq, r.ts_ns) for r in rows if r.kind == "pair"] == [(2, 1)]
    assert sorted((r.seq, r.fault_place, r.fault) for r in rows if r.fault) == [(1, 4, "late"), (1, 6, "stopped")]
    assert {r.seq: r.status for r in rows if r.kind == "report"} == {1: "late", 2: None}


def test_registry_is_consistent():
    queries, oracles = registry.queries(), registry.oracle_sql()
    assert set(oracles) <= set(queries)
    missing = set(queries) - set(oracles)
    assert {m for m in missing if not m.startswith("op") and m != "pipeline"} == set()


SAMPLE = [
    "c1_associate",
    "c2_rpe_partner",
    "d3_ate",
    "c7_imu_segments",
    "d8_frame_stats",
    "d12_frame_counts",
    "d19_config_hash",
    "e8_presence_age",
    "i5_window_eviction",
    "i3_keyframe_select",
    "b4_check_calibration",
    "h7_undistort",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in check.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cursor = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got = check._rows(df.columns, [tuple(r) for r in df.collect()])
    want = check._rows(columns, cursor.fetchall())
    assert len(got) == len(want) > 0
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or math.isclose(x, y, abs_tol=2e-6)


def test_entry_runs(spark):
    assert registry.entry(spark).count() == 10


def test_plans_prune_columns(spark):
    df = registry.queries()["d23_extent"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(event_type" in plan or "PushedFilters: [Or(" in plan or "event_type" in plan
    assert "props" not in plan and "value" not in plan.split("ReadSchema")[1]


def test_presence_age_rules(spark):
    from posequery.operators.tracks import presence_age

    frames = [0, 1, 2, 3, 4, 6, 7]
    obs = spark.createDataFrame([(1, 9, f) for f in frames], "seq long, id long, frame long")
    marks = spark.createDataFrame([(1, 9, f) for f in (1, 2, 7, 5)], "seq long, id long, frame long")
    rows = presence_age(obs, marks, max_age=3, width=2).orderBy("frame").collect()
    assert [(r.frame, r.age, r.dropped) for r in rows] == [(1, 1, False), (2, 2, False), (3, 3, True), (7, 1, False)]


def test_run_divergence_and_gaps(spark):
    from posequery.operators import ledger as lg

    pose = "seq long, ts_ns long, tx double, ty double, tz double"
    a = spark.createDataFrame([(1, t, float(t), 0.0, 0.0) for t in range(5)], pose)
    b = a.withColumn("tx", F.when(F.col("ts_ns") >= 3, F.col("tx") + 2).otherwise(F.col("tx")))
    rows = lg.run_divergence(a, b).orderBy("ts_ns").collect()
    assert [(r.first_ns, r.ts_ns, r.apart_m) for r in rows] == [(3, 3, 2.0), (3, 4, 2.0)]
    stamps = [0, 50, 100, 200, 300, 350, 550]
    s = spark.createDataFrame([(1, t) for t in stamps], "seq long, ts_ns long")
    rows = lg.stream_gaps(s, ["seq"], 50, 70, 128).orderBy("from_ns").collect()
    assert [(r.from_ns, r.to_ns, r.intervals, r.missing) for r in rows] == [(100, 300, 2, 2), (350, 550, 1, 3)]


def test_marks_for_eviction_in_batch_and_handler(spark):
    from types import SimpleNamespace

    from posequery.operators.tracks import evict_lowest_ids, mark_evictable
    from posequery.streaming.rules import EvictableHandler

    present = {0: [1, 2, 3], 1: [1, 2, 3], 2: [1, 3], 3: [1, 2, 3], 5: [1, 2], 6: [1, 2]}
    culled = {0: [1, 2], 1: [9, 3], 3: [3], 5: [1, 2]}
    obs = spark.createDataFrame([(1, f, i) for f, ids in present.items() for i in ids], "seq long, frame long, id long")
    culls = spark.createDataFrame([(1, f, i) for f, ids in culled.items() for i in ids], "seq long, frame long, id long")
    marked = mark_evictable(obs, culls, min_culled=2, width=2)
    want = [(1, 1), (1, 2), (2, 1), (2, 3), (3, 1), (3, 3), (6, 1), (6, 2)]
    assert sorted((r.frame, r.id) for r in marked.where("evictable").collect()) == want
    handler = EvictableHandler(2)
    out = []
    for f, ids in present.items():
        again = EvictableHandler(2)
        again.load(handler.dump())
        handler = again
        out += handler.feed(SimpleNamespace(frame=f, ids=ids, culled=culled.get(f)))
    assert out == want
    room = evict_lowest_ids(marked, 3).collect()
    assert sorted((r.frame, r.id) for r in room) == [(1, 1), (1, 2), (2, 1), (2, 3), (3, 1), (3, 3), (6, 1), (6, 2)]


def packed_rows(rows):
    """Frames with lists as a state handler gets them: flat values, and where a row's begin."""
    import numpy as np
    import pandas as pd

    batch, lists = pd.DataFrame({"frame": [r.frame for r in rows]}), {}
    for name in ("ids", "culled"):
        parts = [getattr(r, name) or [] for r in rows]
        batch[f"{name}_n"] = [len(p) for p in parts]
        batch[f"{name}_at"] = batch[f"{name}_n"].cumsum() - batch[f"{name}_n"]
        lists[name] = np.array([i for p in parts for i in p])
    back = batch.iloc[::-1].sort_values("frame")  # rows come in any order, values stay where they are
    return back, lists


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("rule", ["skip_drop", "evictable"])
def test_frames_of_a_trigger_at_once_equal_one_by_one(rule, seed):
    import random
    from types import SimpleNamespace

    from posequery.streaming.rules import EvictableHandler, SkipDropHandler

    rng = random.Random(seed)
    least, top = rng.choice([0, 1, 2, 3]), rng.choice([-1, 0, 1, 3])
    make = (lambda: SkipDropHandler(least, top)) if rule == "skip_drop" else (lambda: EvictableHandler(least))
    frames = [f for f in range(300) if rng.random() < 0.9]
    rows = []
    for f in frames:
        ids = rng.choice([None, [], *([rng.sample(range(10**12, 10**12 + 9), rng.randint(1, 9))] * 12)])
        culled = rng.choice([None, [rng.choice([*(ids or []), 10**12 + 4]) for _ in range(rng.randint(0, 4))]])
        rows.append(SimpleNamespace(frame=f, ids=ids, culled=culled))
    one, many = make(), make()
    while rows:
        n = rng.choice([1, 2, 40])
        want = [out for r in rows[:n] for out in one.feed(r)]
        taken, out = many.take(*packed_rows(rows[:n]))
        assert taken == len(rows[:n]) and many.dump() == one.dump()
        assert list(zip(*(list(c) for c in out.values()))) == want
        again, rows = make(), rows[n:]
        again.load(many.dump())
        many = again


def test_frames_reach_the_state_handler_in_arrays(spark):
    schema = "seq long, frame long, culled array<long>"
    rows = spark.createDataFrame([(s, f, [f, 7] if f % 3 else None if f % 2 else []) for f in range(200) for s in (None, 1, 4)], schema)
    packed = st._packed(rows.coalesce(1)).collect()
    assert sorted((r.seq is None, r.seq) for r in packed) == [(False, 1), (False, 4), (True, None)]
    for r in packed:
        assert r.frame == [*range(200)] and r.culled_n == [2 if f % 3 else 0 for f in range(200)]
        assert r.culled == [i for f in range(200) if f % 3 for i in (f, 7)]


def test_frames_gather_their_observations_once(spark, monkeypatch):
    from catalog import streams

    plans = []
    monkeypatch.setattr(streams, "cut", lambda df, *_: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    assert streams.nested(spark, SF, "seq", "frame", "ids", "culled").columns == ["seq", "frame", "ids", "culled"]
    assert plans[0].count("l_orderkey") and plans[0].count("Relation [l_orderkey") == 1


def test_marks_compute_their_observations_once(spark):
    from pyspark.sql import functions as F

    from posequery.operators.tracks import mark_evictable

    computed = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    obs = spark.range(60).selectExpr("1L AS seq", "id DIV 3 AS frame", "id % 3 AS id").mapInArrow(told, "seq long, frame long, id long")
    culls = spark.range(4).select(F.lit(1).cast("long").alias("seq"), (F.col("id") % 2).alias("frame"), F.col("id"))
    assert mark_evictable(obs, culls, min_culled=2, width=4).where("evictable").count() == 56
    assert computed.value == 60


def test_seed_is_gathered_over_poor_frames(spark):
    from posequery.operators.tracks import GATHERING, admission_gates

    #        frame, key, stereo, ids
    frames = [(0, True, 2, [1, 2]), (1, True, 2, [2, 3]), (2, True, 9, [4]), (3, True, 2, [1, 5]), (4, False, 2, [6, 7]), (5, True, 2, [5, 6]), (6, True, 1, [8, 9])]
    rows = [(1, f, f * 10, "rejected", 5, 0, stereo, 3, key) for f, key, stereo, _ in frames]
    table = spark.createDataFrame(
        rows, "seq long, frame long, ts_ns long, status string, num_obs long, bad_obs long, num_disparity long, num_shared long, is_keyframe boolean"
    )
    obs = spark.createDataFrame([(1, f, i, 1.0) for f, _, _, ids in frames for i in ids], "seq long, frame long, id long, disparity double")
    found = {r.frame: r.rejection for r in admission_gates(table, width=2, min_seed=5, seed_obs=obs).collect()}
    assert found[0] == found[1] == found[3] == found[5] == GATHERING
    assert found[2] is None and found[4].startswith("not initialised") and found[6] is None
