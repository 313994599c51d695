"""Registered queries over all rows of their tables, to the last one."""

import os
import re
from collections import deque

import duckdb
import pytest

import __spark_entry__ as registry
import check
from catalog import streams
from catalog.runs import config
from posequery.fixtures import with_views

SF = "/root/testdata/sf0.001"


def test_stream_association_equals_the_batch_one(spark):
    queries = registry.queries()
    want = {(r.run, r.seq, r.ts_ns, r.gt_ts_ns) for r in queries["c1_associate"](spark, SF).collect()}
    got = [(r.run, r.seq, r.ts_ns, r.gt_ts_ns) for r in queries["i8_stream_associate"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want


def test_run_meta_has_every_key(spark):
    want = sorted((f"part-{r.run}", r.key, r.value) for r in config(spark, SF).collect())
    got = registry.queries()["a13_read_run_meta"](spark, SF).select("sequence", "key", "value").collect()
    assert sorted(map(tuple, got)) == want and len({key for _, key, _ in want}) == 4


def same_as_sql(spark, name):
    con = duckdb.connect()
    for table in check.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = registry.queries()[name](spark, SF)
    cursor = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(cursor.fetchall())
    return found


def test_residual_probe_counts_points_behind_the_camera(spark):
    assert same_as_sql(spark, "d16_residual_probe").count() == 10


def test_keyframes_by_all_rules(spark):
    same_as_sql(spark, "i3_keyframe_select_all_rules")


def test_sync_report_has_every_counter(spark):
    rows = registry.queries()["i2_stereo_sync_report"](spark, SF).collect()
    for r in rows:
        assert len(r) == 10 and r.overflow_left == r.overflow_right == 0
        for side in ("left", "right"):
            assert r[f"pushed_{side}"] == r.emitted + r[f"dropped_{side}"]
            assert 1 <= r[f"longest_{side}"] <= r[f"pushed_{side}"]


def equal_on(spark, name, folder):
    """Like :func:`same_as_sql`, over the tables a folder has, nulls included."""
    con = duckdb.connect()
    for table in check.TABLES:
        if os.path.exists(f"{folder}/{table}.parquet"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    cursor = con.execute(registry.oracle_sql()[name])
    found = registry.queries()[name](spark, str(folder)).select(*[d[0] for d in cursor.description])
    assert sorted(map(tuple, found.collect()), key=str) == sorted(cursor.fetchall(), key=str)


@pytest.mark.parametrize(
    "name",
    ["c5_exact_intersection_count", "g3_except_stamps", "a1_read_tum", "a1_read_tum_violations", "a2_write_tum"]
    + ["a3_read_camera_manifest", "a4_read_imu_csv", "a5_read_groundtruth_csv", "a6_open_sequences"],
)
def test_stamps_that_repeat(spark, tmp_path, name):
    # Every fifth event has the stamp and user of the one ten before.
    duckdb.execute(
        "COPY (SELECT event_id, CASE WHEN event_id % 5 = 3 AND event_id > 9 THEN lag(ts, 10) OVER w ELSE ts END AS ts, CASE WHEN event_id % 5 = 3 AND event_id > 9"
        " THEN lag(user_id, 10) OVER w ELSE user_id END AS user_id, event_type, value, props"
        f" FROM '{SF}/events.parquet' WINDOW w AS (ORDER BY event_id)) TO '{tmp_path}/events.parquet'"
    )
    equal_on(spark, name, tmp_path)


@pytest.mark.parametrize("name", ["a3_read_camera_manifest", "a4_read_imu_csv", "a5_read_groundtruth_csv", "a6_open_sequences"])
def test_stamps_before_the_epoch(spark, tmp_path, name):
    duckdb.execute(f"COPY (SELECT * REPLACE (ts - INTERVAL 60 YEAR AS ts) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet'")
    equal_on(spark, name, tmp_path)


def drained(stamps):
    """Counters of the reference's queues over ``(ts_ns, side)`` in push order, side 0 being left."""
    queues, pushed, dropped, longest, emitted = (deque(), deque()), [0, 0], [0, 0], [0, 0], 0
    for stamp, side in stamps:
        pushed[side] += 1
        queues[side].append(stamp)
        longest[side] = max(longest[side], len(queues[side]))
        while queues[0] and queues[1]:
            gap = queues[0][0] - queues[1][0]
            near = abs(gap) <= streams.SOFT_NS
            emitted += near
            for late in (0, 1) if near else (int(gap > 0),):
                queues[late].popleft()
                dropped[late] += not near
    dropped = [n + len(queue) for n, queue in zip(dropped, queues)]
    return dict(zip(streams.SYNC_COUNTS, (emitted, *pushed, *dropped, 0, 0, *longest)))


@pytest.mark.parametrize("name", ["d26_sync_report", "i2_stereo_sync_report", "i2_stereo_sync_resumed_report"])
def test_no_stamp_is_in_two_pairs(spark, tmp_path, name):
    # Several stamps of a sequence lie within the tolerance, on both sides of the middle of the month.
    duckdb.execute(
        "COPY (SELECT * REPLACE (TIMESTAMP '2024-01-16' + to_microseconds(70 * (event_id - 500)) AS ts)"
        f" FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet'"
    )
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    both = "SELECT seq, ts_ns, 0 AS side FROM v_left UNION ALL SELECT seq, ts_ns, 1 FROM v_right ORDER BY ts_ns, side"
    pushes = {}
    for seq, *push in con.execute(with_views("left", "right") + both).fetchall():
        pushes.setdefault(seq, []).append(push)
    found = registry.queries()[name](spark, str(tmp_path)).collect()
    assert {r.seq for r in found} == set(pushes) and len(found) == len(pushes)
    for r in found:
        want = drained(pushes[r.seq])
        assert {c: n for c, n in r.asDict().items() if c != "seq"} == {c: want[c] for c in want if c in r}


@pytest.mark.parametrize("name", ["i6_skip_drop_late_rows"])
def test_streams_in_many_small_files(spark, monkeypatch, name):
    monkeypatch.setattr(streams, "FILE_ROWS", 200)
    equal_on(spark, name, SF)


def test_a_file_of_a_stream_is_bounded(spark, monkeypatch):
    rows = spark.range(1000).selectExpr("CAST(id * id AS BIGINT) AS at")
    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    counts = [rows.where(c).count() for c in streams._slices(rows, "at")]
    assert sum(counts) == 1000 and max(counts) <= 110


def test_far_return_is_compiled(spark, capsys):
    # The virtual machine interprets methods over 8,000 bytes, at a fraction of the speed.
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        registry.queries()["h8_far_return"](spark, SF).explain(mode="codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000
