"""Readers, writers and their rejects."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from posequery.operators import validate as vd
from posequery.sources import diagnostics as dg
from posequery.sources import runs as rn
from posequery.sources import heads
from posequery.sources import sensors as sn
from posequery.sources import trajectories as tr

GOOD = "1403636579.763555584 1 2 3 0 0 0 1"


def tum(spark, tmp_path, *lines, name="est.tum"):
    (tmp_path / name).write_text("\n".join(lines) + "\n")
    parsed = tr.read_tum(spark, str(tmp_path / name))
    codes = [(r.line, r.code, r.field) for r in parsed.violations.orderBy("line").collect()]
    return parsed.rows.orderBy("ts_ns").collect(), codes


def test_tum_reads_exact_stamps_and_skips_comments(spark, tmp_path):
    rows, codes = tum(
        spark, tmp_path, "# header", "", GOOD + "\r", "1403636579.8  1\t2 3 0 0 0 1.0005", "1403636580 1 2 3 0 0 1 0"
    )
    assert codes == []
    assert [r.ts_ns for r in rows] == [1403636579763555584, 1403636579800000000, 1403636580000000000]
    assert rows[1].qw == pytest.approx(1.0, abs=1e-15)


@pytest.mark.parametrize(
    "line, code, field",
    [
        ("1 2 3 0 0 0 1", "invalid_record", None),
        ("1 1 2 3 0 0 0 1 9", "invalid_record", None),
        ("abc 1 2 3 0 0 0 1", "invalid_record", "timestamp"),
        ("1.0000000001 1 2 3 0 0 0 1", "sub_nanosecond", "timestamp"),
        ("1.5 x 2 3 0 0 0 1", "invalid_field", "tx"),
        ("1.5 1 2 inf 0 0 0 1", "non_finite_measurement", "tz"),
        ("1.5 1 2 3 0 0 0 1.1", "non_unit_quaternion", "qx qy qz qw"),
        ("1.5 1 2 3 0 0 0 0", "non_unit_quaternion", "qx qy qz qw"),
    ],
)
def test_tum_rejects(spark, tmp_path, line, code, field):
    rows, codes = tum(spark, tmp_path, GOOD.replace("1403636579", "1"), line)
    assert codes == [(2, code, field)]
    assert len(rows) == 1


def test_tum_order_violations(spark, tmp_path):
    lines = [f"{t} 1 2 3 0 0 0 1" for t in ("2", "2", "1", "3")]
    rows, codes = tum(spark, tmp_path, *lines)
    assert codes == [(2, "duplicate_timestamp", "timestamp"), (3, "out_of_order_timestamp", "timestamp")]
    assert len(rows) == 2


def test_tum_round_trip_is_exact(spark, tmp_path):
    values = [(("a", 1, 1403636579763555584 + i, 0.1 + i, 1e-7 * i, -1e20, 0.0, 0.0, 0.6, 0.8)) for i in range(20)]
    names = "run string, seq long, ts_ns long, tx double, ty double, tz double, qx double, qy double, qz double, qw double"
    df = spark.createDataFrame(values, names)
    tr.write_tum(df, str(tmp_path / "out"))
    back = tr.read_tum(spark, str(tmp_path / "out")).rows.orderBy("ts_ns")
    assert [tuple(r) for r in back.select("ts_ns", "tx", "ty", "tz").collect()] == [v[2:6] for v in values]


@pytest.mark.parametrize("run", ["'a'", "concat('r', id % 3)", "CAST(NULL AS STRING)"])
def test_written_files_rise_whatever_order_the_rows_come_in(spark, tmp_path, run):
    rows = spark.range(3000).select(F.expr(run).alias("run"), (F.col("id") % 2).alias("seq"), ((3000 - F.col("id")) * 10**9).alias("ts_ns"))
    poses = rows.select("*", *[F.lit(x).alias(c) for c, x in zip(("tx", "ty", "tz", "qx", "qy", "qz", "qw"), (1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0))])
    tr.write_tum(poses, str(tmp_path / "tum"))
    parsed = tr.read_tum(spark, str(tmp_path / "tum"))
    assert parsed.violations.count() == 0
    assert sorted(parsed.rows.select("run", "seq", "ts_ns").collect(), key=str) == sorted(rows.collect(), key=str)
    dg.write_diag(rows, str(tmp_path / "diag"), {"ts_ns": "long"})
    for part in (tmp_path / "diag").rglob("*.csv"):
        stamps = [int(x) for x in part.read_text().split()[1:]]
        assert stamps == sorted(stamps)


def test_line_numbers_across_blocks(spark, tmp_path):
    from posequery.sources.lines import read_lines

    (tmp_path / "long.txt").write_text("".join(f"{i} {'x' * 90}\n" for i in range(60_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        lines = read_lines(spark, str(tmp_path / "long.txt"))
        wrong = lines.where(F.split("value", " ")[0].cast("long") + 1 != F.col("line"))
        assert lines.count() == 60_000 and wrong.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def recording(root, seq, sensor, header, *lines):
    folder = root / seq / "mav0" / sensor
    folder.mkdir(parents=True)
    (folder / "data.csv").write_text("\n".join([header, *lines]) + "\n")


def test_open_sequences(spark, tmp_path):
    recording(tmp_path, "s1", "cam0", sn.CAMERA_HEADER, "10,10.png", "20,20.png", "20,21.png", "30,a/b.png", "x,1.png", "40")
    recording(tmp_path, "s1", "cam1", "#wrong,header", "10,10.png", "99999999999999999999,1.png")
    recording(tmp_path, "s1", "imu0", sn.IMU_HEADER, "5,1,2,3,4,5,6", "6,1,2,3,4,5,nan", "7,1,2,3,4,5,6,7")
    recording(tmp_path, "s2", "cam0", sn.CAMERA_HEADER, "10,10.png")
    cameras, imu, missing = sn.open_sequences(spark, str(tmp_path))
    rows = {(r.seq, r.sensor, r.ts_ns) for r in cameras.rows.collect()}
    assert rows == {("s1", "cam0", 10), ("s1", "cam0", 20), ("s1", "cam1", 10), ("s2", "cam0", 10)}
    place = F.regexp_extract("file", r"/mav0/([^/]+)/", 1)
    codes = {tuple(r) for r in cameras.violations.select(place, "line", "code", "field").collect()}
    assert codes == {
        ("cam0", 4, "duplicate_timestamp", "timestamp"),
        ("cam0", 5, "invalid_field", "filename"),
        ("cam0", 6, "invalid_field", "timestamp"),
        ("cam0", 7, "invalid_column_count", None),
        ("cam1", 1, "invalid_header", "header"),
        ("cam1", 3, "timestamp_overflow", "timestamp"),
    }
    row = imu.rows.first()
    assert (row.ts_ns, row.wx, row.ax) == (5, 1.0, 4.0)
    assert {r.code for r in imu.violations.collect()} == {"non_finite_measurement", "invalid_column_count"}
    lacking = {tuple(r) for r in missing.where("member NOT LIKE '%yaml'").collect()}
    assert lacking == {("s2", "mav0/cam1/data.csv"), ("s2", "mav0/imu0/data.csv")}
    assert missing.where("member LIKE '%yaml'").count() == 6
    (tmp_path / "s1" / "dso").mkdir()
    (tmp_path / "s1" / "dso" / "camchain.yaml").write_text("cam0: {}\n")
    other = sn.open_sequences(spark, str(tmp_path), "tum_vi")[2].where("seq = 's1'")
    assert [r.member for r in other.collect()] == ["dso/imu_config.yaml"]


def test_groundtruth(spark, tmp_path):
    folder = tmp_path / "s1" / "mav0" / "state_groundtruth_estimate0"
    folder.mkdir(parents=True)
    rest = ",".join("0" for _ in range(9))
    lines = [tr.GROUNDTRUTH_HEADER, f"10,1,2,3,1.0001,0,0,0,{rest}", f"20,1,2,3,0,0,0,0,{rest}", "30,1"]
    (folder / "data.csv").write_text("\n".join(lines) + "\n")
    parsed = tr.read_groundtruth(spark, str(folder / "data.csv"))
    row = parsed.rows.first()
    assert (row.seq, row.ts_ns, row.qw) == ("s1", 10, 1.0)
    got = [(r.line, r.code, r.field) for r in parsed.violations.orderBy("line").collect()]
    assert got == [(3, "invalid_field", "q_RS"), (4, "invalid_column_count", None)]


def png(width, height, depth=8, color=0):
    body = b"IHDR" + struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + body + struct.pack(">I", zlib.crc32(body))


def test_image_inventory_reads_headers(spark, tmp_path):
    images = {"1.png": png(752, 480), "2.png": png(640, 480), "3.png": png(752, 480, 16), "4.png": png(752, 480, 8, 2), "5.png": b"junk", "9.png": png(752, 480)}
    folder = tmp_path / "s1" / "mav0" / "cam0" / "data"
    folder.mkdir(parents=True)
    for name, content in images.items():
        (folder / name).write_bytes(content)
    files = spark.read.format("binaryFile").load(str(folder)).select(
        F.lit("s1").alias("seq"),
        F.lit("cam0").alias("sensor"),
        F.regexp_extract("path", "([^/]+)$", 1).alias("filename"),
        "content",
    )
    manifest = spark.createDataFrame(
        [("s1", "cam0", f"{i}.png") for i in (1, 2, 3, 4, 5, 6)], "seq string, sensor string, filename string"
    )
    read = sn.read_image_heads(spark, str(tmp_path))
    assert {r.filename: r.content for r in read.collect()} == {name: content[:33] for name, content in images.items()}
    assert sorted(sn.image_inventory(manifest, read, 752, 480).collect()) == sorted(sn.image_inventory(manifest, files, 752, 480).collect())
    gone = read.select("seq", "sensor", "filename", "path").withColumn("path", F.when(F.col("filename") == "1.png", F.concat("path", F.lit(".not"))).otherwise(F.col("path")))
    heads_ = heads.read_heads(gone.withColumn("path", F.when(F.col("filename") == "9.png", "odd://x/9.png").otherwise(F.col("path"))))
    errors = {r.filename: r.error for r in heads_.collect() if r.error}
    assert errors["1.png"] == "missing" and errors["9.png"].startswith("unreadable") and len(errors) == 2
    assert ("1.png", "unreadable") in {(r.filename, r.issue) for r in sn.image_inventory(manifest, heads_, 752, 480).collect()}
    got = {r.filename: r.issue for r in sn.image_inventory(manifest, files, 752, 480).collect()}
    assert got == {
        "2.png": "wrong_size",
        "4.png": "wrong_depth",
        "5.png": "not_png",
        "6.png": "missing_file",
        "9.png": "orphan_file",
    }


def test_diag_of_different_age(spark, tmp_path):
    names = list(dg.DIAG_COLUMNS)
    row = ["10", "ok", *["1"] * 18]
    for folder, keep in (("new", 20), ("old", 18)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "diag.csv").write_text(",".join(names[:keep]) + "\n" + ",".join(row[:keep]) + "\n")
    got = {r.is_keyframe for r in dg.read_diag(spark, str(tmp_path / "*" / "diag.csv")).collect()}
    assert got == {True, None}


def summary(**changes):
    base = {
        "status": "completed",
        "sequence": "MH_01",
        "code": {"git_commit_short": "abc", "git_dirty": False},
        "config_label": "default",
        "config_hash": "12345678",
        "trajectory": {"completion_rate": 0.5, "coverage_rate": 1.0, "segments": 2},
        "ate": {"trans": {"rmse": 0.0809641}},
        "rpe": None,
        "robustness": {"reanchors": 1},
        "timing": {"wall_s": 458.2, "rtf": None},
    }
    return json.dumps({**base, **changes}, indent=2)


def test_run_summaries_and_table(spark, tmp_path):
    files = {
        "b": summary(sequence="V1_01"),
        "a": summary(ate="broken", code=None, git_commit_short="old"),
        "c": "{not json",
        "d": "[1, 2]",
        "e": summary(trajectory={"segments": "many"}, config_label=""),
    }
    for name, text in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "summary.json").write_text(text)
    rows, skipped = rn.read_run_summaries(spark, str(tmp_path))
    assert sorted(r.path.split("/")[-2] for r in skipped.collect()) == ["c", "d"]
    table = rn.bench_table(rows).collect()
    assert [(r.sequence, r.commit) for r in table] == [("MH_01", "abc"), ("MH_01", "old"), ("V1_01", "abc")]
    assert table[0].segments == "" and table[0].config == "default_12345678"
    assert table[1].ate_trans_rmse == ""
    assert (table[2].ate_trans_rmse, table[2].wall_s, table[2].rtf) == ("0.0809641", "458.2", "")
    line = rn.markdown_lines(rn.bench_table(rows)).collect()[2].value
    assert line.startswith("| V1_01 | abc | no | default_12345678 | completed | 0.0809641 |  | 0.5 | 1 | 2 | 1 |")
    assert len(rn.markdown_header()) == 2


@pytest.mark.parametrize(
    "exists, dirty, force, expected",
    [
        (False, False, False, "write"),
        (False, True, True, "write"),
        (True, False, False, "refuse"),
        (True, True, False, "overwrite_with_warning"),
        (True, False, True, "overwrite_with_warning"),
    ],
)
def test_overwrite_matrix(spark, exists, dirty, force, expected):
    decision = rn.overwrite_decision(F.lit(exists), F.lit(dirty), force)
    assert spark.range(1).select(decision.alias("d")).first().d == expected


def test_ledger_keeps_other_runs(spark, tmp_path):
    path = str(tmp_path / "ledger")
    fields = "sequence string, commit string, dirty boolean, config_label string, config_hash string, ate double"
    first = [("s1", "c1", False, "d", "h", 1.0), ("s2", "c1", True, "d", "h", 2.0), ("", "c1", False, "d", "h", 9.0)]
    plan = rn.write_run_ledger(spark.createDataFrame(first, fields), path)
    assert sorted(r.decision for r in plan.collect()) == ["invalid_key", "write", "write"]
    second = [("s1", "c1", False, "d", "h", 5.0), ("s2", "c1", True, "d", "h", 6.0), ("s2", "c2", False, "d", "h", 7.0)]
    plan = rn.write_run_ledger(spark.createDataFrame(second, fields), path)
    assert sorted(r.decision for r in plan.collect()) == ["overwrite_with_warning", "refuse", "write"]
    spark.catalog.clearCache()
    got = {r.run_key: r.ate for r in spark.read.parquet(path).collect()}
    assert got == {"s1/c1/d_h": 1.0, "s2/c1_dirty/d_h": 6.0, "s2/c2/d_h": 7.0}


def test_strict_policy_raises(spark):
    bad = spark.createDataFrame([("f", 3, 7, "duplicate_timestamp", "timestamp"), ("f", 2, 6, "x", "y")], "file string, line long, ts_ns long, code string, field string")
    assert vd.first_error(bad, ["file"]).first().line == 2
    with pytest.raises(vd.ValidationError):
        vd.require_valid(bad, ["file"])
    vd.require_valid(bad.limit(0), ["file"])
