"""Brute-force checks of the shared plan shapes."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from posequery.plans.ordered import Scan, ordered_scan
from posequery.plans.quantiles import exact_quantiles


def test_ordered_scan_equals_plain_windows(spark):
    rng = random.Random(1)
    rows = []
    for key in ("hot", "cold"):
        stamps = sorted(rng.sample(range(-500, 2000), 400 if key == "hot" else 5))
        rows += [(key, t, rng.choice([None, rng.randint(-9, 9)])) for t in stamps]
    df = spark.createDataFrame(rows, "key string, t long, v long")
    for reverse in (False, True):
        scanned = ordered_scan(
            df,
            ["key"],
            ["t"],
            37,
            reverse=reverse,
            lagged=Scan("lag", F.col("v")),
            filled=Scan("last", F.col("v")),
            before=Scan("last_before", F.col("v")),
            total=Scan("sum", F.coalesce("v", F.lit(0))),
            top=Scan("max", F.col("v")),
        )
        order = Window.partitionBy("key").orderBy(F.desc("t") if reverse else F.asc("t"))
        upto = order.rowsBetween(Window.unboundedPreceding, 0)
        plain = df.select(
            "key",
            "t",
            "v",
            F.lag("v").over(order).alias("lagged"),
            F.last("v", True).over(upto).alias("filled"),
            F.last("v", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
            F.sum(F.coalesce("v", F.lit(0))).over(upto).alias("total"),
            F.max("v").over(upto).alias("top"),
        )
        assert sorted(map(tuple, scanned.select(plain.columns).collect()), key=str) == sorted(
            map(tuple, plain.collect()), key=str
        )


@pytest.mark.parametrize("once", [False, True])
def test_scans_of_both_directions_and_wider_lags(spark, once):
    rng = random.Random(4)
    stamps = {"hot": sorted(rng.sample(range(-300, 900), 200)), "cold": [5, 6, 600], "one": [1]}
    rows = [(key, t, rng.choice([None, rng.randint(-9, 9)])) for key, ts in stamps.items() for t in ts]
    df = spark.createDataFrame(rows, "key string, t long, v long")
    v = F.col("v")
    scanned = ordered_scan(
        df, ["key"], ["t"], 7, once=once,
        second=Scan("lag", v, offset=2), fifth=Scan("lag", v, offset=5),
        ahead=Scan("lag", v, offset=3, back=True), next=Scan("last", v, back=True), filled=Scan("last", v),
    )
    order = Window.partitionBy("key").orderBy("t")
    plain = df.select(
        "*", F.lag("v", 2).over(order).alias("second"), F.lag("v", 5).over(order).alias("fifth"),
        F.lead("v", 3).over(order).alias("ahead"),
        F.first("v", True).over(order.rowsBetween(0, Window.unboundedFollowing)).alias("next"),
        F.last("v", True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("filled"),
    )
    assert sorted(map(tuple, scanned.select(plain.columns).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_one_pass_scans_shuffle_their_input_once(spark, tmp_path):
    from posequery.operators.landmarks import predicted_pose
    from posequery.operators.timejoin import IMU_AXES, imu_segments, pose_at

    axes = [F.rand(1).alias(a) for a in IMU_AXES]
    ids = spark.range(4000)
    ids.select((F.col("id") % 3).alias("seq"), (F.col("id") * 5).alias("ts_ns"), *axes).write.parquet(f"{tmp_path}/imu")
    ids.select((F.col("id") % 3).alias("seq"), (F.col("id") * 5 + 2).alias("ts_ns")).write.parquet(f"{tmp_path}/images")
    pose = [F.rand(2).alias(c) for c in ("tx", "ty", "tz", "qx", "qy", "qz", "qw")]
    frames = ids.select((F.col("id") % 3).alias("seq"), F.col("id").alias("frame"), F.lit("ok").alias("status"), *pose)
    frames.write.parquet(f"{tmp_path}/frames")
    imu, images, frames = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("imu", "images", "frames"))
    poses = frames.select("seq", (F.col("frame") * 5).alias("ts_ns"), "tx", "ty", "tz")
    for found, scans in (
        (imu_segments(images, imu, 1000), 2),
        (pose_at(images, poses, 1000), 2),
        (predicted_pose(frames, 200), 1),
    ):
        plan = executed(found)
        assert plan.count("FileScan parquet") == scans, plan
        assert "ReusedExchange" in plan, plan


@pytest.mark.parametrize("kind", ["normal", "ties", "tiny", "wide", "integers"])
def test_exact_quantiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(5)
    draw = {
        "normal": lambda n: rng.normal(size=n),
        "ties": lambda n: rng.integers(-2, 3, n).astype(float),
        "tiny": lambda n: 1.0 + rng.integers(0, 50, n) * 2.0**-52,
        "wide": lambda n: np.exp(rng.uniform(-600, 600, n)) * rng.choice([-1, 1], n),
        "integers": lambda n: 1.4e18 + rng.integers(0, 10_000, n) * 256.0,
    }[kind]
    groups = {"a": draw(1001), "b": draw(200), "c": draw(1), "d": draw(2)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double").unionByName(
        spark.createDataFrame([("a", None), ("a", float("nan"))], "k string, v double")
    )
    wanted = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q95": 0.95, "q100": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", wanted).collect()}
    assert set(got) == set(groups)
    for key, values in groups.items():
        for name, q in wanted.items():
            assert got[key][name] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-300)
