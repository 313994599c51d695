"""JSON values, maps side by side, weighted quantiles and counters against plain Python."""

import json
import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from posequery.functions import nested
from posequery.operators import ledger as lg
from posequery.operators import tracks as tk
from posequery.plans.quantiles import counted_values, exact_quantiles


def test_values_at_paths(spark):
    documents = [
        {"a": {"b": 3}, "n": "2.5", "s": ""}, {"a": {"b": "x"}, "n": True, "s": "t"}, {"a": 7, "n": None}, [1], {"n": {"deep": 1}},
    ]
    rows = [(k, json.dumps(d)) for k, d in enumerate(documents)] + [(5, "{"), (6, None), (7, "{}")]
    d = F.col("d")
    found = (
        spark.createDataFrame(rows, "k int, text string")
        .select("k", nested.parsed(F.col("text")).alias("d"))
        .select(
            "k",
            nested.is_object(d).alias("ok"),
            nested.found_at(d, ["a.b", "missing"], "long", -1).alias("b"),
            nested.found_at(d, "n", "double").alias("n"),
            nested.found_at(d, "s", "string", "none", blank=False).alias("s"),
        )
        .orderBy("k")
        .collect()
    )
    assert [r.ok for r in found] == [True, True, True, False, True, False, False, True]
    assert [r.b for r in found] == [3, -1, -1, -1, -1, -1, -1, -1]
    assert found[0].n == 2.5 and [r.n for r in found[2:]] == [None] * 6
    assert [r.s for r in found] == ["none", "t", "none", "none", "none", "none", "none", "none"]


def test_differing_keys(spark):
    pairs = [({"a": "1", "b": "2"}, {"b": "3", "c": "4"}), ({"a": "1"}, {"a": "1"}), (None, {"z": "9"}), ({"x": None}, {}), (None, None)]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, l map<string,string>, r map<string,string>")
    found = {r.k: [tuple(e) for e in r.d] for r in rows.select("k", nested.differing(F.col("l"), F.col("r")).alias("d")).collect()}
    assert found[0] == [("a", "1", None), ("b", "2", "3"), ("c", None, "4")]
    assert found[1] == found[3] == found[4] == [] and found[2] == [("z", None, "9")]


def test_largest_shifts(spark):
    rows = spark.createDataFrame([([5, 2, 9, 1], [0.5, 0.7, None, 0.7]), ([], []), (None, None)], "ids array<long>, dt array<double>")
    found = [r.top and [tuple(e) for e in r.top] for r in rows.select(nested.largest_shifts(F.col("ids"), F.col("dt"), 2).alias("top")).collect()]
    assert found == [[(1, 0.7), (2, 0.7)], [], None]


def test_a_value_that_fills_most_rows_is_one_row(spark):
    rng = random.Random(3)
    values = [0.0] * 4000 + [rng.uniform(-5, 5) for _ in range(900)] + [-0.0, float("nan"), float("inf"), None]
    rows = spark.createDataFrame([("g", v) for v in values], "k string, v double").repartition(8)
    counted = counted_values(rows, ["k"], "v")
    assert counted.count() == 901 and counted.agg(F.max("_w")).first()[0] == 4001
    finite = [v for v in values if v is not None and np.isfinite(v)]
    found = exact_quantiles(rows, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.97}).first()
    assert np.allclose([found.a, found.b, found.c], np.quantile(finite, [0.05, 0.5, 0.97]))


def test_histogram_counts_every_row(spark):
    values = [3] * 500 + list(range(20)) + [None] * 4
    rows = spark.createDataFrame([("g", v) for v in values] + [("one", 8)], "k string, v int")
    found = lg.histogram(rows.where("v IS NOT NULL"), ["k"], "v", bins=10).orderBy("k", "bin").collect()
    counts, edges = np.histogram([v for v in values if v is not None], bins=10)
    own = {r.bin: (r.n, r.edge) for r in found if r.k == "g"}
    assert [own[b][0] for b in range(10)] == counts.tolist() and np.allclose([own[b][1] for b in range(10)], edges[:-1])
    assert [(r.n, r.edge) for r in found if r.k == "one"] == [(1, 8.0)]


def test_frontend_metrics_in_one_pass(spark):
    rng = random.Random(8)
    rows = [(s, f, rng.randint(1, 9), *[1] * len(tk.STATUSES), rng.random(), rng.random() + 1) for s in (1, 2) for f in range(30)]
    names = ["seq long", "frame long", "tracks long", *(f"{s} long" for s in tk.STATUSES), "epipolar_median_px double", "epipolar_p95_px double"]
    found = {r.seq: r for r in tk.frontend_totals(spark.createDataFrame(rows, ", ".join(names))).collect()}
    for s in (1, 2):
        own = [r for r in rows if r[0] == s]
        assert abs(found[s].epipolar_median_px - statistics.median(r[-2] for r in own)) < 1e-12
        assert abs(found[s].epipolar_p95_px - np.quantile([r[-1] for r in own], 0.95)) < 1e-12


def test_detector_totals(spark):
    rows = spark.createDataFrame([(1, 10, 4, 2), (1, 20, 6, 3), (2, 0, 0, 0)], "seq long, tracked long, detected long, fb_rejected long")
    found = {r.seq: r for r in tk.detector_totals(rows).collect()}
    assert (found[1].frames, found[1].tracked, found[1].detected, found[1].fb_rejected) == (2, 30, 10, 5)
    assert found[1].rejected_share == 5 / 35 and found[1].new_share == 0.25 and found[2].rejected_share is None


def test_pnp_switch_and_unique_culls(spark):
    frames = [("a", 1, f, f * 10, "ok", 1 + (f > 3), f % 2, f % 3 == 0, False, True, "", 2, 0, f % 2) for f in range(8)]
    schema = (
        "run string, seq long, frame long, ts_ns long, status string, segment_id long, num_shared long, pnp_success boolean,"
        " low_connectivity boolean, is_keyframe boolean, message string, outliers_culled long, num_cheirality long, outlier_reopt_rounds int"
    )
    table = spark.createDataFrame(frames, schema)
    culls = spark.createDataFrame([("a", 1, 2, 7), ("a", 1, 3, 7), ("a", 1, 3, 8)], "run string, seq long, frame long, id long")
    row = lg.frame_counts(table, culls=culls).first()
    assert (row.outliers_culled_unique, row.outlier_reopts, row.pnp_fallbacks) == (2, 4, 3)
    assert lg.frame_counts(table, pnp_init=False).first().pnp_fallbacks == 0
