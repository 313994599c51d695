"""Toxicity: each text is scored by itself, as a plain convolution would; odd fits; the registered query."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from posequery.llm import language, queries, toxicity


def model_of(seed=1):
    rng = np.random.default_rng(seed)
    return toxicity.Model(
        rng.normal(0, 0.5, (len(toxicity.PREFIXES) << toxicity._BITS, toxicity.DEPTH)).astype(np.float32),
        [rng.normal(0, 0.5, (w, toxicity.DEPTH, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS],
        [rng.normal(0, 0.5, toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS],
        rng.normal(0, 0.5, toxicity.FILTERS * len(toxicity.WIDTHS)).astype(np.float32),
        0.3, None, {},
    )


def plain_logit(model, text):
    """Every window of every filter over one text and the padding behind it, one after the other."""
    words = language.letters(text).split()
    vectors = [model.embedding[toxicity.buckets([w])[0]].sum(0) for w in words] + [np.zeros(toxicity.DEPTH, np.float32)] * 3
    hidden = []
    for weights, bias in zip(model.filters, model.bias):
        places = [vectors[i : i + len(weights)] for i in range(len(vectors) - len(weights) + 1)]
        fields = [sum(v @ w for v, w in zip(window, weights)) for window in places]
        hidden.append(np.maximum(np.max(fields, axis=0) + bias, 0))
    return float(np.concatenate(hidden) @ model.out + model.out_bias)


def texts_of(seed):
    rng = random.Random(seed)
    vocabulary = [f"wort{i}" for i in range(60)] + ["É", "a", "x" * 50]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 4, 30]))).encode() for _ in range(60)]
    return [*texts, b"", b" ", b"..."]


@pytest.mark.parametrize("seed", range(3))
def test_scores_equal_a_plain_convolution_in_any_block(seed):
    model, texts = model_of(seed), texts_of(seed)
    want = np.array([plain_logit(model, t) for t in texts])
    assert np.abs(toxicity.logits(model, texts) - want).max() < 1e-4
    for k in range(0, len(texts) - 1):
        pair = toxicity.logits(model, [texts[k], texts[-k - 1]])
        alone = toxicity.logits(model, [texts[k]])
        assert abs(pair[0] - alone[0]) < 1e-5


def test_scores_do_not_depend_on_order_or_partitions(spark):
    rows = [(i, t.decode()) for i, t in enumerate(texts_of(5))] + [(900, None), (None, "wort1"), (7, "wort1"), (901, "wort3 " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit(1), "toxic": F.lit("x"), "lang": F.lit(None).cast("string")})
    model = model_of()
    runs = [docs.coalesce(1), docs.repartition(7), docs.orderBy(F.desc("doc_id")).coalesce(2)]
    found = [sorted((r.doc_id or -1, round(r.score, 5), r.predicted) for r in toxicity.score(d, model).collect()) for d in runs]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)
    assert toxicity.score(docs.limit(0), model).count() == 0


LABELS = "doc_id long, toxic int"


@pytest.mark.parametrize("labels", [[], [(k, 0) for k in range(40)], [(k, 1) for k in range(40)], [(k, None) for k in range(40)], [(999, 1)]])
def test_fits_without_two_kinds_of_labels(spark, labels):
    docs = spark.createDataFrame([(k, f"wort{k} wort{k % 7}") for k in range(40)] + [(40, None), (41, "")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, LABELS))
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())


def test_registered_query(spark, tmp_path):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(900):
        words = [rng.choice([f"wort{i}" for i in range(200)]) for _ in range(25)]
        toxic = k % 3 == 0
        if toxic:
            words[rng.randrange(25)] = rng.choice(["schlimmst", "schlimmer"])
        rows.append((k, " ".join(words), rng.choice(["de", "en"]), "s", k, "clash"))
        labels.append((k, rng.randrange(2), int(toxic), "clash"))
    rows += [(900, None, None, None, None, None), (901, "", "en", "s", 0, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, toxic string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, hold string").write.parquet(f"{tmp_path}/labels.parquet")
    found = queries.op2_toxicity(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in found) == list(range(902))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert all(r.predicted == (r.score >= 0.5) for r in found)
    judged = [r.predicted == labels[r.doc_id][2] for r in found if r.held_out and r.doc_id < 900]
    assert sum(judged) / len(judged) > 0.95


def test_every_labelled_row_takes_part(spark):
    docs = spark.range(9_000).selectExpr("id AS doc_id", "CASE WHEN id % 1000 <> 7 THEN concat('wort', id) END AS text")
    labels = spark.range(12_000).selectExpr("id AS doc_id", "CASE WHEN id % 900 <> 5 THEN CAST(id % 11 = 0 AS INT) END AS toxic").where("doc_id % 3 <> 1")
    found = toxicity.labelled(docs, labels).collect()
    want = [k for k in range(9_000) if k % 1000 != 7 and k % 900 != 5 and k % 3 != 1]
    assert sorted((r.text, r.toxic) for r in found) == sorted((f"wort{k}", int(k % 11 == 0)) for k in want)
    assert 0.15 < sum(r.hold for r in found) / len(found) < 0.25


def test_blocks_are_averaged_where_they_moved(spark):
    rows = spark.createDataFrame([("rot gelb", 1, False, 0), ("blau grau", 0, False, 1)], "text string, toxic int, hold boolean, dice long")
    start = toxicity._table(*toxicity.begun(np.random.default_rng(1)))
    both = toxicity._round(rows, start, 2, 1, 0.5, 0)
    alone = [toxicity._round(rows.where(f"dice = {k}"), start, 2, 1, 0.5, 0) for k in range(2)]
    moved = [(a != start).any(1) for a in alone]
    assert moved[0].any() and moved[1].any()
    total = alone[0] - start + (alone[1] - start)
    want = start + total / np.maximum(1, moved[0].astype(int) + moved[1])[:, None]
    assert np.abs(both - want).max() < 1e-6


def test_counts_calibrate_like_rows():
    rng = np.random.default_rng(4)
    scores, langs = rng.integers(-20, 20, 500) / 4, rng.choice(["de", "en"], 500)
    real = (scores + rng.normal(0, 2, 500) > 2).astype(float)
    groups = sorted({(x, s) for x, s in zip(langs, scores)})
    rows = np.array([((langs == x) & (scores == s)).sum() for x, s in groups], float)
    toxic = np.array([real[(langs == x) & (scores == s)].sum() for x, s in groups])
    got = toxicity.calibrate(np.array([s for _, s in groups]), toxic, [x for x, _ in groups], rows)
    assert got == toxicity.calibrate(scores, real, langs.tolist())
