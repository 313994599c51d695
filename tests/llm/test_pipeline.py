"""The corpus pipeline over odd rows and columns, stage by stage and as a whole."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from posequery.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"wort{i}" for i in range(4000)]


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def near(text, seed):
    words = text.split()
    words[random.Random(seed).randrange(len(words))] = "anders"
    return " ".join(words)


PASSAGE = prose(99, 70)
BASE = prose(1)
ROWS = [
    (1, BASE), (2, BASE), (3, BASE.replace(" ", "  ", 3)), (4, near(BASE, 5)), (5, prose(2)), (6, prose(3) + " " + PASSAGE),
    (7, prose(4) + " " + PASSAGE + " " + prose(5, 60)), (8, None), (9, ""), (10, "zu kurz"), (11, "immer gleich " * 200), (12, prose(6, 180_000)),
]


def documents(spark, rows=ROWS):
    full = [(i, t, "de", "s", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


CLASHES = ("spans", "_row_key", "_spans", "kept", "class_id", "_key", "Recipe", "anchor", "start", "ids", "length", "sequence_id", "n_words")


@pytest.fixture(scope="module")
def clashing(spark):
    return documents(spark).withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id")) for c in CLASHES})


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.mark.parametrize(
    "name, gone",
    [("quality rules", {8, 9, 10, 11}), ("exact duplicates", {2, 3, 9}), ("near duplicates", {2, 3, 4}), ("repeated passages", set())],
)
def test_stages_keep_all_columns(spark, clashing, name, gone):
    found = stage(name)(spark, clashing, None)
    assert found.columns == clashing.columns
    rows = found.collect()
    assert {r.doc_id for r in rows} == {i for i, _ in ROWS} - gone
    assert all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in CLASHES)


def test_packing_ignores_other_columns(spark, clashing):
    assert {r.doc_id for r in stage("packing")(spark, clashing, None).collect()} == {i for i, _ in ROWS}


def test_passages_go_and_lengths_follow(spark, clashing):
    texts = {r.doc_id: r for r in stage("repeated passages")(spark, clashing, None).collect()}
    assert PASSAGE[5:-5] not in texts[6].text and PASSAGE[5:-5] not in texts[7].text and prose(3)[:150] in texts[6].text
    assert texts[5].text == prose(2) and texts[8].text is None and texts[8].n_chars is None and texts[12].text == prose(6, 180_000)
    assert all(r.n_chars == len(r.text) for r in texts.values() if r.text is not None)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_and_repeated_rows(spark, name):
    empty = documents(spark, [])
    assert stage(name)(spark, empty, None).count() == 0
    twice = documents(spark, [(None, BASE), (None, BASE), (5, prose(2)), (5, prose(2)), (5, prose(7))])
    n = stage(name)(spark, twice, None).count()
    assert n == (3 if "duplicates" in name else 5) or name == "packing" and n > 5  # a document may be cut


def test_whole_pipeline(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {1, 5, 6, 7, 12}
    per_sequence = {}
    for r in pieces:
        per_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in per_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_registered_near_duplicates_with_repeated_ids(spark, tmp_path):
    rows = [(1, BASE), (1, BASE), (None, near(BASE, 4)), (2, prose(2)), (None, None)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op1_near_duplicates(spark, str(tmp_path)).collect()
    assert sorted(r.class_size for r in found) == [1, 1, 3, 3, 3] and sum(r.kept for r in found) == 3
