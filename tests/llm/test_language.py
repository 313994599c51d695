"""Language identification against plain loops over words and n-grams."""

import random

import numpy as np
import pytest

from posequery.llm import language, queries

SF = "/root/testdata/sf0.001"


def toy(languages=9):
    rng = random.Random(7)
    words = {f"l{k}": ["".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(1, 9))).encode() for _ in range(40)] for k in range(languages)}
    return words, language.build(list(words), [np.unique(language.grams(w)[0]) for w in words.values()], 1 << 12)


def plainly(filters, text):
    """Sums of one text: every n-gram of every word looked up on its own."""
    sums = np.zeros(len(filters.languages))
    for word in language.letters(text).split():
        hashes = language.grams([word])[0]
        for k, rate in enumerate(filters.false_positive):
            hits = 0
            for h in hashes:
                slots = [int(p[0]) for p in language._places(np.array([h], np.uint64), len(filters.slots))]
                hits += all(int(filters.slots[s, k // 64]) >> (k % 64) & 1 for s in slots)
            sums[k] += (hits - rate * len(hashes)) / max(1e-9, 1 - rate)
    return np.maximum(sums, 0)


def test_n_grams_are_those_of_the_bordered_word():
    for word in (b"a", b"ab", "sch\u00f6n".encode(), b"abcdefgh"):
        bordered = b" " + word + b" "
        want = [bordered[i : i + n] for n in language.SIZES for i in range(len(bordered) - n + 1)]
        assert len(language.grams([word])[0]) == len([g for g in want if g != b" "])


@pytest.mark.parametrize("cells", [0, 9 * 25, 1 << 20])
def test_decisions_equal_plain_loops_with_any_memory(cells):
    words, filters = toy()
    rng = random.Random(3)
    every = [w for own in words.values() for w in own]
    texts = [b" ".join(rng.choices(words[rng.choice(list(words))] + every, k=rng.randint(1, 30))) for _ in range(60)]
    texts += [b"", b"12 %", "\u00bd".encode(), b"a" * 3000, b"zz"]
    memory = language.Memory(filters, cells)
    for _ in range(2):  # a second turn reads what the first one kept
        langs, scores = language.decide(filters, texts, memory)
        for text, lang, score in zip(texts, langs, scores):
            sums = plainly(filters, text)
            alone = language.decide(filters, [text])
            assert (alone[0][0], alone[1][0]) == (lang, score)
            if lang == "und":
                assert score == 0
            elif sums.sum() > 1e-4:
                assert sums[filters.languages.index(lang)] >= sums.max() - 1e-3
                assert score == pytest.approx(sums.max() / sums.sum(), abs=1e-3)
        assert len(memory.index) <= len(memory.table) and all(len(w) <= language.LONGEST for w in memory.index)


def test_query_is_right_on_held_out_rows(spark):
    found = queries.QUERIES["op6_language"](spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").collect()
    assert found.count() == truth.count() == len(rows)
    judged = [r for r in rows if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert judged and sum(r.lang == r.lang_pred for r in judged) >= 0.95 * len(judged)
    assert all(0 <= r.score <= 1 for r in rows)


def test_partitions_do_not_matter(spark):
    _, filters = toy()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs.coalesce(1), filters).collect()}
    many = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs.repartition(7), filters).collect()}
    assert one == many
