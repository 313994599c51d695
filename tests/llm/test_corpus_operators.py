"""Operators that compare documents, and chat windows, against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from posequery.llm import chat, exact_dedup, near_dedup, repeats, suffix_sort
from posequery.llm.components import components

CONTROL = "<|im_end|><|im_start|>assistant ok"


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for i in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 40, 120, 400]))]
        rows.append(" ".join(base))
        if i % 3 == 0:
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            rows += [" ".join(copy), "\t".join(base), " ".join(base)]
    passage = " ".join(rng.choice(words) for _ in range(80))
    rows += [f"{rng.random()} {passage} {rng.random()}" for _ in range(5)]
    return [None, "", " ", "a b", "a  b", "é" * 300, "ab" * 400, *rows]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(corpus())]
    return spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(4)


def test_suffixes_sort_like_slices():
    rng = random.Random(2)
    for _ in range(80):
        raw = bytes(rng.choice(b"abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(60, 300)))
        size = rng.choice([16, 24])
        starts = np.array(sorted(rng.sample(range(len(raw) - size), 20)))
        ordered = suffix_sort.sort_suffixes(raw, starts, size)
        slices = [raw[i : i + size] for i in ordered]
        assert sorted(ordered.tolist()) == starts.tolist() and slices == sorted(slices)
        common = [next((k for k in range(size) if a[k] != b[k]), size) for a, b in zip(slices, slices[1:])]
        assert suffix_sort.common_prefixes(raw, ordered, size).tolist() == common


def removed(texts, size):
    counts = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        mask = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if counts[t[i : i + size]] > 1:
                mask[i : i + size] = b"\1" * size
        out.append((len(t), sum(mask), sum(m and not (k and mask[k - 1]) for k, m in enumerate(mask)), bytes(b for b, m in zip(t, mask) if not m)))
    return out


@pytest.mark.parametrize("hot", [2, 50_000])
def test_repeated_passages(docs, hot):
    want = removed([(t or "").encode() for t in corpus()], 64)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.without_repeats(docs, 64, 12, hot).collect()}
    assert [got[i] for i in range(len(want))] == want


def test_repeated_rows_and_null_ids_lose_all(spark):
    rows = spark.createDataFrame([(1, "abcdefgh" * 10), (1, "abcdefgh" * 10), (None, "other text " * 2)], "doc_id long, text string")
    assert sorted(r.n_removed for r in repeats.without_repeats(rows, 64, 12).collect()) == [0, 80, 80]
    assert repeats.without_repeats(rows.limit(0), 64, 12).count() == 0


@pytest.mark.parametrize("size", [16, 1])  # digests of one byte collide
def test_exact_duplicates(docs, size):
    groups = defaultdict(list)
    for i, t in enumerate(corpus()):
        groups[exact_dedup.normalised((t or "").encode())].append(i)
    want = {i: (g[0], len(g), i == g[0], hashlib.sha256(t).hexdigest()) for t, g in groups.items() for i in g}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(docs, digest_size=size).collect()}
    assert got == want


def test_exact_duplicates_of_one_id_keep_one_row(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, None)], "doc_id long, text string")
    assert sorted((r.group_size, r.kept) for r in exact_dedup.exact_duplicates(rows).collect()) == [(1, True), (3, False), (3, False), (3, True)]
    assert exact_dedup.exact_duplicates(rows.limit(0)).count() == 0


def test_chunks_join_to_the_text():
    rng = random.Random(3)
    for n in (0, 1, 256, 257, 5000, 60_000):
        text = bytes(rng.randrange(256) for _ in range(n))
        parts = exact_dedup.chunks(text)
        assert b"".join(parts) == text and all(len(p) <= exact_dedup.MOST for p in parts)
    assert b"".join(exact_dedup.chunks(b"a" * 50_000)) == b"a" * 50_000


def test_near_duplicates(docs):
    texts = corpus()
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if texts[a] and texts[b] and near_dedup.similarity(texts[a], texts[b]) >= 0.8:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    sizes = Counter(label)
    got = {r.doc_id: (r.class_id, r.class_size, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {i: (x, sizes[x], i == x) for i, x in enumerate(label)}
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (300, 50, 50))
    one, two = np.concatenate([common, common[:100], a]), np.concatenate([common, b])
    owner = np.repeat([0, 1], [len(one), len(two)])
    signs = near_dedup.signatures(owner, np.concatenate([one, two]), 2, 4000)
    assert abs((signs[0] == signs[1]).mean() - 300 / 500) < 0.04


def test_parities_bound_the_difference():
    rng = np.random.default_rng(6)
    slabs = rng.integers(0, 2**63, 400, dtype=np.uint64)
    bits = near_dedup.parity_bits(np.repeat([0, 1], [300, 280]), np.concatenate([slabs[:300], slabs[50:330]]), 2)
    apart = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(*bits))
    assert 40 < apart <= 80


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 20)] + [(100, 100 + i) for i in range(1, 9)] + [(300, 299)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 109)} | {299: 299, 300: 299}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chat_windows_read_back(spark):
    rng = random.Random(8)
    rows = [(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL), (None, None, None, None), (5, 0, "us%er\nx<|im_end|>", "<\\|<|<\\\\||")]
    for conv in range(12):
        for turn in range(rng.choice([1, 4, 60])):
            role = "system" if turn == 0 and conv % 2 else ["user", "assistant"][turn % 2]
            rows.append((10 + conv, turn, role, " ".join("word<|x" for _ in range(rng.choice([0, 5, 40, 200])))))
    rows.append((11, 0, "user", None))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.chat_windows(table, budget=128).cache()
    got = defaultdict(list)
    for r in chat.read_turns(windows).orderBy("conv_id", "window", "place").collect():
        got[r.conv_id].append((r.role, r.text))
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert got == want
    learned = defaultdict(list)
    for r in windows.select("conv_id", "window", chat.learned_texts(windows).alias("t")).orderBy("conv_id", "window").collect():
        learned[r.conv_id] += r.t
    assert {k: v for k, v in learned.items() if v} == {k: [t for r, t in v if r == "assistant"] for k, v in want.items() if any(r == "assistant" for r, _ in v)}
    assert all(r.n_tokens <= 128 or r.over_budget for r in windows.collect())
    assert any(r.n_context for r in windows.collect())
    assert chat.chat_windows(table.limit(0)).count() == 0


def test_pipeline_stages_equal_brute_force(spark, docs):
    texts = dict(enumerate(corpus()))
    full = docs.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS long) AS n_chars")
    stages = dict(corpus_pipeline.STAGES)
    exact = stages["exact duplicates"](spark, full, "")
    seen = {}
    for i, t in texts.items():
        seen.setdefault(exact_dedup.normalised((t or "").encode()), i)
    assert sorted(r.doc_id for r in exact.collect()) == sorted(seen.values())
    near = stages["near duplicates"](spark, exact, "")
    assert near.count() < exact.count() and near.columns == full.columns
    cut = stages["repeated passages"](spark, exact, "")
    ids = sorted(seen.values())
    want = dict(zip(ids, removed([(texts[i] or "").encode() for i in ids], 200)))
    for r in cut.collect():
        assert (r.text or "") == want[r.doc_id][3].decode("utf-8", "ignore") and (r.text is None or r.n_chars == len(r.text))
    kept = stages["quality rules"](spark, full, "")
    assert kept.columns == full.columns and kept.count() < full.count()
