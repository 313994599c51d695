"""Operators that judge rows one by one, against libraries and brute force."""

import hashlib
import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from posequery.llm import language, packing, pieces, quality, token_counts, toxicity
from posequery.llm.common import coded

ODD = [None, "", " ", "a", "\n\n", "  b  c ", "word " * 300, "é" * 5000, "x\x1cy z", "<|endoftext|> it's", "中文 😀 ▁ <s>", "a\x00b"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i}", "clash") for i, t in enumerate(ODD)] + [(3, "a", None, "clash"), (None, "a", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, score string")


def noise(seed, n=400):
    rng = random.Random(seed)
    parts = ["ab", "te", "in", "ing", " ", "  ", "\n", "\t", ".", ",", "'s", "09", "é", "😀", "中", "ÿ", "<|endoftext|>", "▁", "THE", "\r", "　", "\x1c", "-="]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_pieces_equal_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    own, real = pieces.PieceTable(Path(path).read_bytes()), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in noise(1) + [t or "" for t in ODD]:
        ids = real.encode(text)
        assert own.encode(text.encode()) == ids
        assert own.decode(ids) == real.decode(ids)


def test_pieces_on_rows(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    real = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = pieces.encode(docs, Path(path).read_bytes(), decoded=True)
    assert sorted((r.decoded, tuple(r.ids)) for r in rows.collect()) == sorted(
        (real.decode(real.encode(r.text or "")), tuple(real.encode(r.text or ""))) for r in docs.collect()
    )
    assert pieces.decode(rows, Path(path).read_bytes()).count() == len(ODD) + 2
    assert pieces.encode(docs.limit(0), Path(path).read_bytes()).count() == 0


def test_byte_ids_equal_the_library():
    content = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
    own, real = packing.ByteEncoder(content), Tokenizer.from_str(content)
    for text in noise(2) + [t or "" for t in ODD]:
        assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == real.encode(text, add_special_tokens=False).ids


def test_packing_keeps_every_id_once(spark, docs):
    content = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
    real = Tokenizer.from_str(content)
    many = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 100)).where("doc_id IS NOT NULL AND doc_id NOT IN (3, 103)")
    rows = packing.pack(many.repartition(3), content, size=256, open_windows=2).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        have = found.setdefault(r.doc_id, [])
        assert r.start == len(have) and r.length == len(r.ids) // 4
        have += np.frombuffer(r.ids, "<u4").tolist()
        assert r.offset + r.length <= 256
    for r in many.collect():
        assert found[r.doc_id] == real.encode(r.text or "", add_special_tokens=False).ids + [1]
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert sum(n < 256 for n in sequences.values()) <= 1
    assert packing.pack(docs.limit(0), content).count() == 0


def test_token_counts_equal_the_library(docs):
    content = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()
    real = Tokenizer.from_str(content)
    for text in noise(3):
        assert token_counts.totals(real, {}, [text.encode()]) == [len(real.encode(text, add_special_tokens=False).ids)]
    rows = token_counts.count_tokens(docs, content, limit=100).collect()
    want = sorted((len((r.text or "").encode()), len(real.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in rows)


def longest(words):
    n = len(words)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def test_repeats_of_words_equal_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        texts = [" ".join(rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 30))).encode() for _ in range(4)]
        _, codes, offsets = coded(texts)
        assert quality.repeats(codes, offsets).tolist() == sum((longest(t.split()) for t in texts), [])


def test_quality_rows(spark, docs):
    clean = " ".join(f"w{i}" for i in range(200))
    twice = " ".join(f"v{i}" for i in range(60)) + " "
    more = spark.createDataFrame([(50, clean), (51, twice * 2), (52, clean + " " + " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.quality(docs.select("doc_id", "text").unionByName(more)).collect()}
    assert got[50].kept and not got[51].kept and got[52].longest_repeat == 60 and not got[52].kept and not got[52].base_failed
    assert got[0].n_words == 0 and got[0].base_failed and got[7].word_chars == 5000
    assert [r.doc_id for r in quality.keep(more).collect()] == [50]
    assert quality.keep(docs.limit(0)).count() == 0 and quality.quality(docs.limit(0)).count() == 0


def test_language_learns_and_handles_odd_rows(spark, docs):
    rng = random.Random(5)
    words = {"xx": ["the", "and", "thing", "over"], "yy": ["der", "und", "schön", "über"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(12)), x) for i, x in enumerate(["xx", "yy"] * 40)]
    filters = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert language.decide(filters, [b"thing and over", "schön über".encode(), b"12 %", "½".encode(), b""])[0] == ["xx", "yy", "und", "und", "und"]
    got = language.identify(docs, filters).collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r.score <= 1 and r.lang_pred in ("xx", "yy", "und") for r in got)
    none = language.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}


def test_bloom_slices_hold_their_members():
    rng = np.random.default_rng(6)
    members = [rng.integers(0, 2**63, 500, dtype=np.uint64) for _ in range(70)]
    filters = language.build([f"l{k}" for k in range(70)], members, 1 << 14)
    for k, hashes in enumerate(members):
        for place in language._places(hashes, 1 << 14):
            assert (filters.slots[place.astype(np.int64), k // 64] >> np.uint64(k % 64) & np.uint64(1)).all()


def test_toxicity_finds_a_planted_word(docs):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(400):
        words = [rng.choice(vocabulary) for _ in range(40)]
        if i % 4 == 0:
            words[rng.randrange(40)] = rng.choice(["vilest", "vilely"])
        texts.append(" ".join(words).encode())
        labels.append(float(i % 4 == 0))
    model = toxicity.train(texts[:300], np.array(labels[:300]), epochs=6)
    scores = toxicity.logits(model, texts[300:])
    cut = toxicity.calibrate(scores, np.array(labels[300:]), [""] * 100)[""]
    assert ((scores >= cut) == np.array(labels[300:], bool)).mean() > 0.95
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
