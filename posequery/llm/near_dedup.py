"""Near duplicates by weighted Jaccard similarity of word shingles, found with DartMinHash.

The plane of an element has its weight on one axis and ranks on the other.  A hash throws darts
of density one at it: how many fall into a cell, their ranks, and the signature coordinate each
belongs to follow from the element and the cell alone.  A document keeps the darts within
its elements' weights (here the number of times a shingle occurs) and, per coordinate, the
earliest.  Ranks are opened only as far as the document's total weight requires, so a
signature costs about ``k log k`` darts and one look at each element.

Coordinates are compared in bands.  Documents of one bucket are compared with a leader, linked
pairs are joined to components, and only buckets that still hold several components are looked at
again, at last pair by pair across components.  There parities of
hashed shingles bound from below how much two texts differ, which keeps groups of loose copies from
being paired out.  Every link is verified on whole texts.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from math import exp, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posequery.llm.common import coded, keyed, map_blocks, record, texts_of
from posequery.llm.components import components
from posequery.session import cut

WORDS, LEAST_SIMILAR = 5, 0.8
BANDS, ROWS = 28, 5
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Parity bits of a text, in 64-bit words: enough for texts of several hundred words to differ visibly.
_WORDS = [f"bits_{k}" for k in range(32)]
#: Ends of the rank cells below 1; cells of length 1 follow.
_CELLS = (0.0, 2.0**-5, 2.0**-4, 2.0**-3, 2.0**-2, 2.0**-1, 1.0)


def mix(x: np.ndarray) -> np.ndarray:
    """A mixing of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _poisson(mean: float) -> np.ndarray:
    """Bounds of a 64-bit hash between 0, 1, 2, ... darts in a cell of area ``mean``."""
    total, term, bounds = 0.0, exp(-mean), []
    for k in range(1, 24):
        total += term
        bounds.append(min(int(total * 2.0**64), 2**64 - 1))
        term *= mean / k
    return np.array(bounds, np.uint64)


_BOUNDS = {b - a: _poisson(b - a) for a, b in zip(_CELLS, _CELLS[1:])} | {1.0: _poisson(1.0)}


def shingles(codes: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of every shingle; a text of fewer than five words is one shingle."""
    n = np.diff(offsets)
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(codes)) - offsets[:-1][owner]
    own = hashes[codes]
    size = np.minimum(n, WORDS)[owner]
    value = np.zeros(len(codes), np.uint64)
    for j in range(WORDS):
        ahead = np.zeros(len(codes), np.uint64)
        ahead[: max(0, len(codes) - j)] = own[j:]
        value = np.where(j < size, mix((value + ahead) * _A + np.uint64(j + 1)), value)
    starts = place + size <= n[owner]
    return owner[starts], value[starts]


def occurrences(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of each occurrence of a shingle: one per unit of an element's weight."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    place = np.arange(len(owner))
    again = np.zeros(len(owner), bool)
    again[1:] = (owner[1:] == owner[:-1]) & (hashes[1:] == hashes[:-1])
    nth = place - np.maximum.accumulate(np.where(again, 0, place))
    return owner, mix(hashes + _A * (nth.astype(np.uint64) + np.uint64(1)))


def parity_bits(owner: np.ndarray, slabs: np.ndarray, texts: int) -> np.ndarray:
    """2,048 bits per text, a row of 64-bit words, each the parity of the shingles that hash to it.

    Two texts differ in at least as many shingles as bits.
    """
    place = (slabs % np.uint64(64 * len(_WORDS))).astype(np.int64)
    out = np.zeros(texts * len(_WORDS), np.uint64)
    np.bitwise_xor.at(out, owner * len(_WORDS) + place // 64, np.uint64(1) << (place % 64).astype(np.uint64))
    return out.reshape(texts, len(_WORDS))


def signatures(owner: np.ndarray, hashes: np.ndarray, texts: int, k: int) -> np.ndarray:
    """Earliest dart of each text and coordinate, as rank and dart in one number."""
    owner, slabs = occurrences(owner, hashes)
    weight = np.bincount(owner, minlength=texts)
    out = np.full(texts * k, np.iinfo(np.uint64).max, np.uint64)
    reach = k * (log(k) + 5) / np.maximum(weight, 1)
    open_ = weight > 0
    while open_.any():
        use = np.flatnonzero(open_[owner])
        _throw(slabs[use], owner[use], reach, out, k)
        missing = (out.reshape(texts, k) == np.iinfo(np.uint64).max).any(1)
        open_ &= missing
        reach = np.where(open_, 2 * reach, reach)
    return out.reshape(texts, k)


def _throw(slabs: np.ndarray, owner: np.ndarray, reach: np.ndarray, out: np.ndarray, k: int) -> None:
    far = reach[owner]
    for cell, (low, high) in enumerate(zip(_CELLS, _CELLS[1:])):
        use = np.flatnonzero(far > low) if low else slice(None)
        _land(slabs[use], owner[use], np.full(len(slabs[use]), low), high - low, cell, out, k)
    units = np.maximum(np.ceil(far).astype(np.int64) - 1, 0)
    use = np.repeat(np.arange(len(slabs)), units)
    if len(use):
        low = np.arange(len(use)) - np.repeat(np.cumsum(units) - units, units) + 1.0
        _land(slabs[use], owner[use], low, 1.0, len(_CELLS), out, k)


def _land(slabs, owner, low, size, cell, out, k) -> None:
    seeds = mix(slabs + _C * (low.astype(np.uint64) * np.uint64(64) + np.uint64(cell + 1)))
    darts = np.searchsorted(_BOUNDS[size], seeds, "right")
    hit = np.flatnonzero(darts)
    use = np.repeat(hit, darts[hit])
    if not len(use):
        return
    nth = np.arange(len(use)) - np.repeat(np.cumsum(darts[hit]) - darts[hit], darts[hit])
    dart = mix(seeds[use] + _A * (nth.astype(np.uint64) + np.uint64(1)))
    rank = low[use] + (dart >> np.uint64(11)).astype(np.float64) * 2.0**-53 * size
    other = mix(dart + _B)
    packed = (np.minimum(rank * 2.0**20, 2.0**32 - 1).astype(np.uint64) << np.uint64(32)) | (other >> np.uint64(32))
    np.minimum.at(out, owner[use] * k + (other % np.uint64(k)).astype(np.int64), packed)


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash per text and band."""
    cut_ = signature.reshape(len(signature), bands, rows)
    value = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _A, cut_.shape[:2]).copy()
    for j in range(rows):
        value = mix(value * _C + cut_[:, :, j])
    return value.view(np.int64)


def _sketches(rows: DataFrame, bands: int, height: int) -> DataFrame:
    """``_key, weight, words, bands, bits``: shingles, digest of the words, band hashes, parities."""

    def make():
        def work(block: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(block)
            words, codes, offsets = coded(texts)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            owner, values = shingles(codes, offsets, hashes)
            weight = np.bincount(owner, minlength=len(texts))
            bits = parity_bits(*occurrences(owner, values), len(texts))
            values = bands_of(signatures(owner, values, len(texts), bands * height), bands, height).reshape(-1)
            values, bits = (
                pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * n), pa.array(flat))
                for n, flat in ((bands, values), (len(_WORDS), bits.view(np.int64).reshape(-1)))
            )
            own = [hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() for t in texts]
            schema = pa.schema(
                [("_key", pa.int64()), ("weight", pa.int64()), ("words", pa.binary())]
                + [("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))]
            )
            return record(schema, [block.column("_key"), weight, own, values, bits])

        return work

    return map_blocks(rows.select("_key", "text"), make, "_key long, weight long, words binary, bands array<long>, bits array<long>")


def _multiset(text: str) -> Counter:
    words = text.encode().split()
    n = max(1, len(words) - WORDS + 1)
    return Counter(b" ".join(words[i : i + WORDS]) for i in range(n)) if words else Counter()


def similarity(a: str, b: str) -> float:
    """Weighted Jaccard similarity of the five-word shingles, weights being their counts."""
    x, y = _multiset(a), _multiset(b)
    both = sum((x & y).values())
    total = sum(x.values()) + sum(y.values()) - both
    return both / total if total else 0.0


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``a, b`` of ``pairs`` whose texts are similar enough."""
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("_key"))
    both = sides.join(texts, "_key").groupBy("a", "b").agg(
        F.max(F.when(F.col("_key") == F.col("a"), F.col("text"))).alias("left"),
        F.max(F.when(F.col("_key") == F.col("b"), F.col("text"))).alias("right"),
    )

    def run(batches):
        for batch in batches:
            keep = [similarity(x, y) >= least for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    least: float = LEAST_SIMILAR,
    bands: int = BANDS,
    rows_per_band: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, class_id, class_size, kept`` of every row.

    Rows are of one class if links of similarity ``least`` or more join them; ``class_id`` is
    the smallest id of the class, whose row stays.  A pair at the default threshold is missed by
    all bands once in 60,000 pairs.  Texts without words, null ones too, are classes of their
    own.  Where ids repeat or are null, class ids are row keys of :func:`common.keyed`.  An empty
    table gives no rows.  Runs jobs when called.
    """
    rows = keyed(docs, id_col, text_col)
    sketches = cut(_sketches(rows, bands, rows_per_band), "sketches")
    # Rows with the same words are one text from here on.
    copies = cut(sketches.where("weight > 0").groupBy("words").agg(F.min("_key").alias("text_key")), "copies")
    owners = cut(sketches.select("_key", "words").join(copies, "words").select("_key", "text_key"), "owners")
    texts = sketches.join(copies.select(F.col("text_key").alias("_key")), "_key", "left_semi")
    buckets = texts.select(F.col("_key").alias("doc"), "weight", F.explode("bands").alias("bucket"))
    leaders = buckets.groupBy("bucket").agg(F.min(F.struct("doc", "weight")).alias("leader"), F.count("*").alias("n"))
    leaders = cut(leaders.where("n > 1").drop("n"), "leaders")
    shared = cut(buckets.join(leaders, "bucket"), "buckets")
    whole = rows.select("_key", "text").join(shared.select(F.col("doc").alias("_key")).distinct(), "_key", "left_semi")
    whole = cut(whole, "texts")

    def near_in_size(pairs: DataFrame) -> DataFrame:
        size = F.least("weight_a", "weight_b") >= least * F.greatest("weight_a", "weight_b")
        return pairs.where(size & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def against(leader: str, members: DataFrame) -> DataFrame:
        return near_in_size(
            members.select(F.col(f"{leader}.doc").alias("a"), F.col(f"{leader}.weight").alias("weight_a"), F.col("doc").alias("b"), F.col("weight").alias("weight_b"))
        )

    tried = cut(against("leader", shared), "tried")
    links = cut(_verified(tried, whole, least), "links")
    labels = components(links)
    parities = sketches.select(F.col("_key").alias("doc"), *(F.col("bits")[k].alias(w) for k, w in enumerate(_WORDS)))
    for turn in (1, 2):  # another leader first, then every pair across components
        labelled = shared.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
        labelled = cut(labelled, "labelled")
        mixed = labelled.groupBy("bucket").agg(
            F.min("label").alias("low"),
            F.max("label").alias("high"),
            F.min(F.struct(F.xxhash64("doc", "bucket"), "doc", "weight", "label")).alias("other"),
        ).where("low <> high")
        members = labelled.join(mixed, "bucket")
        members = members.join(parities, "doc")
        if turn == 1:
            pairs = against("other", members.where("label <> other.label"))
        else:
            sides = [
                members.select("bucket", *(F.col(c).alias(f"{c}_{x}") for c in ("doc", "weight", "label", *_WORDS)))
                for x in "ab"
            ]
            apart = sum(F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in _WORDS)
            most = F.floor((F.col("weight_a") + F.col("weight_b") - apart) / 2)
            near = (F.col("label_a") < F.col("label_b")) & (most >= least * (F.col("weight_a") + F.col("weight_b") - most))
            pairs = sides[0].join(sides[1], ["bucket"]).where(near)
            pairs = near_in_size(pairs.withColumnsRenamed({"doc_a": "a", "doc_b": "b"}))
        pairs = cut(pairs.join(tried, ["a", "b"], "left_anti"), "tried")
        if pairs.isEmpty():
            continue
        more = cut(_verified(pairs, whole, least), "links")
        tried = tried.unionByName(pairs)
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
    classes = owners.join(labels.withColumnRenamed("node", "text_key"), "text_key", "left").select(
        "_key", F.coalesce("label", "text_key").alias("class_id")
    )
    classes = cut(rows.select("_key", "doc_id").join(classes, "_key", "left").withColumn("class_id", F.coalesce("class_id", "_key")), "classes")
    sizes = classes.groupBy("class_id").agg(F.count("*").alias("class_size")).where("class_size > 1")
    return classes.join(sizes, "class_id", "left").select(
        "doc_id", "class_id", F.coalesce("class_size", F.lit(1)).alias("class_size"), (F.col("class_id") == F.col("_key")).alias("kept")
    )
