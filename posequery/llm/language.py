"""Language identification with bit-sliced Bloom filters of n-grams.

One slot of the filter holds one bit per language.  An n-gram (bytes of a lower-case word
with its borders) reads one slot per hash function; the AND of the slots is the set of languages
that contain it, false positives aside.  Popcounts per language over all n-grams of a text,
less the hits that the fill of a language's slice explains, decide.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posequery.llm.common import coded, id_and_text, map_blocks, per_text, record, texts_of

SIZES = (1, 2, 3, 4, 5)
LONGEST = 64
_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIXES = tuple(np.uint64(m) for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


@dataclass
class Filters:
    """``slots``: a row of language bits per slot, 64 languages to a column."""

    languages: list[str]
    slots: np.ndarray
    false_positive: np.ndarray


def letters(text: bytes) -> bytes:
    """ASCII letters in lower case and all other code points; spaces for the rest of ASCII."""
    return text.translate(_LETTERS)


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each word between border marks, and each word's offsets."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    buffer = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    end = np.repeat(ends, lengths)
    n = len(buffer)
    place, value = np.arange(n), np.zeros(n, np.uint64)
    hashes, keep = [], []
    for size in range(1, max(SIZES) + 1):
        ahead = np.zeros(n, np.uint64)
        ahead[: max(0, n - size + 1)] = buffer[size - 1 :]
        value = (value + ahead + np.uint64(1)) * _BASE
        value ^= value >> np.uint64(29)
        if size in SIZES:
            hashes.append(value + np.uint64(size))
            keep.append((place + size <= end) & ((buffer != 32) if size == 1 else True))
    table, held = np.stack(hashes, 1), np.stack(keep, 1)
    starts = np.concatenate([[0], ends])
    counts = np.concatenate([[0], np.cumsum(held.sum(1))])
    return table[held], counts[starts]


def _places(hashes: np.ndarray, slots: int) -> list[np.ndarray]:
    shift = np.uint64(64 - int(slots).bit_length() + 1)
    return [(hashes * mix) >> shift for mix in _MIXES]


def build(languages: list[str], members: list[np.ndarray], slots: int) -> Filters:
    """Filters that hold the n-gram hashes ``members`` of each language."""
    table = np.zeros((slots, max(1, -(-len(languages) // 64))), np.uint64)
    rate = np.zeros(len(languages))
    for k, hashes in enumerate(members):
        bit = np.uint64(1) << np.uint64(k % 64)
        for place in _places(hashes, slots):
            np.bitwise_or.at(table[:, k // 64], place.astype(np.int64), bit)
        rate[k] = np.mean(table[:, k // 64] & bit != 0) ** len(_MIXES)
    return Filters(languages, table, rate)


def popcounts(filters: Filters, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of each word per language, corrected for false positives, and in all."""
    hashes, offsets = grams(words)
    masks = None
    for place in _places(hashes, len(filters.slots)):
        got = filters.slots[place.astype(np.int64)]
        masks = got if masks is None else masks & got
    total = np.diff(offsets)
    out = np.zeros((len(words), len(filters.languages)), np.float32)
    for k, rate in enumerate(filters.false_positive):
        hit = (masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
        out[:, k] = (per_text(hit.astype(np.int64), offsets) - rate * total) / max(1e-9, 1 - rate)
    return out, total


class Memory:
    """Popcounts of words met before: the first ones, up to 64 MB and ``LONGEST`` bytes a word."""

    def __init__(self, filters: Filters, cells: int = 1 << 24):
        self.filters = filters
        self.index: dict[bytes, int] = {}
        self.table = np.zeros((cells // max(1, len(filters.languages)), len(filters.languages)), np.float32)

    def popcounts(self, words: list[bytes]) -> np.ndarray:
        """What :func:`popcounts` gives for ``words``, which are distinct."""
        places = np.fromiter((self.index.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(places < 0)
        out = np.zeros((len(words), len(self.filters.languages)), np.float32)
        out[places >= 0] = self.table[places[places >= 0]]
        out[new] = popcounts(self.filters, [words[i] for i in new])[0]
        kept = [i for i in new.tolist() if len(words[i]) <= LONGEST][: len(self.table) - len(self.index)]
        self.table[len(self.index) : len(self.index) + len(kept)] = out[kept]
        for i in kept:
            self.index[words[i]] = len(self.index)
        return out


#: The memory of this worker process and the call of :func:`identify` that it serves.
_MEMORY: dict[str, Memory] = {}


def _memory(call: str, filters: Filters) -> Memory:
    if call not in _MEMORY:
        _MEMORY.clear()
        _MEMORY[call] = Memory(filters)
    return _MEMORY[call]


def decide(filters: Filters, texts: list[bytes], memory: Memory | None = None) -> tuple[list[str], np.ndarray]:
    """Language and score of each text, from it alone; ``und`` where there is no letter."""
    words, codes, offsets = coded([letters(t) for t in texts])
    counts = memory.popcounts(words) if memory else popcounts(filters, words)[0]
    # Sums run over the block; rounding takes off what the texts before leave in the last digits.
    sums = np.maximum(np.round(per_text(counts[codes].astype(np.float64), offsets), 5), 0.0)
    best = sums.argmax(1) if len(filters.languages) else np.zeros(len(texts), np.int64)
    langs, scores = [], np.zeros(len(texts))
    for i, text in enumerate(texts):
        empty = offsets[i] == offsets[i + 1]
        if not empty and not filters.languages:
            empty = True
        if not empty and not any(97 <= b <= 122 for b in set(letters(text))):
            empty = not any(c.isalpha() for c in text.decode("utf-8", "replace"))
        langs.append("und" if empty else filters.languages[best[i]])
        if not empty and sums[i].sum() > 0:
            scores[i] = sums[i, best[i]] / sums[i].sum()
    return langs, scores


def fit(
    rows: DataFrame,
    docs_per_language: int = 4000,
    grams_per_language: int = 30_000,
    slots: int = 1 << 20,
) -> Filters:
    """Filters from ``rows`` (``doc_id, text, lang``), languages in falling order of rows.

    Of each language about ``docs_per_language`` rows are read, chosen by a hash of the id and
    text, and its ``grams_per_language`` most frequent n-grams are kept; both bounds and
    ``slots`` fix the size of the model, whatever the input.
    """
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    languages = list(counts)
    if not languages:
        return build([], [], 64)
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, docs_per_language / n)))])
    dice = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(dice < share[F.col("lang")]).select("text", "lang")

    def count(batches):
        for batch in batches:
            texts, langs = texts_of(batch), batch.column("lang").to_pylist()
            for lang in set(langs):
                own = [letters(t) for t, x in zip(texts, langs) if x == lang]
                words, codes, _ = coded(own)
                hashes, offsets = grams(words)
                weight = np.repeat(np.bincount(codes, minlength=len(words)), np.diff(offsets))
                values, place = np.unique(hashes, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(values), pa.string()),
                        pa.array(values.view(np.int64)),
                        pa.array(np.bincount(place, weights=weight, minlength=len(values)).astype(np.int64)),
                    ],
                    names=["lang", "gram", "n"],
                )

    totals = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = totals.withColumn("place", F.row_number().over(order)).where(F.col("place") <= grams_per_language)
    found = top.select("lang", "gram").toArrow()  # languages times grams_per_language at most
    members = [found.filter(pc.equal(found["lang"], x))["gram"].to_numpy().view(np.uint64) for x in languages]
    return build(languages, members, slots)


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, from its text alone.

    ``und`` with score 0 where the text is null or has no letter.  Letters that no language
    knows give the language with most training rows and score 0.  Repeated rows are judged
    each, null ids stay null, an empty table gives no rows.
    """
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    call = uuid.uuid4().hex

    def make():
        model = shared.value
        memory = _memory(call, model)

        def work(block: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores = decide(model, texts_of(block), memory)
            ids = block.column("doc_id")
            return record(pa.schema([("doc_id", ids.type), ("lang_pred", pa.string()), ("score", pa.float64())]), [ids, langs, scores])

        return work

    return map_blocks(rows, make, f"doc_id {kind}, lang_pred string, score double")
