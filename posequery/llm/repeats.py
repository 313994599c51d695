"""Removal of long byte strings that occur more than once in a corpus.

Equal strings of ``size`` bytes have the same smallest k-gram hash, at the same place.  So each text
is cut into runs of starting places that share that anchor, and a run with the bytes it needs
is a fragment.  One aggregation by anchor settles most of them: an anchor met once
repeats nothing, and one whose fragments are all equal repeats them whole.  Fragments that
share an anchor but differ are fetched, one copy of each, and brought together by anchor;
their suffixes are sorted in two stages and adjacent common prefixes of ``size`` bytes or more mark
the places that repeat.  An anchor with more than ``HOT`` different fragments is not brought
together: each of its strings is counted by a hash of 128 bits instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posequery.llm.common import blocks, keyed, map_blocks, record, texts_of
from posequery.llm.near_dedup import mix
from posequery.llm.suffix_sort import common_prefixes, sort_suffixes
from posequery.session import cut

SIZE, GRAM = 200, 24
HOT = 50_000
#: Fragment bytes that are sorted at a time; a larger group of one anchor is sorted alone.
SORT_BYTES = 1 << 20
#: Text bytes that are hashed at a time.
_PART = 1 << 20
_STEP = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base % 2**64))
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(_STEP, _PART + 1024)
_INVERSE = _powers(pow(_STEP, -1, 2**64), _PART + 1024)


def _segments(keys: list[int], texts: list[bytes], size: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of ``(key, offset, bytes)`` that hold every string of ``size`` bytes once."""
    group, held = [], 0
    for key, text in zip(keys, texts):
        for at in range(0, max(len(text) - size + 1, 0), _PART // 2):
            part = text[at : at + _PART // 2 + size - 1]
            if held + len(part) > _PART and group:
                yield group
                group, held = [], 0
            group.append((key, at, part))
            held += len(part)
    if group:
        yield group


def fragments(group: list[tuple[int, int, bytes]], size: int, gram: int) -> tuple[np.ndarray, ...]:
    """Key, start, number of strings, anchor and hash of each fragment of a group of segments."""
    raw = b"".join(part for _, _, part in group)
    n = len(raw)
    ends = np.cumsum([len(part) for _, _, part in group])
    segment = np.repeat(np.arange(len(group)), np.diff(ends, prepend=0))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[np.frombuffer(raw, np.uint8)] * _POWERS[:n], out=sums[1:])
    value = mix((sums[gram:] - sums[:-gram]) * _INVERSE[: n - gram + 1])
    width = size - gram + 1
    mask = np.uint64((1 << 23) - 1)
    packed = (value & ~mask) | np.arange(len(value), dtype=np.uint64)
    rows = -(-len(packed) // width)
    table = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    table[: len(packed)] = packed
    table = table.reshape(rows, width)
    ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    places = n - size + 1
    anchor = np.minimum(behind[:places], ahead[width - 1 : width - 1 + places]) & mask
    valid = np.arange(places) + size <= ends[segment[:places]]
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1]) | (segment[1:places] != segment[: places - 1])
    start = np.flatnonzero(begins)
    counts = np.cumsum(valid)
    last = np.concatenate([counts[start[1:] - 1], counts[-1:]]) if len(start) else np.zeros(0, np.int64)
    many = last - counts[start] + 1
    view = memoryview(raw)
    hashes = np.fromiter(
        (xxhash.xxh3_64_intdigest(view[a : a + m + size - 1]) for a, m in zip(start.tolist(), many.tolist())), np.uint64, len(start)
    )
    owner = segment[start]
    keys = np.array([key for key, _, _ in group], np.int64)[owner]
    base = np.array([at for _, at, _ in group], np.int64) - (ends - [len(part) for _, _, part in group])
    return keys, start + base[owner], many, value[anchor[start].astype(np.int64)].view(np.int64), hashes.view(np.int64)


_FRAGMENT = "_key long, start long, many int, anchor long, body long"


def _all_fragments(rows: DataFrame, size: int, gram: int) -> DataFrame:
    schema = pa.schema([("_key", pa.int64()), ("start", pa.int64()), ("many", pa.int32()), ("anchor", pa.int64()), ("body", pa.int64())])

    def make():
        def work(block: pa.RecordBatch) -> pa.RecordBatch:
            groups = _segments(block.column("_key").to_pylist(), texts_of(block), size)
            parts = [fragments(g, size, gram) for g in groups]
            columns = [np.concatenate(c) for c in zip(*parts)] or [np.zeros(0, np.int64)] * 5
            return record(schema, columns)

        return work

    return map_blocks(rows.select("_key", "text"), make, _FRAGMENT)


def _fetched(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The bytes of ``wanted`` fragments (``_key, start, many, anchor, copies``)."""
    lists = wanted.groupBy("_key").agg(F.collect_list(F.struct("start", "many", "anchor", "copies")).alias("list"))
    schema = pa.schema(
        [("_key", pa.int64()), ("start", pa.int64()), ("many", pa.int32()), ("anchor", pa.int64()), ("copies", pa.int64()), ("bytes", pa.binary())]
    )

    def run(batches):
        for batch in batches:
            for block in blocks(batch):
                texts = zip(block.column("_key").to_pylist(), texts_of(block), block.column("list").to_pylist())
                rows = [
                    (key, w["start"], w["many"], w["anchor"], w["copies"], text[w["start"] : w["start"] + w["many"] + size - 1])
                    for key, text, wanted in texts
                    for w in wanted
                ]
                yield record(schema, [list(c) for c in zip(*rows)])

    joined = rows.select("_key", "text").join(lists, "_key")
    return joined.mapInArrow(run, "_key long, start long, many int, anchor long, copies long, bytes binary")


def repeated_places(parts: list[bytes], many: np.ndarray, copies: np.ndarray, size: int) -> np.ndarray:
    """Which of the strings of all fragments, in order, start elsewhere too."""
    raw = b"".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    first = np.cumsum(lengths) - lengths
    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    starts = np.repeat(first, many) + offset
    ordered = sort_suffixes(raw, starts, size)
    long = common_prefixes(raw, ordered, size) >= size
    hit = np.zeros(len(raw), bool)
    hit[ordered[:-1][long]] = True
    hit[ordered[1:][long]] = True
    return hit[starts] | np.repeat(copies > 1, many)


_SPANS = pa.schema([("_key", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def _spans(keys: np.ndarray, starts: np.ndarray, many: np.ndarray, hit: np.ndarray, size: int) -> pa.RecordBatch:
    """Spans of bytes under the strings ``hit``, as runs within each fragment."""
    owner = np.repeat(np.arange(len(many)), many)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + starts[owner]
    begins, ends = hit.copy(), hit.copy()
    begins[1:] &= ~(hit[:-1] & (owner[1:] == owner[:-1]))
    ends[:-1] &= ~(hit[1:] & (owner[1:] == owner[:-1]))
    a, b = np.flatnonzero(begins), np.flatnonzero(ends)
    return record(_SPANS, [keys[owner[a]], place[a], place[b] + size])


def _sorted_spans(fetched: DataFrame, size: int) -> DataFrame:
    """Spans of the fragments without a copy, from the suffixes of all fragments of their anchor."""

    def solve(rows: list[dict]) -> pa.RecordBatch:
        many = np.array([r["many"] for r in rows], np.int64)
        copies = np.array([r["copies"] for r in rows], np.int64)
        hit = repeated_places([r["bytes"] for r in rows], many, copies, size)
        hit &= np.repeat(copies == 1, many)  # fragments with copies are removed whole elsewhere
        return _spans(np.array([r["_key"] for r in rows]), np.array([r["start"] for r in rows]), many, hit, size)

    def run(batches):
        held, total = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if total > SORT_BYTES and row["anchor"] != held[-1]["anchor"]:
                    yield solve(held)
                    held, total = [], 0
                held.append(row)
                total += len(row["bytes"])
        if held:
            yield solve(held)

    together = fetched.repartition("anchor").sortWithinPartitions("anchor")
    return together.mapInArrow(run, "_key long, start long, stop long")


def _counted_spans(fetched: DataFrame, size: int) -> DataFrame:
    """The same for hot anchors: strings are counted by hash, combined before the shuffle."""
    schema = pa.schema([("_key", pa.int64()), ("start", pa.int64()), ("copies", pa.int64()), ("string", pa.binary())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                view = memoryview(row["bytes"])
                strings = [xxhash.xxh3_128_digest(view[i : i + size]) for i in range(row["many"])]
                places = list(range(row["start"], row["start"] + row["many"]))
                yield record(schema, [[row["_key"]] * len(places), places, [row["copies"]] * len(places), strings])

    strings = fetched.mapInArrow(run, "_key long, start long, copies long, string binary")
    twice = strings.groupBy("string").agg(F.sum("copies").alias("n")).where("n > 1")
    single = strings.where("copies = 1").join(twice, "string")
    return single.select("_key", "start", (F.col("start") + size).alias("stop"))


def repeated_spans(rows: DataFrame, size: int = SIZE, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``_key, start, stop``: spans of bytes of ``rows`` (``_key, text``) to remove, overlapping."""
    found = _all_fragments(rows, size, gram)
    anchors = found.groupBy("anchor").agg(
        F.count("*").alias("n"), F.min("body").alias("low"), F.max("body").alias("high"), F.min("many").alias("least"), F.max("many").alias("most")
    )
    anchors = anchors.where("n > 1").select("anchor", (F.expr("low <> high OR least <> most")).alias("differ"))
    anchors = cut(anchors, "anchors")  # a written side leaves the join free to split a hot anchor
    shared = cut(found.join(anchors, "anchor"), "fragments")
    stop = (F.col("start") + F.col("many") + (size - 1)).alias("stop")
    whole = shared.where("NOT differ").select("_key", "start", stop)
    mixed = shared.where("differ")
    bodies = mixed.groupBy("anchor", "body", "many").agg(F.count("*").alias("copies"), F.min(F.struct("_key", "start")).alias("one"))
    bodies = cut(bodies, "bodies")
    copied = mixed.join(bodies.where("copies > 1").select("anchor", "body", "many"), ["anchor", "body", "many"])
    crowds = cut(bodies.groupBy("anchor").count().where(F.col("count") > hot).select("anchor"), "hot")
    wanted = bodies.select("one._key", "one.start", "many", "anchor", "copies")
    spans = whole.unionByName(copied.select("_key", "start", stop))
    if crowds.isEmpty():
        return spans.unionByName(_sorted_spans(_fetched(rows, wanted, size), size))
    fetched = cut(_fetched(rows, wanted, size), "fetched")
    spans = spans.unionByName(_sorted_spans(fetched.join(crowds, "anchor", "left_anti"), size))
    return spans.unionByName(_counted_spans(fetched.join(crowds, "anchor", "left_semi"), size))


def united(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes under ``spans``."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(stop, out[-1][1])
        else:
            out.append((start, stop))
    return out


def _outside(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """``text`` without the bytes of ``runs``."""
    edges = [0, *(x for run in runs for x in run), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def spans_per_row(spans: DataFrame) -> DataFrame:
    """``_key, spans``: each row's spans in one array, as many as its text has fragments."""
    return spans.groupBy("_key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def cut_texts(rows: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """``rows`` without ``spans_col``, and with their texts cut; broken code points are dropped.

    Null texts and those without spans stay as they are.  Of any other columns none is looked at.
    """
    schema = rows.drop(spans_col).schema

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            spans = batch.column(batch.schema.get_field_index(spans_col)).to_pylist()
            new = [_outside(t.encode(), united(s)).decode("utf-8", "ignore") if s and t else t for t, s in zip(texts, spans)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.column(at).type)).drop_columns([spans_col])

    return rows.mapInArrow(run, schema)


def without_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` of every row; ``kept`` is binary.

    Every byte under a string of ``size`` bytes that also starts elsewhere in the corpus, same text
    included, is removed; strings do not cross texts and are judged on the input.  Null and
    empty texts, and those shorter than ``size``, lose nothing; rows that repeat lose all if
    they are long enough; an empty table gives no rows.  Cuts may fall within a code point.
    Runs jobs when called.
    """
    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    spans = spans_per_row(repeated_spans(rows, size, gram, hot))
    joined = rows.join(spans, "_key", "left").select("doc_id", "text", "spans")

    def make():
        def work(block: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(block)
            runs = [united(s) if s else [] for s in block.column("spans").to_pylist()]
            kept = [_outside(text, own) for text, own in zip(texts, runs)]
            ids = block.column("doc_id")
            schema = pa.schema([("doc_id", ids.type), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
            sizes = [len(t) for t in texts]
            return record(schema, [ids, sizes, [n - len(k) for n, k in zip(sizes, kept)], [len(r) for r in runs], kept])

        return work

    return map_blocks(joined, make, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
