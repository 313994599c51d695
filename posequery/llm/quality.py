"""Quality rules on repetition, from a suffix array over each document's words.

Suffixes are compared word by word.  Prefix doubling orders the suffixes of all documents of a
block at once; only suffixes that still share their prefix with another one of the same
document go to the next doubling, so nearly all work is in the first two rounds.  Common
prefixes of neighbours come from the ranks of the doublings.  A suffix whose longer common
prefix with a neighbour has ``m`` words starts a repeated substring of ``m`` words; those
not preceded by a longer one are the maximal repeats, i.e. the lcp intervals.  Their
spans are united.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from posequery.llm.common import blocks, coded, id_and_text, map_blocks, per_text, record, texts_of

SYMBOLS = b"#*$%&|<>"
_SPACES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")


def suffix_array(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list]:
    """Suffixes of all texts in order, and the ranks by prefixes of 1, 2, 4, ... words.

    A suffix ends with its text, and texts are kept apart, so only suffixes of one text share a
    rank.  The rank of a suffix is the place where its group of equal prefixes starts.
    """
    n = len(codes)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    end = offsets[1:][owner]
    keys = owner * (int(codes.max()) + 1) + codes
    live = np.argsort(keys, kind="stable")
    rank = np.empty(n, np.int64)
    rank[live] = _starts(keys[live])
    levels, size = [rank.copy()], 1
    while True:
        groups = rank[live]
        live = live[np.bincount(groups, minlength=n)[groups] > 1]
        if not len(live):
            break
        after = live + size
        second = np.where(after < end[live], rank[np.minimum(after, n - 1)], -1)
        keys = rank[live] * (n + 1) + second + 1
        order = np.argsort(keys, kind="stable")
        live, keys = live[order], keys[order]
        groups = rank[live]
        rank[live] = groups + _starts(keys) - _starts(groups)
        levels.append(rank.copy())
        size *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes, levels


def _starts(ordered: np.ndarray) -> np.ndarray:
    """For each place of an ordered array, the place where its run of equal values starts."""
    places = np.arange(len(ordered))
    places[1:][ordered[1:] == ordered[:-1]] = 0
    return np.maximum.accumulate(places)


def _common(a: np.ndarray, b: np.ndarray, levels: list) -> np.ndarray:
    """Words that the suffixes at ``a`` and ``b``, different ones, have in common."""
    n = len(levels[0])
    total = np.zeros(len(a), np.int64)
    for size, rank in reversed([(1 << k, rank) for k, rank in enumerate(levels)]):
        i, j = a + total, b + total
        total += size * ((i < n) & (j < n) & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)]))
    return total


def repeats(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each word, the longest prefix of its suffix that also starts elsewhere in its text."""
    longest = np.zeros(len(codes), np.int64)
    if not len(codes):
        return longest
    suffixes, levels = suffix_array(codes, offsets)
    a, b = suffixes[:-1], suffixes[1:]
    near = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[near], b[near]
    lcp = _common(a, b, levels)
    longest[a] = lcp
    longest[b] = np.maximum(longest[b], lcp)
    return longest


def covered(longest: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """Words of each text under the union of its repeats of ``least`` words or more."""
    n = len(longest)
    starts = np.flatnonzero(longest >= least)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + longest[starts], -1)
    return per_text(np.cumsum(edges)[:n] > 0, offsets)


def _windows_covered(longest: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Words of each text in windows of ``size`` words found twice or more in it."""
    n = len(longest)
    edges = np.zeros(n + size + 1, np.int64)
    starts = np.flatnonzero(longest >= size)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return per_text(np.cumsum(edges)[:n] > 0, offsets)


def measures(texts: list[bytes], least: int = 5) -> dict[str, np.ndarray]:
    """Counts of each text for :func:`quality`."""
    words, codes, offsets = coded(texts)
    sizes = np.fromiter((sum(b & 0xC0 != 0x80 for b in w) if not w.isascii() else len(w) for w in words), np.int64, len(words))
    symbols = np.fromiter((len(w) - len(w.translate(None, SYMBOLS)) for w in words), np.int64, len(words))
    longest = repeats(codes, offsets)
    lines = []
    for text in texts:
        real = [line for line in text.split(b"\n") if line and not line.isspace()]
        lines.append(len(real) - len(set(real)))
    most = np.zeros(len(texts), np.int64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        most[full] = np.maximum.reduceat(longest, offsets[full])
    return {
        "n_words": np.diff(offsets),
        "word_chars": per_text(sizes[codes], offsets),
        "n_symbols": per_text(symbols[codes], offsets),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": _windows_covered(longest, offsets, 3),
        "covered_words": covered(longest, offsets, least),
        "longest_repeat": most,
    }


def verdict(m: dict[str, np.ndarray], covered_percent: int, longest_percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each text fails the base rules, and whether it is kept."""
    n = m["n_words"]
    failed = (n < 50) | (100 * m["n_repeat_words"] > 50 * n)
    bad = (100 * m["covered_words"] > covered_percent * n) | (100 * m["longest_repeat"] > longest_percent * n)
    return failed, ~failed & ~bad


_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality(
    docs: DataFrame,
    least: int = 5,
    covered_percent: int = 40,
    longest_percent: int = 25,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Counts and verdict of every row: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, covered_words, longest_repeat``.

    ``base_failed``: fewer than 50 words, or over half of them in repeated windows of three.
    The method rejects a text if repeats of ``least`` words or more cover over
    ``covered_percent`` percent of its words, or its longest repeat (counted once) has
    over ``longest_percent`` percent of them.  Null and empty texts have no words and fail.
    Rows are judged one by one, so repeated rows and null ids pass through.
    """
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def make():
        def work(block: pa.RecordBatch) -> pa.RecordBatch:
            m = measures(texts_of(block), least)
            failed, kept = verdict(m, covered_percent, longest_percent)
            ids = block.column("doc_id")
            schema = pa.schema(
                [("doc_id", ids.type), *((c, pa.int64()) for c in _COLUMNS), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
                + [("covered_words", pa.int64()), ("longest_repeat", pa.int64())]
            )
            return record(
                schema,
                [ids, *(m[c] for c in _COLUMNS), failed, kept, m["covered_words"], m["longest_repeat"]],
            )

        return work

    schema = (
        f"doc_id {kind}, {', '.join(f'{c} long' for c in _COLUMNS)}, base_failed boolean, kept boolean, "
        "covered_words long, longest_repeat long"
    )
    return map_blocks(rows, make, schema)


def keep(docs: DataFrame, least: int = 5, covered_percent: int = 40, longest_percent: int = 25, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, with all their columns, without a shuffle."""

    def run(batches):
        for batch in batches:
            text = batch.schema.get_field_index(text_col)
            own = pa.RecordBatch.from_arrays([batch.column(text), pa.array(range(batch.num_rows))], names=["text", "row"])
            for block in blocks(own):
                kept = verdict(measures(texts_of(block), least), covered_percent, longest_percent)[1]
                yield batch.take(block.column("row").filter(pa.array(kept)))

    return docs.mapInArrow(run, docs.schema)
