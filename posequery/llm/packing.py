"""Packing of tokenized documents into sequences of one length, with few windows open at a time.

Each task keeps ``open_windows`` windows.  A document's full windows leave at once; the rest goes
whole into the open window it fits best.  Where it fits none, the fullest window is filled up
with the head of the rest and leaves, and the rest is placed again.  The windows still open at a
task's end are merged: those of ``FAN_IN`` tasks go to one task, which packs them with a single
window, until one task is left.  So a merging task holds ``FAN_IN * open_windows`` windows at
most, and only the last window of all is not full.
"""

from __future__ import annotations

import json
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posequery.llm.common import blocks, id_and_text, record, texts_of
from posequery.session import cut

FAN_IN = 64
#: Words whose ids a Python worker keeps (the first it meets), and their longest size.
KEEP, LONGEST = 400_000, 64
#: White space that the quick path does not cut at: runs of it, and anything but space and line feed.
_RUNS = (b"  ", b" \n", b"\n ", b"\n\n")
_CONTROLS = b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _odd(text: bytes) -> bool:
    if any(r in text for r in _RUNS) or len(text.translate(None, _CONTROLS)) < len(text):
        return True
    return not text.isascii() and _WIDE.search(text.decode("utf-8", "replace")) is not None


#: Cuts between pre-tokens of byte-level BPE: fixed pattern of the tokenizer files.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_chars() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones stand for
    themselves, the others follow from 256 on in order."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteEncoder:
    """Ids of a byte-level BPE tokenizers file, as little-endian unsigned 32-bit bytes.

    Between single spaces and line feeds words are encoded one by one and remembered; texts with
    other white space or special strings go to the library whole.
    """

    def __init__(self, tokenizer_json: str):
        import tiktoken
        from tokenizers import Tokenizer

        content = json.loads(tokenizer_json)
        special = [t["content"] for t in content["added_tokens"]]
        chars = _byte_chars()
        ranks = {bytes(chars[c] for c in w): i for w, i in content["model"]["vocab"].items() if w not in special}
        self.words = tiktoken.Encoding("words", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_str(tokenizer_json)
        self.special = [s.encode() for s in special]
        self.first: dict[bytes, bytes] = {}
        self.after: dict[bytes, bytes] = {}
        self.feed = ranks[b"\n"]
        self.line = self.feed.to_bytes(4, "little")

    def _words(self, words: list[bytes], lead: bytes) -> list[bytes]:
        """Ids of words without white space, each after ``lead``, from one call.

        They are joined by line feeds, which stay tokens of their own.
        """
        if not words:
            return []
        joined = b"\n".join(lead + w for w in words).decode("utf-8", "replace")
        ids = self.words.encode_to_numpy(joined).astype("<u4")
        cuts = np.flatnonzero(ids == self.feed)
        starts, ends = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(ids)]])
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]

    def _joined(self, table: dict[bytes, bytes], words: list[bytes], lead: bytes) -> bytes:
        try:
            return b"".join(map(table.__getitem__, words))
        except KeyError:
            new = list(set(words).difference(table))
            found = dict(zip(new, self._words(new, lead)))
            if len(table) + len(new) <= KEEP:
                table.update((w, i) for w, i in found.items() if len(w) <= LONGEST)
            return b"".join([table[w] if w in table else found[w] for w in words])

    def encode(self, text: bytes) -> bytes:
        if not text or _odd(text) or text[-1:].isspace() or any(s in text for s in self.special):
            ids = self.whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
            return b"".join(i.to_bytes(4, "little") for i in ids)
        lines = [line.split(b" ") for line in text.split(b"\n")]
        heads = [words[0] for words in lines if words[0]]
        self._joined(self.first, heads, b"")
        rest = self._rests(lines)
        out = []
        for row, (words, tail) in enumerate(zip(lines, rest)):
            if row:
                out.append(self.line)
            out.append(self._joined(self.first, words[:1], b"") if words[0] else b"")
            out.append(tail)
        return b"".join(out)

    def _rests(self, lines: list[list[bytes]]) -> list[bytes]:
        """Ids of each line after its first word; new words of all lines in one call."""
        try:
            return [b"".join(map(self.after.__getitem__, words[1:])) for words in lines]
        except KeyError:
            new = list({w for words in lines for w in words[1:]}.difference(self.after))
            found = dict(zip(new, self._words(new, b" ")))
            if len(self.after) + len(new) <= KEEP:
                self.after.update((w, i) for w, i in found.items() if len(w) <= LONGEST)
            after = self.after
            return [b"".join([after[w] if w in after else found[w] for w in words[1:]]) for words in lines]


class Packer:
    """Open windows of one task; ``done`` gets a row for each piece of a window that leaves."""

    def __init__(self, size: int, windows: int, first_id: int):
        self.size, self.windows, self.next = size, windows, first_id
        self.open: list[list] = []  # [used, pieces]
        self.done: list[tuple] = []

    def _leave(self, pieces: list, left: bool = False) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            length = len(ids) // 4
            self.done.append((doc, start, length, total, self.next, at, ids, left))
            at += length
        self.next += 1

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        """Place the ids of one document, or of a piece of it that begins at ``start``."""
        size = self.size
        while ids:
            length = len(ids) // 4
            if length >= size:
                self._leave([(doc, start, ids[: 4 * size], total)])
                ids, start = ids[4 * size :], start + size
                continue
            fits = [w for w in self.open if w[0] + length <= size]
            if fits:
                window = max(fits, key=lambda w: w[0])
                window[0] += length
                window[1].append((doc, start, ids, total))
                if window[0] == size:
                    self.open.remove(window)
                    self._leave(window[1])
                return
            if len(self.open) < self.windows:
                self.open.append([length, [(doc, start, ids, total)]])
                return
            window = max(self.open, key=lambda w: w[0])
            room = size - window[0]
            self.open.remove(window)
            self._leave([*window[1], (doc, start, ids[: 4 * room], total)])
            ids, start = ids[4 * room :], start + room

    def close(self) -> None:
        """Rows of the windows that are still open, marked as left over."""
        for _, pieces in self.open:
            self._leave(pieces, True)
        self.open = []


_FIELDS = [
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()),
    ("offset", pa.int64()),
    ("ids", pa.binary()),
    ("left", pa.bool_()),
    ("task", pa.int64()),
]
_ENCODERS: dict[int, ByteEncoder] = {}


def _encoder(tokenizer_json: str) -> ByteEncoder:
    key = hash(tokenizer_json)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ByteEncoder(tokenizer_json)
    return _ENCODERS[key]


def pack(
    docs: DataFrame,
    tokenizer_json: str,
    end_id: int = 1,
    size: int = 2048,
    open_windows: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` of every piece.

    A document's ids are those of its text and then ``end_id``; ``ids`` holds a piece's ids as
    little-endian unsigned 32-bit numbers.  Null and empty texts are the end id alone; repeated
    rows are packed each under their id; an empty table gives no rows.  Runs jobs when called.
    """
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, left boolean, task long"
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    end = end_id.to_bytes(4, "little")

    def out(packer: Packer, doc_type: pa.DataType, task: int) -> pa.RecordBatch:
        done, packer.done = packer.done, []
        columns = [list(c) for c in zip(*done)] or [[] for _ in range(8)]
        return record(pa.schema([("doc_id", doc_type), *_FIELDS]), [*columns, [task] * len(done)])

    def first(batches):
        encoder = _encoder(shared.value)
        task = TaskContext.get().partitionId()
        packer, doc_type = Packer(size, open_windows, task << 36), None
        for batch in batches:
            for block in blocks(batch):
                doc_type = block.column("doc_id").type
                for doc, text in zip(block.column("doc_id").to_pylist(), texts_of(block)):
                    ids = encoder.encode(text) + end
                    packer.add(doc, 0, ids, len(ids) // 4)
                yield out(packer, doc_type, task)
        packer.close()
        if doc_type is not None:
            yield out(packer, doc_type, task)

    def merge(batches, turn: int):
        task = TaskContext.get().partitionId()
        packer, doc_type = Packer(size, 1, turn << 57 | task << 36), None
        for batch in batches:
            doc_type = batch.column("doc_id").type
            for row in batch.to_pylist():
                packer.add(row["doc_id"], row["start"], row["ids"], row["doc_tokens"])
            yield out(packer, doc_type, task)
        packer.close()
        if doc_type is not None:
            yield out(packer, doc_type, task)

    packed = cut(rows.mapInArrow(first, schema), "packed")
    results, turn = [packed.where("NOT left")], 1
    left = packed.where("left")
    tasks = (left.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        groups = -(-tasks // FAN_IN)
        grouped = left.withColumn("task", F.floor(F.col("task") / FAN_IN))
        grouped = grouped.repartition(groups, "task").sortWithinPartitions("task", "sequence_id", "offset")
        merged = cut(grouped.mapInArrow(lambda batches, turn=turn: merge(batches, turn), schema), "merged")
        if groups == 1:
            results.append(merged)
            break
        results.append(merged.where("NOT left"))
        left, turn = merged.where("left"), turn + 1
        tasks = groups
    return reduce(DataFrame.unionByName, results).drop("left", "task")
