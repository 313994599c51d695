"""SentencePiece BPE encoding and decoding with a table of last tokens.

Pieces that merge by rank have one encoding per text, and every prefix's encoding ends in one
token: the piece that ends there and may stand after the last token of the prefix before it.
An Aho-Corasick automaton lists the pieces that end at each place; whether two tokens may stand
side by side is found by undoing their merges, latest first, and asking at each step
whether the pieces at the border would have merged earlier.  Ids are read off the table
backwards.

No piece holds a line break, nor a space mark after another character, so texts are cut there
and each distinct cut is encoded once as long as a worker remembers it.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from posequery.llm.common import id_and_text, map_blocks, record, texts_of

SPACE = "▁"
#: Cut words whose ids a Python worker keeps (the first it meets), and their longest size.
KEEP, LONGEST = 400_000, 64
_NEVER = float("inf")


class PieceTable:
    """Encoder and decoder for the content of one BPE model file with byte fallback."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = own.get_piece_size()
        self.texts: list[str | None] = [None] * size
        self.bytes: dict[int, int] = {}
        ids: dict[str, int] = {}
        for i in range(size):
            piece = own.id_to_piece(i)
            if own.is_byte(i):
                self.bytes[i] = int(piece[3:5], 16)
            elif own.is_unknown(i):
                self.texts[i] = " ⁇ "
            elif own.is_control(i):
                self.texts[i] = ""
            else:
                self.texts[i] = piece.replace(SPACE, " ")
                ids[piece] = i
                if "\n" in piece or SPACE in piece.lstrip(SPACE):
                    raise ValueError("pieces with inner spaces or line breaks cannot be cut")
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.rank = {i: -own.get_score(i) if len(p) > 1 else -1.0 for p, i in ids.items()}
        self.chars = {p for p in ids if len(p) == 1}
        self.joined: dict[tuple[int, int], float] = {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                pair = ids.get(piece[:cut]), ids.get(piece[cut:])
                if None not in pair:
                    self.joined[pair] = self.rank[i]
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in sorted(ids.items(), key=lambda x: (self.rank[x[1]], len(x[0]))):
            made = len(piece) == 1
            for cut in range(1, len(piece)):
                a, b = ids.get(piece[:cut]), ids.get(piece[cut:])
                whole = all(x in self.left or self.rank.get(x) == -1.0 for x in (a, b))
                if whole and self._apart(a, b, self.rank[i]):
                    self.left[i], self.right[i], made = a, b, True
                    break
            if made:  # other pieces can never come out of merges
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        #: Two characters that stand side by side in some piece; a text may be cut between others.
        self.neighbours = {p[k : k + 2] for p in ids for k in range(len(p) - 1)}
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def _apart(self, a: int, b: int, limit: float = _NEVER) -> bool:
        """Whether ``a`` and ``b`` side by side stay two tokens until merges of rank ``limit``."""
        rank, tie = self.rank, False
        while True:
            merge = self.joined.get((a, b))
            if merge is not None and (merge < limit or tie and merge == limit):
                return False
            x = rank[a] if a in self.right else -1.0
            y = rank[b] if b in self.left else -1.0
            if x < 0 and y < 0:
                return True
            if x > y:
                a, limit, tie = self.right[a], x, False
            else:  # of equal merges the left one comes first, so the right one is undone first
                b, limit, tie = self.left[b], y, True

    def _known(self, word: str) -> list[int]:
        """Ids of a word whose characters are all pieces."""
        last: list[tuple[int, int] | None] = [None] * len(word)
        pairs = self.pairs
        for end, (token, size) in self.automaton.iter(word):
            start = end - size
            if last[end] is not None:
                continue
            if start < 0:
                last[end] = token, start
            elif last[start] is not None:
                pair = last[start][0], token
                fits = pairs.get(pair)
                if fits is None:
                    fits = pairs[pair] = self._apart(*pair)
                if fits:
                    last[end] = token, start
        out, at = [], len(word) - 1
        while at >= 0:
            token, at = last[at]
            out.append(token)
        return out[::-1]

    def _missed(self, word: bytes) -> tuple[int, ...]:
        """Ids of a word after spaces that is not remembered; its tail of signs may be cut off."""
        text = word.decode("utf-8", "replace")
        at = len(text)
        while at > 1 and not text[at - 1].isalnum():
            at -= 1
        if at < len(text) and text[at - 1].isalnum() and text[at - 1 : at + 1] not in self.neighbours:
            head = self.cache.get(text[:at].encode())
            if head is None:
                head = self._missed(text[:at].encode())
                if len(self.cache) < KEEP and at <= LONGEST:
                    self.cache[text[:at].encode()] = head
            return head + self.word(text[at:].replace(" ", SPACE))
        return self.word(SPACE + text.replace(" ", SPACE))

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one cut word; characters that are no piece become their bytes."""
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        if self.chars.issuperset(word):
            return tuple(self._known(word))
        out, run = [], ""
        for char in word + "\0":
            if char in self.chars:
                run += char
                continue
            out += self._known(run) if run else []
            out += [self.byte_ids[b] for b in char.encode()]
            run = ""
        return tuple(out[: len(out) - 1])

    def encode(self, text: bytes) -> list[int]:
        """Ids of a UTF-8 text, as the library gives them without begin and end."""
        if not text:
            return []
        cache, out = self.cache, []
        text = text.replace(SPACE.encode(), b" ")
        for row, line in enumerate((b" " + text).split(b"\n")):
            if row:
                out.append(self.byte_ids[10])
            words = line.split(b" ")
            if words[0]:  # at the start of a line other than the first: no mark before it
                out += self.word(words[0].decode("utf-8", "replace"))
            if b"  " in line or line.endswith(b" "):
                words = self._runs(words[1:])
            else:
                words = words[1:]
            for word in words:
                got = cache.get(word)
                if got is None:
                    got = self._missed(word)
                    if len(word) <= LONGEST and len(cache) < KEEP:
                        cache[word] = got
                out += got
        return out

    @staticmethod
    def _runs(words: list[bytes]) -> Iterable[bytes]:
        """Words after one space each; more spaces go to the word that follows them."""
        before = b""
        for k, word in enumerate(words):
            if word or k == len(words) - 1:
                yield before + word
                before = b""
            else:
                before += b" "

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ``ids``; one space at the start, which encoding puts there, is dropped."""
        texts, raw = self.texts, self.bytes
        parts, run = [], bytearray()
        for i in ids:
            text = texts[i]
            if text is None:
                run.append(raw[i])
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run = bytearray()
            parts.append(text)
        if run:
            parts.append(run.decode("utf-8", "replace"))
        out = "".join(parts)
        return out[1:] if out.startswith(" ") else out


_TABLES: dict[int, PieceTable] = {}


def _table(model: bytes) -> PieceTable:
    key = hash(model)
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = PieceTable(model)
    return _TABLES[key]


def encode(docs: DataFrame, model: bytes, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` of every row, and ``decoded`` text if asked for.

    ``model`` is the content of a model file.  Null and empty texts have no ids; repeated rows
    and null ids are kept; an empty table gives no rows.
    """
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        table = _table(shared.value)

        def work(block: pa.RecordBatch) -> pa.RecordBatch:
            ids = [table.encode(t) for t in texts_of(block)]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
            key = block.column("doc_id")
            columns = [key, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            fields = [("doc_id", key.type), ("ids", pa.list_(pa.int32()))]
            if decoded:
                columns.append([table.decode(x) for x in ids])
                fields.append(("decoded", pa.string()))
            return record(pa.schema(fields), columns)

        return work

    return map_blocks(rows, make, f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded)


def decode(rows: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of every row's ids; null ids and empty lists give an empty text."""
    from pyspark.sql import functions as F

    own = rows.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        table = _table(shared.value)
        for batch in batches:
            texts = [table.decode(x) for x in batch.column("ids").to_pylist()]
            key = batch.column("doc_id")
            yield record(pa.schema([("doc_id", key.type), ("text", pa.string())]), [key, texts])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text string")
