"""Token counts without ids: pieces are counted once per distinct pre-token and joined to frequencies.

A pre-token here is a run of bytes between ASCII white space, where the tokenizer always
cuts.  Each block of documents is reduced to per-document pre-token frequencies; the pre-tokens
a task has not met yet go to the tokenizer once, in one call, and only their numbers of pieces
are kept.  The sum of frequency times pieces is the document's count.  No rows are shuffled.
"""

from __future__ import annotations

import os
from collections import Counter
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame

from posequery.llm.common import id_and_text, map_blocks, record, texts_of

#: Distinct pre-tokens whose counts a Python worker keeps (the first it meets), and their longest size.
KEEP, LONGEST = 400_000, 64
_TABLES: dict[int, tuple] = {}


def _table(tokenizer_json: str) -> tuple:
    """Tokenizer and counts so far of this worker; only the last tokenizer is kept."""
    key = hash(tokenizer_json)
    if key not in _TABLES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TABLES.clear()
        _TABLES[key] = Tokenizer.from_str(tokenizer_json), {}
    return _TABLES[key]


def piece_counts(tokenizer, words: list[bytes]) -> list[int]:
    """Pieces of each word, special strings inside handled as the tokenizer's default."""
    texts = [w.decode("utf-8", "replace") for w in words]
    return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def totals(tokenizer, table: dict[bytes, int], texts: list[bytes]) -> list[int]:
    """Tokens of each text; ``table`` gains the counts of pre-tokens met for the first time."""
    frequencies = [Counter(text.split()) for text in texts]
    new = list(set().union(*frequencies).difference(table))
    table.update(zip(new, piece_counts(tokenizer, new)))
    sums = [sum(map(mul, map(table.__getitem__, f), f.values())) for f in frequencies]
    for word in reversed(new):
        if len(table) > KEEP or len(word) > LONGEST:
            del table[word]
    return sums


def count_tokens(
    docs: DataFrame,
    tokenizer_json: str,
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    ``tokenizer_json`` is the content of a tokenizers file whose pre-tokenizer always cuts at
    ASCII white space and drops it.  Null and empty texts have 0 tokens; null ids stay null;
    repeated rows are counted each; an empty table gives no rows.
    """
    kind = id_and_text(docs, id_col, text_col).schema["doc_id"].dataType.simpleString()
    broadcast = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def make():
        tokenizer, table = _table(broadcast.value)

        def work(block: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(block)
            counts = totals(tokenizer, table, texts)
            ids = block.column("doc_id")
            schema = pa.schema(
                [("doc_id", ids.type), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]
            )
            return record(schema, [ids, [len(t) for t in texts], counts, [n > limit for n in counts]])

        return work

    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    return map_blocks(id_and_text(docs, id_col, text_col), make, schema)
