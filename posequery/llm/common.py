"""What the operators of this package share: Arrow blocks, row keys, words as codes.

Every operator reads its id and text column by name, renames them before anything else and
ignores all other columns, so extra columns with any name are harmless.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posequery.session import cut

#: Bytes of text that one numpy pass holds at a time, apart from a single longer text.
BLOCK_BYTES = 2 << 20


def blocks(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most ``most`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_blocks(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str
) -> DataFrame:
    """``df`` (with a column ``text``) through the function that ``make`` builds once per task."""

    def run(batches):
        work = make()
        for batch in batches:
            for block in blocks(batch):
                yield work(block)

    return df.mapInArrow(run, schema)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``doc_id`` and ``text`` only; null texts stay null."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``text`` and ``_key``, a long that no two rows share.

    Where ids are unique longs the key is the id.  Rows with null or repeated ids get keys
    of their own; the keyed rows are then written once, so that a rerun cannot number them
    anew.
    """
    rows = id_and_text(docs, id_col, text_col)
    if dict(rows.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint"):
        ids = rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
        if ids.isEmpty():
            return rows.withColumn("_key", F.col("doc_id").cast("long"))
    return cut(rows.withColumn("_key", F.monotonically_increasing_id()), "keyed")


def keyed_columns(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``_key`` and the ``columns`` (own name: name in ``docs``), ``doc_id`` among them.

    The key is the id where ids are unique longs.  Else rows are numbered as they are read and
    written once, so that a rerun of a task cannot number them anew.
    """
    rows = docs.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))
    if dict(rows.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint"):
        if rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
            return rows.withColumn("_key", F.col("doc_id").cast("long"))
    return cut(rows.withColumn("_key", F.monotonically_increasing_id()), "keyed")


def texts_of(block: pa.RecordBatch) -> list[bytes]:
    """UTF-8 bytes of the block's texts; null counts as empty."""
    return pc.fill_null(block.column("text").cast(pa.binary()), b"").to_pylist()


def coded(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of ``texts``, the words as codes into them, and each text's offsets.

    Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``.
    """
    index: dict[bytes, int] = defaultdict(count().__next__)
    parts, offsets = [], np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        words = text.split()
        offsets[i + 1] = offsets[i] + len(words)
        parts.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
    return list(index), np.concatenate(parts) if parts else np.zeros(0, np.int32), offsets


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each text; 0 for texts without words."""
    totals = np.zeros((len(values) + 1, *values.shape[1:]), np.result_type(values.dtype, np.int64))
    np.cumsum(values, axis=0, out=totals[1:])
    return totals[offsets[1:]] - totals[offsets[:-1]]


def held_out(id_col: str = "doc_id"):
    """Whether the row is kept out of every training set: crc32 of the id's text mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def record(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """A record batch of ``schema`` from arrays, numpy arrays and lists."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)]
    arrays = [a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``docs`` has it in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_row_key(docs: DataFrame, id_col: str = "doc_id", key: str = "_row_key") -> DataFrame:
    """``docs`` with a long ``key`` that no two rows share: the id where ids are unique longs.

    ``key`` must be a name that ``docs`` does not have (:func:`free_name`).  Rows with null or repeated
    ids are numbered as they are read and written once; an empty table stays empty.
    """
    if dict(docs.dtypes)[id_col] == "bigint":
        ids = docs.groupBy(id_col).count().where(f"count > 1 OR `{id_col}` IS NULL")
        if ids.isEmpty():
            return docs.withColumn(key, F.col(id_col))
    return cut(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
