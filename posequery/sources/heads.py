"""The first bytes of many files, without their contents.

Spark lists the files; tasks open each and read a fixed number of bytes, so what is read does not
depend on the size of the files.  A file that is gone, or that cannot be opened, is a row with
an error, and the other files of its task are read all the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Signature, first chunk and its checksum of a PNG file.
PNG_HEAD = 33
_SCHEMA = pa.schema([("path", pa.string()), ("head", pa.binary()), ("error", pa.string())])


def head_of(path: str, most: int) -> tuple[bytes | None, str | None]:
    """First bytes of the file at ``path`` (a URI or a local path), or what stood in the way."""
    try:
        system, place = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        with system.open_input_file(place) as file:
            return file.read_at(most, 0), None
    except FileNotFoundError:
        return None, "missing"
    except (OSError, ValueError, NotImplementedError, pa.ArrowException) as error:
        return None, f"unreadable: {type(error).__name__}"


def read_heads(files: DataFrame, most: int = PNG_HEAD) -> DataFrame:
    """``files`` (``path`` and keys of any kind) with ``content``, up to ``most`` bytes, and ``error``.

    Short files give what they have, missing and unreadable ones null and an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            heads = [(None, "missing") if p is None else head_of(p, most) for p in paths]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([h for h, _ in heads], pa.binary()), pa.array([e for _, e in heads], pa.string())], schema=_SCHEMA)

    read = files.select("path").distinct().mapInArrow(run, "path string, head binary, error string")
    return files.join(read.select(F.col("path"), F.col("head").alias("content"), "error"), "path", "left")
