"""Exact duplicates through content-defined chunks.

A normalised text is cut where a hash of the eight bytes before the cut has ten zero bits, so
equal stretches are cut alike.  Chunks are first known by a digest.  Every chunk body moves
once, combined per digest before the shuffle, to verify that all bodies of a digest are
equal; a digest then is an identifier.  Should bodies differ, the identifier of such a
chunk is its digest and body together.  Documents are equal if their ordered lists of
identifiers are; only lists are compared from then on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posequery.llm.common import keyed, map_blocks, record, texts_of
from posequery.session import cut

LEAST, MEAN_BITS, MOST = 256, 10, 8192
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: bytes) -> bytes:
    """The text with each run of ASCII white space as one space."""
    words = text.split()
    if not words:
        return b" " if text else b""
    return b" " * text[:1].isspace() + b" ".join(words) + b" " * text[-1:].isspace()


def chunks(text: bytes) -> list[bytes]:
    """Consecutive pieces of ``text``; none for an empty one."""
    n = len(text)
    if n <= LEAST:
        return [text] if text else []
    eight = np.ndarray((n - 7,), "<u8", text, 0, (1,))
    marks = np.flatnonzero((eight * _MIX) >> np.uint64(64 - MEAN_BITS) == 0) + 8
    out, last = [], 0
    for mark in [*marks.tolist(), n]:
        while mark - last > MOST:
            out.append(text[last : last + MOST])
            last += MOST
        if mark - last >= LEAST or mark == n and mark > last:
            out.append(text[last:mark])
            last = mark
    return out


def digest_of(body: bytes, size: int = 16) -> bytes:
    return hashlib.blake2b(body, digest_size=size).digest()


def _recipes(rows: DataFrame, size: int) -> DataFrame:
    """``_key, text_sha256, recipe`` with the digests of each row's chunks in order."""

    def make():
        def work(block: pa.RecordBatch) -> pa.RecordBatch:
            texts = [normalised(t) for t in texts_of(block)]
            schema = pa.schema([("_key", pa.int64()), ("text_sha256", pa.string()), ("recipe", pa.list_(pa.binary()))])
            lists = [[digest_of(c, size) for c in chunks(t)] for t in texts]
            return record(schema, [block.column("_key"), [hashlib.sha256(t).hexdigest() for t in texts], lists])

        return work

    return map_blocks(rows.select("_key", "text"), make, "_key long, text_sha256 string, recipe array<binary>")


def _bodies(rows: DataFrame, size: int) -> DataFrame:
    """``_key, place, digest, body`` of every chunk."""

    def make():
        def work(block: pa.RecordBatch) -> pa.RecordBatch:
            keys, places, digests, bodies = [], [], [], []
            for key, text in zip(block.column("_key").to_pylist(), texts_of(block)):
                for place, body in enumerate(chunks(normalised(text))):
                    keys.append(key)
                    places.append(place)
                    digests.append(digest_of(body, size))
                    bodies.append(body)
            schema = pa.schema([("_key", pa.int64()), ("place", pa.int32()), ("digest", pa.binary()), ("body", pa.binary())])
            return record(schema, [keys, places, digests, bodies])

        return work

    return map_blocks(rows.select("_key", "text"), make, "_key long, place int, digest binary, body binary")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_size: int = 16) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row.

    Of equal texts the row with the smallest id stays (null ids come last; of rows with one id,
    one stays).  Null counts as an empty text; empty texts equal each other, and not a single
    space.  An empty table gives no rows.  Runs jobs when called.
    """
    rows = keyed(docs, id_col, text_col)
    recipes = cut(_recipes(rows, digest_size), "recipes")
    checked = _bodies(rows, digest_size).groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    unsure = cut(checked.where("low <> high").select("digest"), "unsure")
    if not unsure.isEmpty():
        named = _bodies(rows, digest_size).join(unsure.withColumn("unsure", F.lit(True)), "digest", "left")
        name = F.when(F.col("unsure"), F.concat("digest", "body")).otherwise(F.col("digest"))
        lists = named.groupBy("_key").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("place", name.alias("name")))), lambda x: x["name"]).alias("names")
        )
        recipes = recipes.join(lists, "_key", "left").select(
            "_key", "text_sha256", F.coalesce("names", "recipe").alias("recipe")
        )
    recipes = recipes.join(rows.select("_key", "doc_id"), "_key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "_key")).alias("first")
    groups = recipes.groupBy("recipe").agg(first, F.count("*").alias("group_size"))
    found = recipes.join(groups.where("group_size > 1"), "recipe", "left")
    return found.select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("first._key") == F.col("_key"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
