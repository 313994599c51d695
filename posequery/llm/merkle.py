"""Merkle manifests of datasets, with persistent versions by path copying.

Rows are leaves.  A tree's leaves, in order, meet in runs of sixteen, the runs' digests again, up to
one root; the roots of all trees are the leaves of a last tree.  Leaves lie in aligned blocks of
4,096, a row each, whose lower levels are hashed where the block lies.  What stands above the
blocks is built level by level, and each block receives the siblings on its way to the root.

A changed leaf makes a version of the manifest.  It shares every untouched node and copies
only the leaf's ancestors: those within the block beside the block's own nodes, the upper ones
beside the siblings that the block received.  So versions are made where their leaf lies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posequery.llm.common import keyed_columns, record
from posequery.llm.numbering import numbered
from posequery.session import cut

FAN = 16
#: Levels of a block, which has ``FAN ** LEVELS`` leaves at most.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest_of(*values: Column) -> Column:
    """Hexadecimal SHA-256 of all values: ``-`` for null, else number of bytes, ``:`` and value."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def lowered(text: Column) -> Column:
    """``text`` with the letters A-Z in lower case, and no others."""
    return F.translate(text, _UPPER, _LOWER)


def joined_digest(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels_of(digests: list[str], levels: int) -> list[list[str]]:
    """The digests and, above them, those of their runs, ``levels`` times."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([joined_digest(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return out


def depth(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    n, out = leaves, 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def blocks_of(leaves: DataFrame) -> DataFrame:
    """``tree, place, n, leaves``: a row for each aligned block of ``leaves`` (``tree, place, n`` and more).

    ``place`` numbers a tree's leaves from 0, then its blocks; ``n`` counts the tree's leaves.
    """
    rest = [c for c in leaves.columns if c not in ("tree", "place", "n")]
    block = F.floor(F.col("place") / FAN**LEVELS)
    rows = leaves.groupBy("tree", block.alias("block"), "n").agg(F.sort_array(F.collect_list(F.struct("place", *rest))).alias("leaves"))
    return cut(rows.withColumnRenamed("block", "place"), "blocks")


def block_roots(blocks: DataFrame) -> DataFrame:
    """``tree, place, n, digest``: the node over each block, and the number of nodes beside it."""

    schema = pa.schema([("tree", pa.int64()), ("place", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, sizes = batch.column("leaves"), batch.column("n").to_pylist()
            found = [levels_of(lists[i].as_py(), min(depth(n), LEVELS))[-1][0] for i, n in enumerate(sizes)]
            beside = [-(-n // FAN**LEVELS) for n in sizes]
            yield record(schema, [batch.column("tree"), batch.column("place"), beside, found])

    return blocks.select("tree", "place", "n", F.col("leaves.leaf").alias("leaves")).mapInArrow(run, "tree long, place long, n long, digest string")


def upper_levels(nodes: DataFrame) -> list[DataFrame]:
    """Levels of all trees from ``nodes`` (``tree, place, n, digest``) up; a tree ends where ``n`` is 1.

    Each level is written; a run is sixteen digests at most.  One number a level reaches the driver.
    """
    out = [cut(nodes, "level")]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        runs = out[-1].where("n > 1").groupBy("tree", F.floor(F.col("place") / FAN).alias("run"), "n").agg(
            F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("kids")
        )
        digest = F.sha2(F.array_join("kids.digest", ""), 256)
        out.append(cut(runs.select("tree", F.col("run").alias("place"), F.ceil(F.col("n") / FAN).alias("n"), digest.alias("digest"), F.col("kids.digest").alias("kids")), "level"))
    return out


_PATH = "array<struct<left: string, right: string>>"


def roots_of(levels: list[DataFrame]) -> DataFrame:
    """``tree, digest``: the root of every tree."""
    tops = [level.where("n = 1").select("tree", "digest") for level in levels]
    out = tops[0]
    for top in tops[1:]:
        out = out.unionByName(top)
    return out


def paths_down(levels: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """``tree, place, path`` of the nodes of the lowest level: the siblings up to the root, and beyond.

    Each element holds the digests left and right of the node within its run.  ``above``
    (``tree, path``) goes on where a tree ends.
    """
    found = None
    for k in range(len(levels) - 1, -1, -1):
        tops = levels[k].where("n = 1").select("tree", "place")
        if above is None:
            here = tops.withColumn("path", F.array().cast(_PATH))
        else:
            here = tops.join(above, "tree")
        if found is not None:
            runs = levels[k + 1].join(found, ["tree", "place"])
            left = F.array_join(F.slice("kids", F.lit(1), F.col("at")), "")
            right = F.array_join(F.slice("kids", F.col("at") + 2, F.lit(FAN)), "")
            kids = runs.select("tree", "place", "kids", "path", F.explode(F.sequence(F.lit(0), F.size("kids") - 1)).alias("at"))
            step = F.array(F.struct(left.alias("left"), right.alias("right"))).cast(_PATH)
            kids = kids.select("tree", (F.col("place") * FAN + F.col("at")).alias("place"), F.concat(step, F.col("path")).alias("path"))
            here = here.unionByName(kids)
        found = cut(here, "paths")
    return found


def versions_in(leaves: list[str], changed: list[str | None], n: int, path: list[dict]) -> tuple[list[str], list[str]]:
    """For each leaf of a block its proof's digest, and the root of the version that it makes.

    ``path`` holds the siblings above the block.  A version takes the changed leaf, or the leaf
    itself where there is none, and copies its ancestors one by one.
    """
    levels = levels_of(leaves, min(depth(n), LEVELS))
    tail = "".join(step["left"] + step["right"] for step in path).encode()
    runs = [["".join(level[i : i + FAN]) for i in range(0, len(level), FAN)] for level in levels[:-1]]
    proofs, roots = [], []
    for i, leaf in enumerate(leaves):
        node, place, proof = changed[i] or leaf, i, hashlib.sha256()
        for run in runs:
            both, at = run[place // FAN], place % FAN * 64
            left, right = both[:at], both[at + 64 :]
            proof.update((left + right).encode())
            node = hashlib.sha256(f"{left}{node}{right}".encode()).hexdigest()
            place //= FAN
        proof.update(tail)
        for step in path:
            node = hashlib.sha256(f"{step['left']}{node}{step['right']}".encode()).hexdigest()
        proofs.append(proof.hexdigest())
        roots.append(node)
    return proofs, roots


def manifest(docs: DataFrame, tampered: Column | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    Every source is a tree whose leaves ascend by id; the sources' roots, null first and then
    bytewise, are the leaves of the last tree.  Rows that ``tampered`` marks (a condition over
    ``docs``; none by default) make a version with their text in lower case; the others are folded
    as they are, and ``verified`` says whether the version has the root of the manifest.  Null
    fields and empty ones differ.  Null ids come first; rows of one id go by their digest, and
    equal rows each are a leaf.  Texts may be of any length, only digests move.  ``columns``
    renames (own name: name in ``docs``).  An empty table gives no rows.  Runs jobs when called.
    """
    names = {c: c for c in FIELDS} | (columns or {})
    mark = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    rows = docs.select(*(F.col(f"`{old}`").alias(new) for new, old in names.items()), mark.alias("_mark"))
    fields = [F.col(c) for c in FIELDS[:-1]]
    leaves = rows.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        digest_of(*fields, F.col("text")).alias("leaf"),
        F.when(F.col("_mark"), digest_of(*fields, lowered(F.col("text")))).alias("changed"),
    )
    leaves = cut(leaves.withColumn("_at", F.monotonically_increasing_id()), "leaves")
    sources = cut(leaves.groupBy("source").agg(F.count("*").alias("n")), "sources")
    trees = cut(numbered(sources, ["source"], name="tree"), "trees")
    placed = numbered(leaves, ["source", "doc_id", "leaf", "_at"], ["source"])
    named = trees.withColumnRenamed("source", "_source")
    placed = placed.join(named, placed["source"].eqNullSafe(named["_source"])).drop("_source", "source", "_at")
    blocks = blocks_of(placed)
    levels = upper_levels(block_roots(blocks))
    subroots = cut(roots_of(levels), "subroots")
    last = upper_levels(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(sources.count()).cast("long").alias("n"), "digest"))
    root = roots_of(last).first()
    above = paths_down(last).select(F.col("place").alias("tree"), "path").join(subroots.withColumnRenamed("digest", "subroot"), "tree")
    paths = paths_down(levels, above.select("tree", "path"))
    ready = blocks.join(paths, ["tree", "place"]).join(subroots.withColumnRenamed("digest", "subroot"), "tree")
    kind = leaves.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.slice(i, 1)
                rows = pa.RecordBatch.from_struct_array(own.column("leaves").flatten())
                digests = rows.column("leaf").to_pylist()
                proofs, roots = versions_in(digests, rows.column("changed").to_pylist(), own.column("n")[0].as_py(), own.column("path")[0].as_py())
                ids = rows.column("doc_id")
                columns = [ids, digests, [own.column("subroot")[0].as_py()] * len(digests), proofs, roots]
                yield record(pa.schema([("doc_id", ids.type), *((c, pa.string()) for c in ("leaf", "subroot", "proof_sha256", "folded_root"))]), columns)

    found = ready.select("leaves", "n", "path", "subroot").mapInArrow(run, f"doc_id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string")
    whole = F.lit(root["digest"] if root else None).cast("string")
    return found.select("doc_id", "leaf", "subroot", whole.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == whole).alias("verified"))
