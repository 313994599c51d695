"""A corpus pipeline: quality rules, exact, near and repeated-passage deduplication, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posequery.llm import exact_dedup, near_dedup, packing, quality, repeats
from posequery.llm.common import free_name, with_row_key
from posequery.llm.queries import vocabulary
from posequery.session import cut


def _kept(docs: DataFrame, verdicts) -> DataFrame:
    """Rows of ``docs`` whose key is ``kept`` by ``verdicts(keyed rows, name of the key)``."""
    key = free_name(docs, "_row_key")
    rows = with_row_key(docs, key=key)
    verdict = verdicts(rows, id_col=key).where("kept").select(F.col("doc_id").alias(key))
    return rows.join(verdict, key, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with all their columns.

    Null, empty and short texts are rejected; equal rows are judged alike; an empty table stays
    empty.  Texts of any length are judged whole.
    """
    return quality.keep(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal ones, that with the smallest id, with all its columns.

    Null texts equal empty ones.  Of rows with null or repeated ids the one read first stays.
    """
    return _kept(docs, exact_dedup.exact_duplicates)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest id, with all its columns.

    Texts without words, null ones too, are classes of their own and stay.  Of rows with null or
    repeated ids the one read first stays.
    """
    return _kept(docs, near_dedup.near_duplicates)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that occur twice; parts of cut code points go too.

    ``n_chars`` follows the text.  A document that loses nothing stays as it is, null and empty texts
    among them; one that repeats whole stays with an empty text.
    """
    key, spans_col = free_name(docs, "_row_key"), free_name(docs, "_spans")
    rows = with_row_key(docs, key=key)
    spans = repeats.spans_per_row(repeats.repeated_spans(rows.select(F.col(key).alias("_key"), "text")))
    spans = spans.select(F.col("_key").alias(key), F.col("spans").alias(spans_col))
    texts = repeats.cut_texts(rows.join(spans, key, "left"), spans_col=spans_col)
    texts = texts.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))
    return texts.select(*(F.col(f"`{c}`") for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 2048 tokens, with their ids.

    Null and empty texts are one closing id; an empty table gives no pieces.
    """
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact duplicates", exact_duplicates),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("packing", packed),
]

#: Tokens and the placing of pieces have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
