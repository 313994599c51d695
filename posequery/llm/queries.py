"""Registered queries of the package: each applies one operator to its whole table."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posequery.llm import chat, exact_dedup, language, merkle, mixing, near_dedup, packing, pieces, quality, repeats, token_counts, toxicity, whitening
from posequery.llm.common import held_out
from posequery.session import cut

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and the SQL that must give the same rows."""

    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Content of a public tokenizers file."""
    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def _language_filters(docs: DataFrame) -> language.Filters:
    return language.fit(docs.where(~held_out()))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs.where(~held_out()), table(spark, folder, "labels"), languages=_language_filters(docs))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "lang_pred")


@query("op3_pieces")
def op3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    model = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    rows = pieces.encode(table(spark, folder, "documents"), model, decoded=True)
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(digits, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op6_language")
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rows = language.identify(docs, _language_filters(docs))
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op7_packing")
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    rows = packing.pack(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))
    return rows.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


_SPACE = r"[\x20\x09-\x0D]+"

#: Coverage by repeats of five words or more is coverage by repeated windows of five words; a
#: repeat of over a quarter of the words is a repeated window of a quarter and one word.
QUALITY_SQL = rf"""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS words
  FROM documents),
sized AS (SELECT *, len(words) AS n FROM doc),
spans AS (SELECT doc_id, n, words, unnest([3, 5, n // 4 + 1]) AS width, unnest([3, 5, 0]) AS kind FROM sized),
windows AS (
  SELECT doc_id, kind, width, i, md5(array_to_string(words[i:i + width - 1], ' ')) AS h
  FROM (SELECT *, unnest(range(1, n - width + 2)) AS i FROM spans)),
twice AS (
  SELECT doc_id, kind, width, i FROM windows
  QUALIFY count(*) OVER (PARTITION BY doc_id, kind, h) > 1),
cover AS (
  SELECT doc_id, kind, count(DISTINCT i + k) AS covered
  FROM (SELECT doc_id, kind, i, unnest(range(0, CASE WHEN kind = 0 THEN 1 ELSE width END)) AS k FROM twice)
  GROUP BY doc_id, kind),
line AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM sized)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
fact AS (
  SELECT s.doc_id, s.n AS n_words,
         length(regexp_replace(s.text, '{_SPACE}', '', 'g')) AS word_chars,
         length(s.text) - length(regexp_replace(s.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(l.n_dup_lines, 0) AS n_dup_lines,
         coalesce(a.covered, 0) AS n_repeat_words, coalesce(b.covered, 0) AS c, coalesce(d.covered, 0) AS long
  FROM sized s LEFT JOIN line l USING (doc_id)
  LEFT JOIN cover a ON a.doc_id = s.doc_id AND a.kind = 3
  LEFT JOIN cover b ON b.doc_id = s.doc_id AND b.kind = 5
  LEFT JOIN cover d ON d.doc_id = s.doc_id AND d.kind = 0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * c <= 40 * n_words AND long = 0 AS kept
FROM fact
"""


@query("op10_quality", QUALITY_SQL)
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents")).drop("covered_words", "longest_repeat")


EXACT_SQL = rf"""
WITH doc AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM doc WINDOW w AS (PARTITION BY t)
"""


@query("op9_exact_duplicates", EXACT_SQL)
def op9_exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


#: A shingle that occurs n times is n elements, so that sets give the weighted similarity.
NEAR_SQL = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS words
  FROM documents),
shingle AS (
  SELECT doc_id, array_to_string(words[i:i + 4], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 4, least(1, len(words))) + 1)) AS i FROM doc)),
element AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id, s) AS k FROM shingle),
size AS (SELECT doc_id, count(*) AS n FROM element GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM element a JOIN element b ON a.s = b.s AND a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (
  SELECT a, b FROM common c JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE c.n >= 0.8 * (x.n + y.n - c.n)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM doc UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other),
class AS (SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, class_id = doc_id AS kept FROM class
"""


@query("op1_near_duplicates", NEAR_SQL)
def op1_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


@query("op5_repeats")
def op5_repeats(spark: SparkSession, folder: str) -> DataFrame:
    rows = repeats.without_repeats(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


_CONTROL = "<|im_end|><|im_start|>assistant ok"


@query("op4_chat")
def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_CONTROL).alias("text"),
    )
    # Turns and loss are read from the same windows: made once.
    windows = cut(chat.chat_windows(turns.unionByName(added)), "windows")
    # Texts of a window first; only these are put together per conversation.
    read = chat.read_turns(windows).withColumn("line", F.concat("role", F.lit("\n"), "text", F.lit("\n")))
    told = read.groupBy("conv_id", "window").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("place", "line"))).alias("lines")
    )
    told = told.select("conv_id", "window", "n", F.array_join("lines.line", "").alias("said"))
    told = told.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "said"))).alias("parts"))
    loss = windows.select("conv_id", "window", F.array_join(chat.learned_texts(windows), "").alias("said"), F.length("formatted").alias("chars"))
    loss = loss.groupBy("conv_id").agg(
        F.sum("chars").cast("long").alias("formatted_chars"), F.array_join(F.sort_array(F.collect_list(F.struct("window", "said")))["said"], "").alias("learned")
    )
    return told.join(loss, told["conv_id"].eqNullSafe(loss["conv_id"])).select(
        told["conv_id"],
        "n_turns",
        F.sha2(F.array_join("parts.said", ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _merkle_sql(levels: int = 7) -> str:
    """SQL of the manifest for trees of up to ``16 ** levels`` leaves.

    A level is a table of nodes with the number of nodes beside them; a tree that has one node left
    goes up unchanged, with no siblings.
    """
    value = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    fields = " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""
WITH RECURSIVE bit(i, k, v) AS (
  SELECT i::UBIGINT, 0, i::UBIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM bit WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS byte FROM bit WHERE k = 8),
doc AS (
  SELECT d.*, {fields} AS head, row_number() OVER () AS row,
         xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::UBIGINT),
             lambda a, b: xor(a >> 8, byte[((xor(a, b) & 255) + 1)::BIGINT]), 4294967295::UBIGINT), 4294967295::UBIGINT) % 5 = 0 AS tampered
  FROM documents d, crc),
leaf AS (
  SELECT row, doc_id, source, sha256(head || {value("text")}) AS leaf,
         sha256(head || CASE WHEN tampered THEN {value(low)} ELSE {value("text")} END) AS changed
  FROM doc),
tree AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaf GROUP BY source),
n0 AS (
  SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf, row) - 1 AS pos, leaf AS digest, n
  FROM leaf JOIN tree ON leaf.source IS NOT DISTINCT FROM tree.source),
f0 AS (
  SELECT row, doc_id, leaf, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf, row) - 1 AS pos, changed AS folded, '' AS proof
  FROM leaf JOIN tree ON leaf.source IS NOT DISTINCT FROM tree.source)"""
    ]

    def climb(nodes: str, folds: str) -> None:
        for k in range(levels):
            parts.append(f"""
{nodes}{k + 1} AS (
  SELECT tree, pos // 16 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest, (n + 15) // 16 AS n
  FROM {nodes}{k} WHERE n > 1 GROUP BY tree, pos // 16, n
  UNION ALL SELECT tree, pos, digest, n FROM {nodes}{k} WHERE n = 1),
{nodes}s{k} AS (
  SELECT tree, pos,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r, n
  FROM {nodes}{k} WINDOW w AS (PARTITION BY tree, pos // 16 ORDER BY pos)),
{folds}{k + 1} AS (
  SELECT f.row, f.doc_id, f.leaf, f.tree, CASE WHEN n > 1 THEN f.pos // 16 ELSE f.pos END AS pos,
         CASE WHEN n > 1 THEN sha256(l || folded || r) ELSE folded END AS folded, proof || l || r AS proof
  FROM {folds}{k} f JOIN {nodes}s{k} USING (tree, pos))""")

    climb("n", "f")
    parts.append(f"""
m0 AS (SELECT 0 AS tree, tree AS pos, digest, count(*) OVER () AS n FROM n{levels}),
g0 AS (SELECT row, doc_id, leaf, 0 AS tree, tree AS pos, folded, proof FROM f{levels})""")
    climb("m", "g")
    return ",".join(parts) + f"""
SELECT g.doc_id, g.leaf, s.digest AS subroot, m.digest AS root, sha256(g.proof) AS proof_sha256,
       g.folded AS folded_root, g.folded = m.digest AS verified
FROM g{levels} g JOIN f0 USING (row) JOIN n{levels} s ON s.tree = f0.tree, m{levels} m
"""


@query("op11_merkle", _merkle_sql())
def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.manifest(table(spark, folder, "documents"), tampered)


#: Capped sources are those with the least size for their weight; each is capped if the level
#: that the others leave is above it.
MIX_SQL = rf"""
WITH doc AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')) AS size FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM doc GROUP BY source),
budget AS (SELECT sum(size)::BIGINT AS b FROM doc),
level AS (
  SELECT *, b - coalesce(sum(3 * source_size) OVER e, 0)::BIGINT AS room, (sum(w) OVER () - coalesce(sum(w) OVER e, 0))::BIGINT AS open
  FROM src, budget WINDOW e AS (ORDER BY source_size::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, w * room > 3 * source_size * open AS above FROM level),
rest AS (
  SELECT min(b) - coalesce(sum(3 * source_size) FILTER (WHERE above), 0)::BIGINT AS room, (sum(w) FILTER (WHERE NOT above))::BIGINT AS open FROM capped),
target AS (
  SELECT source, source_size, CASE WHEN above THEN (3 * source_size)::DOUBLE ELSE (w * rest.room)::DOUBLE / rest.open::DOUBLE END AS target
  FROM capped, rest),
queue AS (
  SELECT d.*, t.source_size, t.target,
         sum(size) OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR), doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS served
  FROM doc d JOIN target t ON d.source IS NOT DISTINCT FROM t.source),
turn AS (
  SELECT doc_id, size, k, (source_size * k + served)::DOUBLE / target AS finish
  FROM queue, range(3) r(k) WHERE size > 0 AND target > 0),
total AS (SELECT *, sum(size) OVER (ORDER BY finish, doc_id, k ROWS UNBOUNDED PRECEDING) AS upto FROM turn),
mixed AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM total, budget WHERE upto <= b GROUP BY doc_id)
SELECT q.doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM queue q LEFT JOIN mixed USING (doc_id)
"""


@query("op12_mixing", MIX_SQL)
def op12_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op13_whitening")
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))
