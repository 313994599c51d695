"""Toxicity with a convolutional network over hashed word embeddings, trained in numpy.

A word's embedding is the sum of hashed rows for the word and its first letters, so forms of one
stem share weights.  Filters of several widths slide over the words; the maximum of each
filter over the text feeds a logistic unit.  A convolution is linear before its maximum, so
each distinct word of a block is projected once per filter column and the projections are added
at shifted places.  All labelled rows take part: blocks of them train side by side from the same weights,
which are averaged after each round.  Thresholds are calibrated per language on labelled rows that take no
part in training; at scoring time the language is the one identified from the text.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posequery.llm import language
from posequery.llm.common import coded, id_and_text, map_blocks, record, texts_of
from posequery.session import cut

WIDTHS = (1, 2, 3)
DEPTH, FILTERS = 12, 8
PREFIXES = (None, 4, 5, 6)
_BITS = 17
#: Rounds of training, rows of a block, and rows up to which a round passes over them twice.
ROUNDS, BLOCK_ROWS, FEW_ROWS = 3, 8_000, 8_000
#: Steps of a logit that thresholds are told apart by, and the largest logit.
_STEPS, _MOST = 256, 30


@dataclass
class Model:
    """Weights, the language filters, and the score's logit threshold per language."""

    embedding: np.ndarray
    filters: list[np.ndarray]  # per width: (width, DEPTH, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    languages: language.Filters | None
    thresholds: dict[str, float]


#: Embedding rows of the first words that this process has met; they depend on the word alone.
_PLACES: dict[bytes, int] = {}
_ROWS = np.zeros((1 << 18, len(PREFIXES)), np.int32)


def _hashed(words: list[bytes]) -> np.ndarray:
    mask = (1 << _BITS) - 1
    flat = (zlib.crc32(w if p is None else w[:p], k) & mask for w in words for k, p in enumerate(PREFIXES))
    table = np.fromiter(flat, np.int64, len(words) * len(PREFIXES)).reshape(len(words), len(PREFIXES))
    return table + np.arange(len(PREFIXES)) * (mask + 1)


def buckets(words: list[bytes]) -> np.ndarray:
    """Embedding rows of each word: one for the word, one for each prefix length."""
    places = np.fromiter((_PLACES.get(w, -1) for w in words), np.int64, len(words))
    out, new = _ROWS[places].astype(np.int64), np.flatnonzero(places < 0)
    out[new] = _hashed([words[i] for i in new])
    for i in new.tolist():
        if len(_PLACES) < len(_ROWS) and len(words[i]) <= language.LONGEST and words[i] not in _PLACES:
            _ROWS[len(_PLACES)] = out[i]
            _PLACES[words[i]] = len(_PLACES)
    return out


def _padded(codes: np.ndarray, offsets: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes with padding words after each text, so that every filter has a place in it."""
    extra = max(WIDTHS) - 1 + 1
    starts = offsets[:-1] + extra * np.arange(len(offsets) - 1)
    out = np.full(len(codes) + extra * (len(offsets) - 1), pad, np.int64)
    shift = np.repeat(extra * np.arange(len(offsets) - 1), np.diff(offsets))
    out[np.arange(len(codes)) + shift] = codes
    return out, starts


def _pooled(model: Model, vectors: np.ndarray, codes: np.ndarray, offsets: np.ndarray):
    """Maxima of all filters over each text; the padded codes and starts for training."""
    padded, starts = _padded(codes, offsets, len(vectors) - 1)
    maxima, fields = [], []
    for weights, bias in zip(model.filters, model.bias):
        field = None
        for j in range(len(weights)):
            part = (vectors @ weights[j])[padded]
            if j:
                part = np.concatenate([part[j:], np.zeros((j, FILTERS), np.float32)])
            field = part if field is None else field + part
        # Windows may reach into their text's own padding, never into the next text.
        last = np.concatenate([starts[1:], [len(padded)]]) - 1
        for j in range(len(weights) - 1):
            field[last - j] = -np.inf
        maxima.append(np.maximum.reduceat(field, starts, axis=0) + bias)
        fields.append(field)
    return np.concatenate(maxima, 1), fields, padded, starts


def logits(model: Model, texts: list[bytes]) -> np.ndarray:
    """Uncalibrated score of each text."""
    if not texts:
        return np.zeros(0)
    words, codes, offsets = coded([language.letters(t) for t in texts])
    vectors = np.zeros((len(words) + 1, DEPTH), np.float32)
    if words:
        vectors[:-1] = model.embedding[buckets(words)].sum(1)
    pooled = _pooled(model, vectors, codes, offsets)[0]
    return np.maximum(pooled, 0) @ model.out + model.out_bias


@dataclass
class Squares:
    """Sums of squared gradients, by which Adagrad sets the size of the steps."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float


def begun(rng: np.random.Generator) -> tuple[Model, Squares]:
    """An untrained network."""
    model = Model(
        rng.normal(0, 0.05, (len(PREFIXES) << _BITS, DEPTH)).astype(np.float32),
        [rng.normal(0, 0.3, (w, DEPTH, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0.3, 0.1, FILTERS * len(WIDTHS)).astype(np.float32),
        0.0,
        None,
        {},
    )
    small = lambda x: np.full(x.shape, 1e-4, np.float32)
    squares = Squares(
        np.full(len(model.embedding), 1e-4, np.float32), [small(f) for f in model.filters], [small(b) for b in model.bias], small(model.out), 1e-4
    )
    return model, squares


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 6, rate: float = 0.08, seed: int = 7) -> Model:
    """A network for 0/1 ``labels``, by Adagrad on batches of 32 texts, classes weighted evenly."""
    rng = np.random.default_rng(seed)
    model, squares = begun(rng)
    if len(labels):
        go_on(model, squares, texts, labels, epochs, rate, rng, labels.mean())
    return model


def go_on(
    model: Model, squares: Squares, texts: list[bytes], labels: np.ndarray, epochs: int, rate: float, rng: np.random.Generator, share: float
) -> None:
    """Train ``model`` further, in place; ``share`` of all rows has label 1."""
    words, codes, offsets = coded([language.letters(t) for t in texts])
    rows = buckets(words)
    share = np.clip(share, 0.01, 0.99)
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
    square_e, square_f, square_b = squares.embedding, squares.filters, squares.bias
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), 32):
            pick = order[k : k + 32]
            parts = [codes[offsets[i] : offsets[i + 1]] for i in pick]
            lengths = np.array([len(p) for p in parts])
            seen, local = np.unique(np.concatenate(parts), return_inverse=True)
            vectors = np.zeros((len(seen) + 1, DEPTH), np.float32)
            vectors[:-1] = model.embedding[rows[seen]].sum(1)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            pooled, fields, padded, starts = _pooled(model, vectors, local, ends)
            hidden = np.maximum(pooled, 0)
            score = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.out_bias, -30, 30)))
            error = ((score - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
            back = np.outer(error, model.out) * (pooled > 0)
            grad_out = hidden.T @ error
            squares.out += grad_out**2
            squares.out_bias += float(error.sum()) ** 2
            stops = np.concatenate([starts[1:], [len(padded)]])
            grad_v = np.zeros_like(vectors)
            for x, (weights, field) in enumerate(zip(model.filters, fields)):
                part = back[:, x * FILTERS : (x + 1) * FILTERS]
                peak = np.stack([field[a:b].argmax(0) + a for a, b in zip(starts, stops)])
                grad_w = np.zeros_like(weights)
                for j in range(len(weights)):
                    word = padded[np.minimum(peak + j, len(padded) - 1)]
                    grad_w[j] = np.einsum("bfd,bf->df", vectors[word], part)
                    np.add.at(grad_v, word, part[:, :, None] * weights[j].T[None])
                square_f[x] += grad_w**2
                weights -= rate * grad_w / np.sqrt(square_f[x])
                grad_b = part.sum(0)
                square_b[x] += grad_b**2
                model.bias[x] -= rate * grad_b / np.sqrt(square_b[x])
            model.out -= (rate * grad_out / np.sqrt(squares.out)).astype(np.float32)
            model.out_bias -= rate * float(error.sum()) / squares.out_bias**0.5
            moved = np.flatnonzero(np.abs(grad_v[:-1]).sum(1))
            targets, grads = rows[seen[moved]], grad_v[moved]
            size = (grads**2).mean(1)
            for c in range(targets.shape[1]):
                np.add.at(square_e, targets[:, c], size)
                np.add.at(model.embedding, targets[:, c], -rate * grads / np.sqrt(square_e[targets[:, c]])[:, None])


def _table(model: Model, squares: Squares) -> np.ndarray:
    """All that training changes, as rows of one width: embeddings with their squares, then the rest."""
    rest = [*model.filters, *model.bias, model.out, [model.out_bias], *squares.filters, *squares.bias, squares.out, [squares.out_bias]]
    flat = np.concatenate([np.ravel(x) for x in rest]).astype(np.float32)
    flat = np.pad(flat, (0, -len(flat) % (DEPTH + 1))).reshape(-1, DEPTH + 1)
    return np.concatenate([np.concatenate([model.embedding, squares.embedding[:, None]], 1), flat])


def _untabled(table: np.ndarray) -> tuple[Model, Squares]:
    """The network whose :func:`_table` is ``table``; its arrays are copies."""
    model, squares = begun(np.random.default_rng(0))
    n = len(model.embedding)
    model.embedding, squares.embedding = table[:n, :DEPTH].copy(), table[:n, DEPTH].copy()
    flat, at = table[n:].ravel(), 0
    for held in (model, squares):
        for into in (*held.filters, *held.bias, held.out):
            into[...] = flat[at : at + into.size].reshape(into.shape)
            at += into.size
        held.out_bias = float(flat[at])
        at += 1
    return model, squares


def calibrate(scores: np.ndarray, labels: np.ndarray, langs: list[str], rows: np.ndarray | None = None) -> dict[str, float]:
    """Logit thresholds that give each language its best F1; ``""`` holds that of all rows.

    An entry may stand for many rows of one score: ``rows`` of them, ``labels`` of which have label 1.
    """
    rows = np.ones(len(scores)) if rows is None else rows

    def best(own: np.ndarray, real: np.ndarray, n: np.ndarray) -> float:
        order = np.argsort(-own, kind="stable")
        hits = np.cumsum(real[order])
        f1 = 2 * hits / (np.cumsum(n[order]) + real.sum())
        f1[:-1][own[order][1:] == own[order][:-1]] = -1  # no cut within ties
        k = int(f1.argmax())
        low = own[order][k + 1] if k + 1 < len(own) else own[order][k] - 1
        return float((own[order][k] + low) / 2)

    langs = np.array(langs)
    out = {"": best(scores, labels, rows) if labels.any() else 0.0}
    for lang in set(langs.tolist()):
        own = langs == lang
        if labels[own].sum() >= 10 and (rows - labels)[own].sum() >= 10:
            out[lang] = best(scores[own], labels[own], rows[own])
    return out


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text, toxic, hold, dice`` of all labelled rows; null labels, texts and ids are left out.

    ``hold`` marks every fifth text, for calibration; ``dice`` deals rows to blocks.  Texts meet the labels by a shuffle.  A bit
    for the hash of each labelled id, ten bits per label, keeps most of the other texts from moving.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    size = max(64, 10 * known.count())
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    word, one = lambda c: F.shiftright(bit(c), 6), lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (bit(c) % 64).cast("int"))
    kind = docs.schema[id_col].dataType
    known = known.withColumn("doc_id", F.col("doc_id").cast(kind))
    bits = known.groupBy(word("doc_id").alias("_word")).agg(F.bit_or(one("doc_id")).alias("_bits"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL AND doc_id IS NOT NULL")
    rows = rows.join(F.broadcast(bits), word("doc_id") == F.col("_word")).where(F.col("_bits").bitwiseAND(one("doc_id")) != 0)
    rows = rows.select("doc_id", "text").join(known.hint("shuffle_hash"), "doc_id")
    held = (F.pmod(F.xxhash64("text", F.lit(1)), F.lit(5)) == 0).alias("hold")
    return rows.select("text", "toxic", held, F.xxhash64("doc_id", F.lit(2)).alias("dice"))


_COLUMNS = [f"v{k}" for k in range(DEPTH + 1)]


def _round(rows: DataFrame, table: np.ndarray, blocks: int, epochs: int, share: float, nth: int) -> np.ndarray:
    """The mean of what ``blocks`` blocks make of ``table``, each row over the blocks that changed it."""
    shared = rows.sparkSession.sparkContext.broadcast(table)
    schema = pa.schema([("row", pa.int32())] + [(c, pa.float32()) for c in _COLUMNS])

    def work(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        block = block.sort_by([("dice", "ascending"), ("text", "ascending"), ("toxic", "ascending")])
        before = shared.value
        model, squares = _untabled(before)
        rng = np.random.default_rng([7, nth, key[0].as_py()])
        texts, real = block["text"].cast(pa.binary()).to_pylist(), block["toxic"].to_numpy().astype(np.float64)
        go_on(model, squares, texts, real, epochs, 0.08, rng, share)
        moved = _table(model, squares) - before
        changed = np.flatnonzero(moved.any(1))
        return pa.Table.from_arrays([pa.array(changed.astype(np.int32)), *[pa.array(moved[changed, k]) for k in range(DEPTH + 1)]], schema=schema)

    dealt = rows.withColumn("block", F.pmod(F.col("dice"), F.lit(blocks)))
    parts = dealt.groupBy("block").applyInArrow(work, "row int, " + ", ".join(f"{c} float" for c in _COLUMNS))
    # One row of the model each, however many blocks there are.
    got = parts.groupBy("row").agg(*[F.avg(c).cast("float").alias(c) for c in _COLUMNS]).toArrow()
    shared.destroy()
    out = table.copy()
    out[got["row"].to_numpy()] += np.stack([got[c].to_numpy() for c in _COLUMNS], 1)
    return out


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """``lang, step, rows, toxic``: rows and toxic ones by predicted language and logit, in steps of 1/256."""
    shared, call = rows.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def make():
        own = shared.value
        memory = language._memory(call, own.languages) if own.languages else None

        def work(block: pa.RecordBatch) -> pa.RecordBatch:
            texts = block.column("text").cast(pa.binary()).to_pylist()
            langs = language.decide(own.languages, texts, memory)[0] if own.languages else [""] * len(texts)
            steps = np.floor(np.clip(logits(own, texts), -_MOST, _MOST) * _STEPS).astype(np.int64)
            schema = pa.schema([("lang", pa.string()), ("step", pa.int64()), ("toxic", pa.int32())])
            return record(schema, [langs, steps, block.column("toxic")])

        return work

    scored = map_blocks(rows.select("text", "toxic"), make, "lang string, step long, toxic int")
    return scored.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("rows"), F.sum("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, languages: language.Filters | None = None) -> Model:
    """A calibrated model from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, toxic``), all of their rows.

    Rows that :func:`labelled` holds back calibrate and the rest train.  The driver sees the weights and counts of scores,
    never a row.  Without labels, or with labels of one kind, every text gets the score of an untrained or one-sided network.
    """
    rows = cut(labelled(docs, labels), "labelled")
    n, toxic = rows.where("NOT hold").agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    table = _table(*begun(np.random.default_rng(7)))
    if n:
        for nth in range(ROUNDS):
            table = _round(rows.where("NOT hold"), table, -(-n // BLOCK_ROWS), 2 if n <= FEW_ROWS else 1, toxic / n, nth)
    model, _ = _untabled(table)
    model.languages = languages
    got = _scored(rows.where("hold"), model).toArrow().sort_by([("lang", "ascending"), ("step", "ascending")])
    if len(got):
        steps = (got["step"].to_numpy() + 0.5) / _STEPS
        model.thresholds = calibrate(steps, got["toxic"].to_numpy().astype(np.float64), got["lang"].to_pylist(), got["rows"].to_numpy().astype(np.float64))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted, lang_pred`` of every row, from its whole text alone.

    The score is the logistic of the logit less its language's threshold, so 0.5 is the cut in
    every language.  Null and empty texts get the score of a text without words.  Repeated
    rows are scored each, null ids stay null, an empty table gives no rows.
    """
    rows = id_and_text(docs, id_col, text_col)
    kind, call = rows.schema["doc_id"].dataType.simpleString(), uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        memory = language._memory(call, own.languages) if own.languages else None

        def work(block: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(block)
            langs = language.decide(own.languages, texts, memory)[0] if own.languages else ["und"] * len(texts)
            cut = np.array([own.thresholds.get(x, own.thresholds.get("", 0.0)) for x in langs])
            values = 1 / (1 + np.exp(-np.clip(logits(own, texts) - cut, -30, 30)))
            ids = block.column("doc_id")
            schema = pa.schema([("doc_id", ids.type), ("score", pa.float64()), ("predicted", pa.int32()), ("lang_pred", pa.string())])
            return record(schema, [ids, values, (values >= 0.5).astype(np.int32), langs])

        return work

    return map_blocks(rows, make, f"doc_id {kind}, score double, predicted int, lang_pred string")
