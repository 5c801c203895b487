"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Each word class has a fixed sparse random index vector. A word's vector is the sum of the index
vectors of its neighbours over all documents (random indexing). A document is the mean of its words' vectors and
the mean of its words' shapes (capitals, length, punctuation, line ends, repetition). A network with one
hidden layer turns that into a probability; its temperature is fitted on rows it was not trained on.

The word vectors are gathered from every document: each task adds its texts up in one matrix of fixed size, and the
matrices are added block by block. The network is fitted on a bounded sample: at most ``SAMPLE_ROWS`` labelled rows of
each class, those with the smallest hash of their id. The classes' sizes in all labels correct the sample's. Labels,
languages, sources and ids are no inputs. Null and empty texts have no words and score by the zero
vector; very long ones are read in stretches. Columns other than the named ones are not read, whatever their names. With labels of one class only that class' share is the score; without any it is one half.
Repeated labels count once (the lower one), repeated documents are all scored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweave.llm.words import byte_classes, slices, tokenize

SAMPLE_ROWS = 2000  # of each class
SAMPLE_PARTS = 8
SUM_BLOCKS = 32  # parts of the matrix of sums, added apart from each other
WORDS = 1 << 14  # word classes, by hash
SHAPES = 48
DIM = 48
REACH = 2  # neighbours on each side
HIDDEN = 32
SEED = 7
_CLASSES = byte_classes(
    word=bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]),
    mark=bytes([*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]),
    line=b"\n",
)
_LENGTHS = np.array([2, 4, 7, 11])


class Model(NamedTuple):
    words: np.ndarray  # word vectors
    shapes: np.ndarray  # shape vectors
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    prior: float  # log odds of all labels less those of the sample


@cache
def index_vectors() -> np.ndarray:
    """Sparse vectors with two +1 and two -1 for every word class and shape."""
    draw = np.random.default_rng(SEED)
    vectors = np.zeros((WORDS + SHAPES, DIM), np.float32)
    places = np.argsort(draw.random(vectors.shape), axis=1)[:, :4]
    np.put_along_axis(vectors, places, np.array([[1, 1, -1, -1]], np.float32), axis=1)
    return vectors


def _read(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the text, word class, shape) of the tokens, a stretch at a time."""
    for doc, t in tokenize([(x or "").encode() for x in texts], _CLASSES):
        kind = _CLASSES[t.raw[t.starts]]
        capitals = np.concatenate(([0], np.cumsum((t.raw >= 65) & (t.raw <= 90))))
        capitals = np.minimum(capitals[t.ends] - capitals[t.starts], 2)
        length = np.searchsorted(_LENGTHS, t.ends - t.starts, side="right")
        repeated = np.concatenate((np.zeros(min(1, len(doc)), bool), (t.hashes[1:] == t.hashes[:-1]) & (doc[1:] == doc[:-1])))
        shape = np.where(kind == 1, capitals * 5 + length, np.where(kind == 2, 15 + length, 20 + (length > 0)))
        yield doc, (t.hashes % np.uint64(WORDS)).astype(np.int64), shape + 22 * repeated


def context_sums(texts: list[str | None]) -> np.ndarray:
    """Sums of the neighbours' index vectors for every word class and shape."""
    index, sums = index_vectors(), np.zeros((WORDS + SHAPES, DIM), np.float32)
    for doc, word, shape in _read(texts):
        own = index[word] + index[WORDS + shape]
        around = np.zeros_like(own)
        for step in range(1, REACH + 1):
            same = (doc[step:] == doc[:-step])[:, None]
            around[step:] += own[:-step] * same
            around[:-step] += own[step:] * same
        for key in (word, WORDS + shape):
            order = np.argsort(key, kind="stable")
            begins = np.flatnonzero(np.diff(key[order], prepend=-1))
            if len(begins):
                sums[key[order][begins]] += np.add.reduceat(around[order], begins, axis=0)
    return sums


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)


def pooled(texts: list[str | None], words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Mean word vector and mean shape vector of each text."""
    sums, n = np.zeros((len(texts), words.shape[1] + shapes.shape[1])), np.zeros(len(texts))
    for doc, word, shape in _read(texts):
        if not len(doc):
            continue
        begins = np.flatnonzero(np.diff(doc, prepend=-1))
        at = doc[begins]
        sums[at, : words.shape[1]] += np.add.reduceat(words[word], begins, axis=0)
        counts = np.bincount((doc - doc[0]) * SHAPES + shape, minlength=(doc[-1] - doc[0] + 1) * SHAPES)
        sums[at, words.shape[1] :] += counts.reshape(-1, SHAPES)[at - doc[0]] @ shapes
        n[at] += np.diff(np.append(begins, len(doc)))
    return sums / np.maximum(n, 1)[:, None]


def _logits(x: np.ndarray, m: Model) -> np.ndarray:
    hidden = np.tanh((x - m.mean) / m.scale @ m.w1 + m.b1)
    return hidden @ m.w2 + m.b2


def train(x: np.ndarray, y: np.ndarray, prior: float, words: np.ndarray, shapes: np.ndarray, epochs: int = 150) -> Model:
    """Adam on four fifths of the rows, temperature on the rest."""
    draw = np.random.default_rng(SEED)
    held = np.arange(len(y)) % 5 == 0
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z, target = ((x - mean) / scale)[~held], y[~held].astype(float)
    weights = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        for rows in np.array_split(draw.permutation(len(z)), max(1, len(z) // 128)):
            step += 1
            hidden = np.tanh(z[rows] @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -30, 30))) - target[rows]) / max(1, len(rows))
            back = np.outer(error, weights[2]) * (1 - hidden**2)
            slopes = [z[rows].T @ back + 1e-3 * weights[0], back.sum(axis=0), hidden.T @ error + 1e-3 * weights[2], error.sum(keepdims=True)]
            for i, slope in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * slope**2
                weights[i] = weights[i] - 0.01 * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    model = Model(words, shapes, mean, scale, weights[0], weights[1], weights[2], float(weights[3][0]), 1.0, prior)
    logits, truth = _logits(x[held], model), y[held]
    options = np.geomspace(0.25, 8, 41)
    losses = [np.logaddexp(0, np.where(truth == 1, -1, 1) * logits / t).mean() for t in options]
    return model._replace(temperature=float(options[int(np.argmin(losses))]))


def predict(texts: list[str | None], model: Model | float) -> np.ndarray:
    """Probability of label 1."""
    if isinstance(model, float):
        return np.full(len(texts), model)
    logits = _logits(pooled(texts, model.words, model.shapes), model) / model.temperature + model.prior
    return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit vectors of all word classes and shapes, from the neighbours in all documents."""

    def add_texts(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total = np.zeros((WORDS + SHAPES, DIM))
        for batch in batches:
            for part in slices(batch.column(0)):
                total += context_sums(part)
        parts = [x.tobytes() for x in np.array_split(total, SUM_BLOCKS)]
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(SUM_BLOCKS), pa.int32()), "sums": pa.array(parts, pa.binary())})

    def add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.frombuffer(sums.as_py())
                totals[block] = totals[block] + found if block in totals else found
        if totals:
            columns = {"block": pa.array(list(totals), pa.int32()), "sums": pa.array([x.tobytes() for x in totals.values()], pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)

    # a matrix for each core rather than for each file split, as that is what travels
    read = docs.select(F.col(text_col).alias("text")).coalesce(docs.sparkSession.sparkContext.defaultParallelism)
    added = read.mapInArrow(add_texts, "block int, sums binary").repartition(SAMPLE_PARTS, "block")
    found = added.mapInArrow(add_blocks, "block int, sums binary").toPandas().sort_values("block")  # one matrix
    if not len(found):
        return np.zeros((WORDS + SHAPES, DIM), np.float32)
    return _unit(np.concatenate([np.frombuffer(x).reshape(-1, DIM) for x in found["sums"]])).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model | float:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    totals = {row["label"]: row["n"] for row in known.groupBy("label").agg(F.count("*").alias("n")).take(2)}
    if len(totals) < 2:
        return float(next(iter(totals))) if totals else 0.5
    # a first cut by another hash, four times as large, so that the sort stays small on any number of labels
    share = {c: int(min(1.0, 4 * sample_rows / n) * (1 << 20)) + 1 for c, n in totals.items()}
    first = [known.where((F.col("label") == c) & (F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1 << 20)) < share[c])) for c in (0, 1)]
    ranked = [rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows) for rows in first]
    ids = ranked[0].unionByName(ranked[1])
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # at most 2 x sample_rows ids, so they may be broadcast; copies of one id are ordered by hash
    rows = read.join(F.broadcast(ids), "id").withColumn("hash", F.xxhash64("text")).dropDuplicates(["id"])
    rows = rows.coalesce(SAMPLE_PARTS).sortWithinPartitions("id")

    vectors = word_vectors(docs, text_col)
    words, shapes = vectors[:WORDS], _unit(vectors[WORDS:]) + index_vectors()[WORDS:]
    parts = spark.sparkContext.broadcast((words, shapes))

    @F.arrow_udf("array<double>")
    def pool(texts: pa.Array) -> pa.Array:
        return pa.array(list(pooled(texts.to_pylist(), *parts.value)), pa.list_(pa.float64()))

    sample = rows.select("id", "label", pool("text").alias("x")).toPandas().sort_values("id")  # bounded by the sample
    y = sample["label"].to_numpy()
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 0.5
    order = np.random.default_rng(SEED).permutation(len(y))
    x, y = np.stack(sample["x"].to_numpy())[order], y[order]
    prior = np.log(totals[1] / totals[0]) - np.log((y == 1).sum() / (y == 0).sum())
    return train(x, y, float(prior), words, shapes)


def score_udf(docs: DataFrame, model: Model | float):
    """text -> probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        found = [predict(part, shared.value) for part in slices(texts)]
        return pa.array(np.concatenate([np.empty(0), *found]), pa.float64())

    return score


def score_documents(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    score = score_udf(docs, fit(docs, labels, label_col, id_col, text_col, **options))
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score(F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Documents that score one half or more, columns as they are."""
    score = score_udf(docs, fit(docs, labels, label_col, id_col, text_col, **options))
    return docs.where(score(F.col(text_col)) >= 0.5)
