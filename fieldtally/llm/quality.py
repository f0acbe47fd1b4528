"""Quality scores from random-indexing word vectors and a small numpy network.

Every word has a sparse random index vector; its context vector is the sum of its
neighbours' index vectors over all texts. Words are hashed to `VOCABULARY` rows.
A document pools its words' vectors (mean and spread), and a two-layer network
with temperature-calibrated output scores the pool.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fieldtally.llm.batches import Words, mix, pieces, small_batches
from fieldtally.llm.calibration import fit_temperature, softmax
from fieldtally.llm.langid import held_out
from fieldtally.operators.lineage import cut

VOCABULARY = 1 << 15
DIMENSIONS = 48
SEEDS = 2  # non-zero places of an index vector
REACH = 2  # neighbours on each side
SAMPLE = 20_000  # bound of the training sample
HIDDEN = 32
EPOCHS = 60
RATE = 0.004
STRIPE = 256  # vocabulary rows summed together
FLUSH_WORDS = 1 << 27  # a task hands on its 32-bit sums before they could overflow; sums of tasks are 64-bit


def word_rows(words: Words) -> np.ndarray:
    return (words.hashes() & np.uint64(VOCABULARY - 1)).astype(np.int64)


def index_places() -> tuple[np.ndarray, np.ndarray]:
    """Non-zero dimensions and signs of each word's index vector."""
    draws = mix(np.arange(1, VOCABULARY * SEEDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(VOCABULARY, SEEDS)
    return (draws % np.uint64(DIMENSIONS)).astype(np.int64), np.where(draws >> np.uint64(63), 1, -1)


def context_counts(words: Words) -> np.ndarray:
    """(VOCABULARY, DIMENSIONS) sums of the index vectors around each word; neighbours lie in the same text."""
    rows, owner = word_rows(words), words.owners()
    dims, signs = index_places()
    total = np.zeros(VOCABULARY * DIMENSIONS, np.int64)
    for distance in range(1, REACH + 1):
        near = owner[distance:] == owner[:-distance] if len(owner) > distance else np.zeros(0, bool)
        left, right = rows[:-distance][near], rows[distance:][near]
        for a, b in ((left, right), (right, left)):
            for s in range(SEEDS):
                cells = a * DIMENSIONS + dims[b, s]
                positive = signs[b, s] > 0
                total += np.bincount(cells[positive], minlength=len(total)) - np.bincount(cells[~positive], minlength=len(total))
    return total.reshape(VOCABULARY, DIMENSIONS)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Context vectors over all texts, scaled to unit length; the driver gets VOCABULARY rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n_words = np.zeros((VOCABULARY, DIMENSIONS), np.int32), 0
        for batch in batches:
            for piece in pieces(batch):
                words = Words.of(piece.column("text"))
                if n_words + len(words.starts) > FLUSH_WORDS:
                    yield stripes_of(total)
                    total[:], n_words = 0, 0
                total += context_counts(words).astype(np.int32)
                n_words += len(words.starts)
        yield stripes_of(total)

    def stripes_of(total: np.ndarray) -> pa.RecordBatch:
        stripes = total.reshape(-1, STRIPE * DIMENSIONS)
        held = np.flatnonzero(stripes.any(axis=1))
        return pa.RecordBatch.from_arrays(
            [pa.array(held), pa.array([stripes[k].astype("<i4").tobytes() for k in held], pa.binary())], names=["stripe", "sums"]
        )

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(STRIPE * DIMENSIONS, np.float64)
        for part in table.column("sums"):
            total += np.frombuffer(part.as_buffer(), "<i8")
        return pa.table({"stripe": table.column("stripe")[:1], "sums": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    parts = small_batches(docs.select("text")).mapInArrow(run, "stripe long, sums binary")
    # a task's part is one row a stripe, so two rounds keep any group small
    parts = parts.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(64)))
    first = parts.groupBy("stripe", "_part").applyInArrow(_add_integers, "stripe long, sums binary")
    rows = first.groupBy("stripe").applyInArrow(add, "stripe long, sums binary").toPandas()
    vectors = np.zeros((VOCABULARY // STRIPE, STRIPE * DIMENSIONS), np.float32)
    for stripe, sums in zip(rows["stripe"], rows["sums"]):
        vectors[stripe] = np.frombuffer(sums, "<f4")
    vectors = vectors.reshape(VOCABULARY, DIMENSIONS)
    return vectors / np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))


def _add_integers(table: pa.Table) -> pa.Table:
    total = np.zeros(STRIPE * DIMENSIONS, np.int64)
    for part in table.column("sums"):
        total += np.frombuffer(part.as_buffer(), "<i4")
    return pa.table({"stripe": table.column("stripe")[:1], "sums": pa.array([total.astype("<i8").tobytes()], pa.binary())})


def pooled(words: Words, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text, and its logarithmic length; zeros without words."""
    rows, counts = word_rows(words), words.counts
    out = np.zeros((len(counts), 2 * DIMENSIONS + 1))
    full = np.flatnonzero(counts)
    if len(full):
        starts = words.first[full]
        each = vectors[rows]
        mean = np.add.reduceat(each, starts, axis=0, dtype=np.float64) / counts[full, None]
        square = np.add.reduceat(each * each, starts, axis=0, dtype=np.float64) / counts[full, None]
        out[full, :DIMENSIONS], out[full, DIMENSIONS:-1] = mean, np.sqrt(np.maximum(0, square - mean**2))
    out[:, -1] = np.log1p(counts)
    return out


@dataclass
class Model:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]
    temperature: float

    def logits(self, pools: np.ndarray) -> np.ndarray:
        hidden = np.tanh((pools - self.centre) / self.scale @ self.layers[0][0] + self.layers[0][1])
        return hidden @ self.layers[1][0] + self.layers[1][1]

    def scores(self, pools: np.ndarray) -> np.ndarray:
        return softmax(self.logits(pools) / self.temperature)[:, 1]


def train(pools: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Model:
    """Adam on cross-entropy; every fifth row sets the temperature only."""
    draw = np.random.default_rng(11)
    centre, scale = (pools.mean(axis=0), pools.std(axis=0) + 1e-6) if len(pools) else (np.zeros(2 * DIMENSIONS + 1), np.ones(2 * DIMENSIONS + 1))
    weights = [draw.normal(0, 1 / np.sqrt(pools.shape[1]), (pools.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 2)), np.zeros(2)]
    check = np.arange(len(pools)) % 5 == 0 if len(pools) >= 50 else np.zeros(len(pools), bool)
    x, y = ((pools - centre) / scale)[~check], labels[~check]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    step = 0
    for _ in range(EPOCHS if len(x) else 0):
        order = draw.permutation(len(x))
        for begin in range(0, len(x), 128):
            rows = order[begin : begin + 128]
            hidden = np.tanh(x[rows] @ weights[0] + weights[1])
            error = softmax(hidden @ weights[2] + weights[3])
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            back = (error @ weights[2].T) * (1 - hidden**2)
            step += 1
            for w, m, g in zip(weights, moments, (x[rows].T @ back + 1e-4 * weights[0], back.sum(axis=0), hidden.T @ error + 1e-4 * weights[2], error.sum(axis=0))):
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.001 * (g * g - m[1])
                w -= RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    model = Model(vectors, centre, scale, [(weights[0], weights[1]), (weights[2], weights[3])], 1.0)
    model.temperature = fit_temperature(model.logits(pools[check]), labels[check])
    return model


def fit(docs: DataFrame, labels: DataFrame, *, learnable: Column, sample: int = SAMPLE) -> Model:
    """Word vectors from every text of `docs`; the network from about `sample` labelled rows, chosen by a hash of the text.

    A doc_id with several labels learns the rounded mean; null labels are ignored. Without
    labels the network is left at its random start.
    """
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("q"))
    marks = cut(marks.where(learnable).select("doc_id", (F.col("q") >= 0.5).cast("long").alias("label")))
    share = sample / max(1, marks.count())
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    rows = docs.select("doc_id", "text").join(marks.where(place < share), "doc_id").select("text", "label")

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                found = pooled(Words.of(piece.column("text")), shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.list_(pa.float64())), piece.column("label")], names=["pool", "label"])

    learned = rows.mapInArrow(pool, "pool array<double>, label long").toPandas()
    pools = np.stack(learned["pool"].to_numpy()) if len(learned) else np.zeros((0, 2 * DIMENSIONS + 1))
    # an order of its own, whatever partitions the rows came from
    order = np.lexsort((*pools.T, learned["label"].to_numpy()))[np.random.default_rng(5).permutation(len(pools))]
    return train(pools[order], learned["label"].to_numpy(np.int64)[order], vectors)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` and score, the calibrated chance of label 1; a column of that name is replaced.

    Null and empty texts are scored by their empty pool.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score")
    schema = StructType([*kept.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for piece in pieces(batch, limit=512 << 10):
                found = m.scores(pooled(Words.of(piece.column("text")), m.vectors))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(found)], names=[*piece.schema.names, "score"])

    return small_batches(kept).mapInArrow(run, schema)


def assess(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`; labels of held-out rows are not looked at.

    Null doc_ids are scored, held_out false. Extra columns are ignored, repeated rows
    repeat, no rows give none.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(own, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), learnable=~held_out(5, 0))
    return score(own, model).select(
        "doc_id", F.coalesce(held_out(5, 0), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
