"""Language identification: sparse multinomial regression on TF-IDF character n-grams.

Document frequencies cover every learnable row. Weights are trained with
follow-the-regularised-leader (proximal, elastic net) on a hash-chosen sample of
about `PER_CLASS` distinct labelled texts per language; a fifth of it sets the
temperature. Every language is learned; weights are held for the n-grams that the
sample holds, so a model has as many rows as those and as many columns as languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from fieldtally.llm.batches import pieces, small_batches
from fieldtally.llm.calibration import fit_temperature, softmax

FEATURE_BITS = 17
FEATURES = 1 << FEATURE_BITS
ORDERS = (1, 2, 3)
PER_CLASS = 2000  # bound of the training sample, distinct texts per language
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.1
SCALE = 50.0  # n-gram shares are multiplied by it, so that steps are of usual size
PIECE = 512 << 10
UNKNOWN = "und"
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _TABLE:
        _TABLE.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _TABLE[0]


def ngram_features(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Feature of each n-gram by order, start of each text among them, and whether a text has letters.

    Texts are lower-cased, anything but letters becomes a blank, and each text is
    framed by blanks; n-grams never cross texts (those places hold FEATURES).
    """
    framed = [f" {t.lower()} \0" if t else " \0" for t in texts]
    starts = np.cumsum([0, *map(len, framed[:-1])])
    points = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    symbols = np.where(letter, points, np.uint32(32))
    symbols[np.append(starts[1:], len(points)) - 1] = 0
    has_letters = np.logical_or.reduceat(letter, starts)
    out, mixed, crossing = [], np.zeros(len(symbols), np.uint32), symbols == 0
    for order in range(1, max(ORDERS) + 1):
        shifted = np.zeros_like(symbols)
        shifted[: len(symbols) - order + 1] = symbols[order - 1 :]
        mixed = (mixed + shifted) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        crossing = crossing | (shifted == 0)
        if order in ORDERS:
            feature = ((mixed * np.uint32(0x85EBCA77 + 2 * order)) >> np.uint32(32 - FEATURE_BITS)).astype(np.int32)
            out.append(np.where(crossing, np.int32(FEATURES), feature))
    return out, starts, has_letters


@dataclass
class Model:
    classes: list[str]
    place: np.ndarray  # (FEATURES + 1): row of each feature in `table`, the zero row if it was never learned
    table: np.ndarray  # (learned features + 1, classes): idf times weight; the last row is zero
    bias: np.ndarray
    temperature: float


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Texts that hold each feature, and the number of texts; at most FEATURES + 1 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(FEATURES + 2, np.int64), np.zeros(FEATURES + 1, bool)
        part = np.zeros(FEATURES + 1, np.uint16)
        waiting = 0
        for batch in batches:
            for piece in pieces(batch, limit=PIECE):
                features, starts, _ = ngram_features(piece.column("text").to_pylist())
                stops = np.append(starts[1:], len(features[0]))
                for a, b in zip(starts, stops):
                    seen[:] = False
                    for f in features:
                        seen[f[a:b]] = True
                    part += seen
                    waiting += 1
                    if waiting == 65_535:
                        total[:-1] += part
                        total[-1] += waiting
                        part[:], waiting = 0, 0
        total[:-1] += part
        total[-1] += waiting
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["feature", "n"])

    rows = small_batches(docs.select("text")).mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(FEATURES + 2, np.int64)
    counts[rows["feature"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts[:FEATURES], int(counts[-1])


def _vectors(texts: list[str | None], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    features, starts, _ = ngram_features(texts)
    stops, out = np.append(starts[1:], len(features[0])), []
    for a, b in zip(starts, stops):
        every = np.concatenate([f[a:b] for f in features])
        ids, counts = np.unique(every[every < FEATURES], return_counts=True)
        out.append((ids, (counts / max(1, counts.sum()) * SCALE * idf[ids])))
    return out


def train(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_classes: int, n_features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with elastic net over sparse rows; returns weights and bias."""
    z = np.zeros((n_features + 1, n_classes))
    n = np.zeros_like(z)

    def weights(ids: np.ndarray) -> np.ndarray:
        zi = z[ids]
        shrunk = np.sign(zi) * L1 - zi
        return np.where(np.abs(zi) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n[ids])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in order.permutation(len(vectors)):
            ids, x = np.append(vectors[k][0], n_features), np.append(vectors[k][1], 1.0)
            w = weights(ids)
            error = softmax((x @ w)[None])[0]
            error[labels[k]] -= 1
            g = x[:, None] * error
            step = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / ALPHA
            z[ids] += g - step * w
            n[ids] += g * g
    every = weights(np.arange(n_features + 1))
    return every[:-1], every[-1]


def fit(docs: DataFrame, *, learnable: Column, per_class: int = PER_CLASS) -> Model:
    """Learn languages from `text` and non-null `lang` of the rows where `learnable` holds (null: not).

    The sample is chosen by a hash of the text, so it does not depend on partitions; rows
    that repeat a text of one language enter once, so copies cannot swell it. All languages
    are learned, however rare.
    """
    rows = docs.where(learnable).where("text is not null and lang is not null").select("text", "lang", F.xxhash64("text", F.lit("sample")).alias("hash"))
    counts = sorted(rows.groupBy("lang").agg(F.count_distinct("hash").alias("texts")).collect())
    classes = [r["lang"] for r in counts]
    if not classes:
        return Model([], np.zeros(FEATURES + 1, np.int32), np.zeros((1, 0), np.float32), np.zeros(0), 1.0)
    frequencies, total = document_frequencies(rows)
    idf = np.log((1 + total) / (1 + frequencies)) + 1
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], per_class / r["texts"])])
    chosen = F.pmod("hash", F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(chosen < shares[F.col("lang")]).groupBy("lang", "hash").agg(F.min("text").alias("text"))
    index, shared_idf = {c: i for i, c in enumerate(classes)}, docs.sparkSession.sparkContext.broadcast(idf)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((t, c) for b in batches for t, c in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()))
        vectors = [v for i in range(0, len(rows), 256) for v in _vectors([t for t, _ in rows[i : i + 256]], shared_idf.value)]
        seen = np.unique(np.concatenate([np.zeros(0, np.int32), *[ids for ids, _ in vectors]]))
        vectors = [(np.searchsorted(seen, ids), x) for ids, x in vectors]
        labels = np.array([index[c] for _, c in rows], np.int64)
        check = np.arange(len(rows)) % 5 == 0 if len(rows) >= 10 * len(classes) else np.zeros(len(rows), bool)
        weights, bias = train([v for v, c in zip(vectors, check) if not c], labels[~check], len(classes), len(seen))
        logits = np.array([x @ weights[ids] + bias for (ids, x), c in zip(vectors, check) if c]).reshape(-1, len(classes))
        temperature = fit_temperature(logits, labels[check])
        yield _rows_of(np.array([FEATURES, FEATURES + 1]), np.vstack([bias, np.full(len(classes), temperature)]))
        used = np.flatnonzero(weights.any(axis=1))
        for i in range(0, len(used), 4096):
            part = used[i : i + 4096]
            yield _rows_of(seen[part], weights[part] * shared_idf.value[seen[part], None] * SCALE)

    learned = sample.select("text", "lang").repartition(1).mapInArrow(learn, "feature long, w binary").toPandas()
    features = learned["feature"].to_numpy(np.int64)
    state = np.frombuffer(b"".join(learned["w"]), "<f8").reshape(len(features), len(classes))
    held, place = features < FEATURES, np.full(FEATURES + 1, (features < FEATURES).sum(), np.int32)
    place[features[held]] = np.arange(held.sum())
    table = np.vstack([state[held], np.zeros(len(classes))]).astype(np.float32)
    return Model(classes, place, table, state[features == FEATURES][0], float(state[features == FEATURES + 1][0, 0]))


def _rows_of(features: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(features.astype(np.int64)), pa.array([w.astype("<f8").tobytes() for w in weights], pa.binary())], names=["feature", "w"]
    )


def predict(docs: DataFrame, model: Model, *, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of `docs`, `label` and `score` (calibrated probability of the predicted language).

    Texts that are null or hold no letter get `und` and score 0, as does everything where
    nothing could be learned. Existing columns of those two names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(label, score)
    schema = StructType([*kept.schema.fields, StructField(label, StringType()), StructField(score, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.classes, UNKNOWN], object)
        for batch in batches:
            for piece in pieces(batch, limit=PIECE):
                features, starts, letters = ngram_features(piece.column("text").to_pylist())
                if m.classes:
                    sums = sum(np.add.reduceat(m.table[m.place[f]], starts, axis=0, dtype=np.float64) for f in features)
                    counts = sum(np.add.reduceat(f < FEATURES, starts, dtype=np.int64) for f in features)
                    chances = softmax((sums / np.maximum(1, counts)[:, None] + m.bias) / m.temperature)
                    best = chances.argmax(axis=1)
                    sure = np.where(letters, chances.max(axis=1), 0.0)
                    named = names[np.where(letters, best, len(m.classes))]
                else:
                    sure, named = np.zeros(piece.num_rows), np.full(piece.num_rows, UNKNOWN, object)
                out = [*piece.columns, pa.array(named, pa.string()), pa.array(sure)]
                yield pa.RecordBatch.from_arrays(out, names=[*piece.schema.names, label, score])

    return small_batches(kept).mapInArrow(run, schema)


def held_out(modulus: int, remainder: int) -> Column:
    """Rows kept from learning: crc32 of the doc_id as text; a null doc_id is not held out, but not learned from either."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == remainder


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, learned from the rows that are not held out.

    Null doc_ids are predicted with held_out false. Extra columns are ignored, repeated rows
    repeat, no rows give none.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = fit(own, learnable=~held_out(4, 2))
    rows = predict(own.select("doc_id", "text"), model)
    return rows.select("doc_id", F.coalesce(held_out(4, 2), F.lit(False)).alias("held_out"), "lang_pred", "score")
