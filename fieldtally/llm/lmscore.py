"""Log probabilities of texts under a trigram model smoothed by deleted interpolation.

P(w | t u) mixes the maximum-likelihood estimates of order 3, 2 and a smoothed order 1. The
weights depend on the frequency of the longest context that was seen, and are learned by
expectation-maximisation: the deleted part of the learnable texts is predicted from the counts of the
rest. Scores then use the counts of all learnable texts.

Counts are exchanged, not joined row by row: texts are cut into blocks, a block asks
the shard of each of its n-grams once, together with its own counts, and the shard
answers every block with the sums. Trigrams are asked for only where both bigrams inside occur
elsewhere too; the others occur once, so their count is known.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm.batches import Words, mix, pieces, text_bytes
from fieldtally.operators.lineage import cut

BLOCK_BYTES = 8 << 20  # text of a block; a longer text is a block of its own
SHARD_KEYS = 1 << 21  # tokens whose n-grams share a shard, on average
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
START, END = np.uint64(0x5BF0A8B14577D0E3), np.uint64(0x1C69B3F74AC4AE35)
SCORED, COUNTED, DELETED = 0, 1, 2  # what a text is used for besides being scored
STEPS = 4  # cells of a factor two, in the table of held-out likelihoods
FAMILY = 64  # buckets from here on: the two-word context was seen


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int):
    """Hand at most `rows` rows at a time to Python within the block; the session's setting is put back."""
    before = spark.conf.get(BATCH_KEY)
    spark.conf.set(BATCH_KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before)


def pack(values: np.ndarray) -> bytes:
    """Counts, one byte each; from 255 on, in full behind. Most are small, so the bytes are deflated."""
    small = np.minimum(values, 255).astype(np.uint8)
    return zlib.compress(small.tobytes() + values[values >= 255].astype("<i8").tobytes(), 1)


def unpack(data: bytes, n: int) -> np.ndarray:
    data = zlib.decompress(data)
    values = np.frombuffer(data, np.uint8, n).astype(np.int64)
    values[values == 255] = np.frombuffer(data, "<i8", offset=n)
    return values


def pack_numbers(values: np.ndarray) -> bytes:
    """Small numbers, two bytes each, high bytes apart; from 65,535 on, in full behind. Deflated."""
    small = np.minimum(values, 65_535).astype("<u2").view(np.uint8).reshape(-1, 2).T
    return zlib.compress(small.tobytes() + values[values >= 65_535].astype("<i4").tobytes(), 1)


def unpack_numbers(data: bytes, n: int) -> np.ndarray:
    data = zlib.decompress(data)
    values = np.ascontiguousarray(np.frombuffer(data, np.uint8, 2 * n).reshape(2, n).T).view("<u2").reshape(-1).astype(np.int32)
    values[values == 65_535] = np.frombuffer(data, "<i4", offset=2 * n)
    return values


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, high bytes apart, so that compression finds their zeros."""
    steps = np.diff(keys, prepend=np.zeros(1, np.uint64))
    return steps.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T)
    return np.cumsum(steps.view(">u8").reshape(-1).astype(np.uint64), dtype=np.uint64)


def pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two hashes, in order."""
    return mix(left * np.uint64(0xD6E8FEB86659FD93) + right)


class Block:
    """Tokens of several texts: hashes, previous hashes and the text of each."""

    def __init__(self, vocabulary: bytes, tokens: bytes, lengths: bytes, uses: bytes):
        self.lengths, self.uses = np.frombuffer(lengths, "<i8"), np.frombuffer(uses, np.uint8)
        self.words = np.frombuffer(vocabulary, "<u8")
        self.tokens = unpack_numbers(tokens, int(self.lengths.sum()))
        self.use = np.repeat(self.uses, self.lengths)
        self.first = np.zeros(len(self.tokens), bool)
        self.first[np.cumsum(self.lengths) - self.lengths] = True

    def bigrams(self) -> np.ndarray:
        own = self.words[self.tokens]
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[self.first] = START
        return pairs(before, own)

    def trigrams(self, bigrams: np.ndarray) -> np.ndarray:
        """Hash of each place's last three tokens; first places have none."""
        out = np.zeros(len(bigrams), np.uint64)
        out[1:] = pairs(bigrams[:-1], self.words[self.tokens[1:]])
        return out

    def after(self, values: np.ndarray, at_start: int) -> np.ndarray:
        """The value of the place before, `at_start` for first places."""
        out = np.empty(len(values), values.dtype)
        out[1:] = values[:-1]
        out[self.first] = at_start
        return out


def make_blocks(docs: DataFrame) -> DataFrame:
    """Blocks (block, doc_ids, held, lengths, uses, vocabulary, tokens) of `docs` (doc_id, text, use, held)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch, limit=BLOCK_BYTES):
                data, at = text_bytes(piece.column("text"))
                capital = (data >= 65) & (data <= 90)
                words = Words(data + capital.astype(np.uint8) * np.uint8(32), at)
                counts = words.counts + 1
                every = np.full(int(counts.sum()), END)
                inner = np.ones(len(every), bool)
                inner[np.cumsum(counts) - 1] = False
                every[inner] = words.hashes()
                vocabulary, tokens, frequencies = np.unique(every, return_inverse=True, return_counts=True)
                order = np.argsort(-frequencies, kind="stable")  # frequent words get small numbers
                number_of = np.empty(len(order), np.int64)
                number_of[order] = np.arange(len(order))
                vocabulary, tokens = vocabulary[order], number_of[tokens]
                number += 1
                one = {
                    "block": pa.array([number - 1]), "doc_ids": pa.array([piece.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "held": pa.array([piece.column("held").to_pylist()], pa.list_(pa.bool_())),
                    "lengths": pa.array([counts.astype("<i8").tobytes()], pa.binary()),
                    "uses": pa.array([piece.column("use").to_numpy().astype(np.uint8).tobytes()], pa.binary()),
                    "vocabulary": pa.array([vocabulary.astype("<u8").tobytes()], pa.binary()),
                    "tokens": pa.array([pack_numbers(tokens)], pa.binary()),
                    "n_tokens": pa.array([len(every)], pa.int64()),
                    "n_learned": pa.array([int(counts[piece.column("use").to_numpy() != SCORED].sum())], pa.int64()),
                }
                yield pa.RecordBatch.from_arrays(list(one.values()), names=list(one))

    schema = "block long, doc_ids array<long>, held array<boolean>, lengths binary, uses binary, vocabulary binary, tokens binary, n_tokens long, n_learned long"
    return docs.mapInArrow(run, schema)


def shard_edges(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shards that hold some of the sorted `keys`, and where each begins (and the end)."""
    shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    begins = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return shard[begins].astype(np.int64), np.append(begins, len(keys))


def _asked(kind: int, block: int, keys: np.ndarray, use: np.ndarray, shards: int) -> tuple[Iterator[tuple], np.ndarray]:
    """Requests for the distinct n-grams of a block, with its own counts by use, and each place's n-gram."""
    distinct, place = np.unique(keys, return_inverse=True)
    counts = [np.bincount(place[use == u], minlength=len(distinct)) for u in (SCORED, COUNTED, DELETED)]
    names, edges = shard_edges(distinct, shards)
    rows = (
        (int(s), kind, block, pack_keys(distinct[a:b]), *[pack(c[a:b]) for c in counts])
        for s, a, b in zip(names, edges[:-1], edges[1:])
    )
    return rows, place


REQUEST = "shard long, kind int, block long, keys binary, scored binary, counted binary, deleted binary"
REPLY = "block long, kind int, shard long, learned binary, counted binary"


def _requests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in range(7)]
    kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in REQUEST.split(", ")])


def with_recurrence(learned: np.ndarray, several: np.ndarray) -> np.ndarray:
    """One number for a learned count and whether the n-gram occurs twice or more in all texts: two counts up imply it."""
    return np.where(learned >= 2, learned + 2, 2 * learned + several)


def without_recurrence(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.where(values >= 4, values - 2, values // 2), (values >= 4) | (values % 2 == 1)


def answer(table: pa.Table) -> pa.Table:
    """Sums of one shard's counts, sent back to each block that asked; block -1 gets the shard's totals.

    What the undeleted texts counted is sent for n-grams of deleted texts only.
    """
    keys = [unpack_keys(k) for k in table.column("keys").to_pylist()]
    read = lambda c: [unpack(d, len(k)) for d, k in zip(table.column(c).to_pylist(), keys)]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    add = lambda parts: np.bincount(place, weights=np.concatenate(parts), minlength=len(distinct)).astype(np.int64)
    own = read("deleted")
    counted, scored = add(read("counted")), add(read("scored"))
    learned = counted + add(own)
    coded = with_recurrence(learned, learned + scored >= 2)
    edges = np.cumsum([0, *map(len, keys)])
    places = [place[a:b] for a, b in zip(edges[:-1], edges[1:])]
    totals = np.array([counted.sum(), learned.sum(), (counted > 0).sum(), (learned > 0).sum()], "<i8").tobytes()
    n = table.num_rows + 1
    return pa.table({
        "block": pa.array([*table.column("block").to_pylist(), -1], pa.int64()), "kind": pa.array([table.column("kind")[0].as_py()] * n, pa.int32()),
        "shard": pa.array([table.column("shard")[0].as_py()] * n, pa.int64()),
        "learned": pa.array([*[pack(coded[p]) for p in places], totals], pa.binary()),
        "counted": pa.array([*[pack(counted[p[d > 0]]) for p, d in zip(places, own)], b""], pa.binary()),
    })


def exchange(requests: DataFrame) -> DataFrame:
    return requests.groupBy("shard", "kind").applyInArrow(answer, REPLY)


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


@dataclass
class Answers:
    """What shards answered to a block's n-grams of one kind, by place; `counted` is right in deleted texts only."""

    learned: np.ndarray
    several: np.ndarray
    counted: np.ndarray | None


def _read(replies: list[dict], kind: int, keys: np.ndarray, use: np.ndarray, shards: int) -> Answers:
    distinct, place = np.unique(keys, return_inverse=True)
    _, edges = shard_edges(distinct, shards)
    own = sorted((r for r in replies or [] if r["kind"] == kind), key=lambda r: r["shard"])
    if len(own) + 1 != len(edges):
        raise RuntimeError(f"{len(own)} of {len(edges) - 1} shards answered")
    parts = [unpack(r["learned"], b - a) for r, a, b in zip(own, edges[:-1], edges[1:])]
    learned, several = without_recurrence(np.concatenate(parts) if parts else np.zeros(0, np.int64))
    counted = None
    if own and "counted" in own[0]:
        late = np.bincount(place[use == DELETED], minlength=len(distinct)) > 0
        counted = np.zeros(len(distinct), np.int64)
        parts = [unpack(r["counted"], int(late[a:b].sum())) for r, a, b in zip(own, edges[:-1], edges[1:])]
        counted[late] = np.concatenate(parts)
        counted = counted[place]
    return Answers(learned[place], several[place], counted)


def _asked_trigrams(block: Block, several: np.ndarray) -> np.ndarray:
    """Places whose trigram may occur elsewhere: both bigrams inside do."""
    asked = several & block.after(several, 0)
    asked[block.first] = False
    return asked


COUNTS = "block long, doc_ids array<long>, held array<boolean>, lengths binary, uses binary, learned array<binary>, counted array<binary>"


@dataclass
class Totals:
    """Tokens, distinct tokens and texts that counts were taken from."""

    tokens: int
    distinct: int
    texts: int

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))


def likelihoods(block: Block, one: np.ndarray, two: np.ndarray, three: np.ndarray, totals: Totals) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each place's context and the estimates of order 3, 2 and 1; the bucket is -1 where no context was seen."""
    context1 = block.after(one, totals.texts)
    context2 = block.after(two, totals.texts)
    p3 = np.divide(three, context2, out=np.zeros(len(one)), where=context2 > 0)
    p2 = np.divide(two, context1, out=np.zeros(len(one)), where=context1 > 0)
    seen = np.where(context2 > 0, context2, context1)
    bucket = np.floor(np.log2(np.maximum(seen, 1))).astype(np.int64) + np.where(context2 > 0, FAMILY, 0)
    return np.where(seen > 0, bucket, -1), p3, p2, totals.base(one)


def held_out_cells(bucket: np.ndarray, p3: np.ndarray, p2: np.ndarray, p1: np.ndarray) -> dict[tuple[int, int, int], list[float]]:
    """Places by bucket and by the size of both ratios to the lowest order: number and sums of the ratios.

    Only the ratios matter to the mixture weights; the table's size does not depend on the corpus.
    """
    seen = bucket >= 0
    r3, r2 = p3[seen] / p1[seen], p2[seen] / p1[seen]
    place = lambda r: np.where(r > 0, np.floor(STEPS * np.log2(np.maximum(r, 2.0**-60))).astype(np.int64) + 60 * STEPS, -1)
    keys = np.stack([bucket[seen], place(r3), place(r2)])
    distinct, where = np.unique(keys, axis=1, return_inverse=True)
    where = where.reshape(-1)
    sums = [np.bincount(where, weights=w, minlength=distinct.shape[1]) for w in (np.ones(len(r3)), r3, r2)]
    return {tuple(map(int, k)): [float(s[j]) for s in sums] for j, k in enumerate(distinct.T)}


def learn_weights(bucket: np.ndarray, n: np.ndarray, r3: np.ndarray, r2: np.ndarray, *, rounds: int = 500) -> np.ndarray:
    """(128, 3) mixture weights of order 3, 2 and 1 for every bucket, by expectation-maximisation.

    n, r3 and r2 are the cells' sizes and mean ratios. A bucket is learned with one token's worth of the weights pooled
    over all buckets that saw as long a context, so that buckets without held-out tokens have those.
    """

    def climb(rows: np.ndarray, groups: int, start: np.ndarray, prior: np.ndarray) -> np.ndarray:
        weights = start.copy()
        for _ in range(rounds):
            parts = weights[rows] * ratios
            parts *= (n / parts.sum(axis=1))[:, None]
            sums = np.stack([np.bincount(rows, weights=parts[:, k], minlength=groups) for k in range(3)], axis=1) + prior
            new = sums / sums.sum(axis=1, keepdims=True)
            done = np.abs(new - weights).max() < 1e-7
            weights = new
            if done:
                break
        return weights

    ratios = np.stack([r3, r2, np.ones(len(n))], axis=1)
    start = np.array([[0.0, 0.5, 0.5], [0.4, 0.3, 0.3]])
    pooled = climb((bucket >= FAMILY).astype(np.int64), 2, start, start)
    every = np.repeat(pooled, FAMILY, axis=0)
    return climb(bucket, 2 * FAMILY, every, every)


def mixed(bucket: np.ndarray, p3: np.ndarray, p2: np.ndarray, p1: np.ndarray, weights: np.ndarray) -> np.ndarray:
    w = np.vstack([weights, [0.0, 0.0, 1.0]])[bucket]  # the last line serves bucket -1
    return w[:, 0] * p3 + w[:, 1] * p2 + w[:, 2] * p1


def score_texts(docs: DataFrame, *, learnable: Column, deleted: Column, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of `docs` (doc_id, text).

    Rows where `learnable` holds are learned from; those where `deleted` holds too are predicted from the others to set the mixture
    weights. Scores are log10 probabilities. Null texts are empty: one end token. Repeated rows repeat and count each time;
    null doc_ids are scored, never learned. Extra columns are ignored, an empty table gives no rows. A text of any length is one
    block at least; it is never cut.
    """
    spark = docs.sparkSession
    use = F.when(F.coalesce(learnable, F.lit(False)), F.when(F.coalesce(deleted, F.lit(False)), DELETED).otherwise(COUNTED)).otherwise(SCORED)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", use.alias("use"), F.coalesce(held_out, F.lit(False)).alias("held"))
    with rows_per_batch(spark, 2000):
        blocks = cut(make_blocks(own))
    n_tokens, n_learned = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_learned"), F.lit(0))).first()
    texts = {r["use"]: r["n"] for r in own.groupBy("use").agg(F.count(F.lit(1)).alias("n")).collect()}
    shards = max(1, n_tokens // SHARD_KEYS)

    def ask_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _block_rows(batches):
            block = Block(row["vocabulary"], row["tokens"], row["lengths"], row["uses"])
            for kind, keys in ((1, block.words[block.tokens]), (2, block.bigrams())):
                rows, _ = _asked(kind, row["block"], keys, block.use, shards)
                yield _requests(list(rows))

    def ask_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _block_rows(batches):
            block = Block(row["vocabulary"], row["tokens"], row["lengths"], row["uses"])
            bigrams = block.bigrams()
            asked = _asked_trigrams(block, _read(row["replies"], 2, bigrams, block.use, shards).several)
            rows, _ = _asked(3, row["block"], block.trigrams(bigrams)[asked], block.use[asked], shards)
            yield _requests(list(rows))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _block_rows(batches):
            block = Block(row["vocabulary"], row["tokens"], row["lengths"], row["uses"])
            bigrams = block.bigrams()
            one = _read(row["replies"], 1, block.words[block.tokens], block.use, shards)
            two = _read(row["replies"], 2, bigrams, block.use, shards)
            asked = _asked_trigrams(block, two.several)
            three = _read(row["replies"], 3, block.trigrams(bigrams)[asked], block.use[asked], shards)
            out = {}
            for name, alone in (("learned", block.use != SCORED), ("counted", block.use == COUNTED)):
                long = alone.astype(np.int64)  # a trigram that was not asked for occurs here alone
                if asked.any():
                    long[asked] = getattr(three, name)
                short = getattr(two, name)
                long[block.first] = short[block.first]
                out[name] = [getattr(one, name), short, long]
            late = block.use == DELETED
            columns = [
                pa.array([row["block"]]), pa.array([row["doc_ids"]], pa.list_(pa.int64())), pa.array([row["held"]], pa.list_(pa.bool_())),
                pa.array([row["lengths"]], pa.binary()), pa.array([row["uses"]], pa.binary()),
                pa.array([[pack(v) for v in out["learned"]]], pa.list_(pa.binary())), pa.array([[pack(v[late]) for v in out["counted"]]], pa.list_(pa.binary())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in COUNTS.split(", ")])

    tokens = ["block", "lengths", "uses", "vocabulary", "tokens"]

    def by_block(blocks: DataFrame, replies: DataFrame, *names: str) -> DataFrame:
        inner = F.struct("kind", "shard", *names)
        return blocks.join(replies.where("block >= 0").groupBy("block").agg(F.collect_list(inner).alias("replies")), "block", "left")

    with rows_per_batch(spark, 2):
        short = cut(exchange(blocks.select(*tokens).mapInArrow(ask_short, REQUEST)))
        joined = by_block(blocks.select(*tokens), short.where("kind = 2"), "learned")
        long = cut(exchange(joined.mapInArrow(ask_long, REQUEST)))
        joined = by_block(blocks.select(*tokens, "doc_ids", "held"), short.unionByName(long), "learned", "counted")
        counts = cut(joined.mapInArrow(gather, COUNTS))
    sums = np.zeros(4, np.int64)
    for r in short.where("block < 0 and kind = 1").select("learned").toLocalIterator():  # one line a shard
        sums += np.frombuffer(r["learned"], "<i8")
    rest = Totals(int(sums[0]), int(sums[2]), texts.get(COUNTED, 0))
    learned = Totals(int(sums[1]), int(sums[3]), texts.get(COUNTED, 0) + texts.get(DELETED, 0))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], list[float]] = {}
        for row in _block_rows(batches):
            uses, lengths = np.frombuffer(row["uses"], np.uint8), np.frombuffer(row["lengths"], "<i8")
            late = lengths[uses == DELETED]
            n = int(late.sum())
            if n:
                part = Block(b"", pack_numbers(np.zeros(n, np.int64)), late.tobytes(), uses[uses == DELETED].tobytes())
                found = held_out_cells(*likelihoods(part, *[unpack(d, n) for d in row["counted"]], rest))
                for key, values in found.items():
                    kept = total.setdefault(key, [0.0, 0.0, 0.0])
                    for k in range(3):
                        kept[k] += values[k]
        keys = list(zip(*total)) if total else [[], [], []]
        sums = list(zip(*total.values())) if total else [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(list(k), pa.int64()) for k in keys], *[pa.array(list(s), pa.float64()) for s in sums]], names=["bucket", "c3", "c2", "n", "r3", "r2"]
        )

    with rows_per_batch(spark, 2):
        held = counts.select("lengths", "uses", "counted").mapInArrow(cells, "bucket long, c3 long, c2 long, n double, r3 double, r2 double")
        table = held.groupBy("bucket", "c3", "c2").agg(F.sum("n").alias("n"), F.sum("r3").alias("r3"), F.sum("r2").alias("r2")).toPandas()
    table = table.sort_values(["bucket", "c3", "c2"])
    n = table["n"].to_numpy(float)
    weights = learn_weights(table["bucket"].to_numpy(np.int64), n, table["r3"].to_numpy(float) / np.maximum(n, 1), table["r2"].to_numpy(float) / np.maximum(n, 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _block_rows(batches):
            lengths = np.frombuffer(row["lengths"], "<i8")
            n = int(lengths.sum())
            block = Block(b"", pack_numbers(np.zeros(n, np.int64)), row["lengths"], row["uses"])
            one, two, three = (unpack(d, n) for d in row["learned"])
            found = likelihoods(block, one, two, three, learned)
            starts = np.cumsum(lengths) - lengths
            add = lambda v: np.add.reduceat(v, starts)
            columns = {
                "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(lengths),
                "n_known": pa.array(add((one > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(lengths), n_learned, np.int64)),
                "base_score": pa.array(add(np.log10(found[3]))), "score": pa.array(add(np.log10(mixed(*found, weights)))),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    with rows_per_batch(spark, 2):
        return cut(counts.drop("counted").mapInArrow(score, schema))


def language_model_scores(docs: DataFrame) -> DataFrame:
    """`score_texts` with texts of remainder 1 (crc32 of the doc_id, modulo 5) held out and those of remainder 4 deleted for the weights."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return score_texts(docs, learnable=remainder != 1, deleted=remainder == 4, held_out=remainder == 1)
