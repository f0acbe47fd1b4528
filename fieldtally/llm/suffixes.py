"""Repeated passages from a sparse suffix array.

Only suffixes at minimiser positions are retained: the word where the smallest
shingle hash of a window of `least` words lies. Those with equal first words (a run) are sorted twice, by
what follows and by what precedes, and neighbours are compared. Suffixes that share so many words to the right, and
so many to the left, lie in one interval of either order; the smallest document in both intervals tells whether a
window repeats, and extending it to the left word by word, while it gives way on the right, finds every window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.llm.batches import Words, mix, pieces, sliding_min
from fieldtally.llm.repeats import window_anchors, with_shared_anchors
from fieldtally.operators.lineage import cut

LEAST_WORDS = 50
GRAM = 8
LONGEST_RUN = 1 << 16  # suffixes of one run that one task sorts at most: some 130 MB
TOGETHER = 20_000  # suffixes of several runs that are sorted at a time


def _suffixes(held: DataFrame, least: int, gram: int) -> DataFrame:
    """Retained suffixes that share their first `gram` words: doc_id, pos, head, right and left (words nearest first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = least - gram  # a window's minimiser lies at most so far from its first word
        for batch in batches:
            for piece in pieces(batch):
                words = Words.of(piece.column("text"))
                hashes = words.hashes()
                anchors, inside = window_anchors(words, hashes, least, gram)
                shared = np.unique(pa.compute.list_flatten(piece.column("keys")).to_numpy()).view(np.uint64)
                wanted = inside & np.isin(anchors, shared)
                # the largest wanted anchor of the windows around a word is its own shingle's hash where it is a minimiser
                around = ~np.where(wanted, anchors, np.uint64(0))
                padded = np.concatenate([np.full(reach, ~np.uint64(0)), around])
                best = ~sliding_min(padded, reach + 1)[: len(around)]
                grams, _ = words.grams(hashes, gram)
                at = np.flatnonzero((best == grams) & (best > 0))
                owner, data, out = words.owners(), words.data.tobytes(), []
                for p in at:
                    row = owner[p]
                    first, last = words.first[row], words.first[row + 1]
                    right = data[words.starts[p] : words.ends[min(p + least, last) - 1]].split()
                    low = max(first, p - reach)
                    left = data[words.starts[low] : words.ends[p - 1]].split()[::-1] if p > low else []
                    out.append((row, p - first, b" ".join(right[:gram]), b" ".join(right), b" ".join(left)))
                columns = list(zip(*out)) or [()] * 5
                ids = piece.column("doc_id").take(pa.array(columns[0], pa.int64()))
                rest = [pa.array(c, k) for c, k in zip(columns[1:], (pa.int64(), pa.binary(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([ids, *rest], names=["doc_id", "pos", "head", "right", "left"])

    return held.mapInArrow(run, "doc_id long, pos long, head binary, right binary, left binary")


def word_matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each value, zeros behind them, and the number of words."""
    words = Words.of(column.cast(pa.large_binary()).cast(pa.large_string()))
    out, owner = np.zeros((len(column), width), np.uint64), words.owners()
    out[owner, np.arange(len(owner)) - words.first[owner]] = words.hashes()
    return out, words.counts


class Run:
    """Suffixes of one or more runs of equal heads: words by hash, sorted both ways, with the neighbours' common lengths."""

    def __init__(self, head: list[bytes], right: pa.Array, left: pa.Array, least: int, reach: int):
        number: dict[bytes, int] = {}
        self.run = np.array([number.setdefault(h, len(number)) for h in head], np.int64)
        self.right, self.n_right = word_matrix(right, least)
        self.left, self.n_left = word_matrix(left, reach)
        self.right_order, self.right_common = self._sorted(self.right, self.n_right)
        self.left_order, self.left_common = self._sorted(self.left, self.n_left)

    def _sorted(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes within their runs, and the words that each shares with the one before (-1: another run)."""
        keys = np.ascontiguousarray(np.column_stack([self.run.astype(np.uint64), words]).astype(">u8"))
        order = np.argsort(keys.view(f"V{keys.shape[1] * 8}").reshape(-1), kind="stable") if len(keys) else np.zeros(0, np.int64)
        ranked, limit = words[order], counts[order]
        common = np.full(len(order), -1, np.int64)
        if len(order) > 1:
            unlike = ranked[1:] != ranked[:-1]
            first = np.where(unlike.any(axis=1), unlike.argmax(axis=1), words.shape[1])
            shared = np.minimum(first, np.minimum(limit[1:], limit[:-1]))
            common[1:] = np.where(self.run[order[1:]] == self.run[order[:-1]], shared, -1)
        return order, common

    @staticmethod
    def _intervals(order: np.ndarray, common: np.ndarray, words: int) -> np.ndarray:
        """Interval of each suffix: those that share at least so many words."""
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(common < words)
        return out

    def matches(self, docs: np.ndarray, pos: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows with a smaller document that holds a window around the suffix too: row, start, words, smallest such document.

        A window reaches some words to the left of the suffix, the rest to the right. It repeats in the suffixes that lie in
        the same interval of both orders; extending by a word to the left takes one from the right. All windows of a suffix
        contain it, so the matched ones form one span.
        """
        n = len(docs)
        lowest = np.full(n, np.iinfo(np.int64).max)
        most, fewest = np.full(n, -1), np.full(n, least)
        for before in range(least - gram + 1):
            able = np.flatnonzero((self.n_left >= before) & (self.n_right >= least - before))
            if len(able) < 2:
                continue
            interval = self._intervals(self.right_order, self.right_common, least - before) * (n + 1) + self._intervals(self.left_order, self.left_common, before)
            order = able[np.argsort(interval[able], kind="stable")]
            begins = np.flatnonzero(np.concatenate([[True], np.diff(interval[order]) != 0]))
            smallest = np.repeat(np.minimum.reduceat(docs[order], begins), np.diff(np.append(begins, len(order))))
            found = smallest < docs[order]
            rows = order[found]
            lowest[rows] = np.minimum(lowest[rows], smallest[found])
            most[rows] = np.maximum(most[rows], before)
            fewest[rows] = np.minimum(fewest[rows], before)
        rows = np.flatnonzero(most >= 0)
        return rows, pos[rows] - most[rows], least + most[rows] - fewest[rows], lowest[rows]


SPANS = "doc_id long, start long, n_words long, earlier_id long"
COLUMNS = ["doc_id", "pos", "head", "right", "left"]


def _sorted_runs(suffixes: DataFrame, least: int, gram: int, rows: int) -> DataFrame:
    """Spans of runs of moderate size: whole runs are gathered to about `rows` suffixes and sorted together."""

    def spans(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        docs, pos = table.column("doc_id").to_numpy(), table.column("pos").to_numpy()
        one = lambda c: table.column(c).chunk(0)
        run = Run(table.column("head").to_pylist(), one("right"), one("left"), least, least - gram)
        held, start, words, earlier = run.matches(docs, pos, least, gram)
        return pa.RecordBatch.from_arrays([pa.array(docs[held]), pa.array(start), pa.array(words), pa.array(earlier)], names=[f.split()[0] for f in SPANS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            if size >= rows:  # the runs before the first new key are whole
                turn = np.flatnonzero(keys != waiting[-1].column("key")[-1].as_py())
                if len(turn):
                    yield spans([*waiting, batch.slice(0, turn[0])] if turn[0] else waiting)
                    waiting, size, batch = [], 0, batch.slice(turn[0])
            waiting.append(batch)
            size += batch.num_rows
        if waiting:
            yield spans(waiting)

    return suffixes.repartition("key").sortWithinPartitions("key").select("key", *COLUMNS).mapInArrow(run, SPANS)


def _long_runs(suffixes: DataFrame, least: int, gram: int) -> DataFrame:
    """The same spans for runs too long for one task: every window around a suffix is a row of its own.

    Suffixes with equal words around them are one class; the smallest document of a window is aggregated over classes. In a
    class the smallest document repeats the windows that a smaller one holds, the others repeat all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (rights, n_right), (lefts, n_left) = word_matrix(batch.column("right"), least), word_matrix(batch.column("left"), least - gram)
            # hashes of the first words to the right and to the left, by length
            right, left = (np.zeros((batch.num_rows, w.shape[1] + 1), np.uint64) for w in (rights, lefts))
            for sums, words in ((right, rights), (left, lefts)):
                for k in range(words.shape[1]):
                    sums[:, k + 1] = mix(sums[:, k] * np.uint64(0xD6E8FEB86659FD93) + words[:, k])
            for before in range(least - gram + 1):
                able = np.flatnonzero((n_left >= before) & (n_right >= least - before))
                windows = [right[able, least - before].view(np.int64), (left[able, before] + np.uint64(before)).view(np.int64), np.full(len(able), before)]
                kept = [batch.column(c).take(pa.array(able)) for c in ("c", "d", "doc_id")]
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, windows)], names=["c", "d", "lowest", "a", "b", "before"])

    named = suffixes.withColumn("c", F.xxhash64("head", "right", "left")).withColumn("d", F.xxhash64("left", "right", F.lit(1)))
    classes = named.groupBy("c", "d").agg(F.min("doc_id").alias("doc_id"), F.first("right").alias("right"), F.first("left").alias("left"))
    windows = cut(classes.mapInArrow(run, "c long, d long, lowest long, a long, b long, before long"))
    earliest = windows.groupBy("a", "b").agg(F.min("lowest").alias("earlier"))
    repeats = F.col("earlier") < F.col("lowest")
    every = windows.join(earliest, ["a", "b"]).groupBy("c", "d", "lowest").agg(
        F.struct(F.max("before").alias("most"), F.min("before").alias("fewest"), F.min("earlier").alias("earlier")).alias("every"),
        F.struct(
            F.max(F.when(repeats, F.col("before"))).alias("most"), F.min(F.when(repeats, F.col("before"))).alias("fewest"), F.min("earlier").alias("earlier")
        ).alias("own"),
    )
    rows = named.select("c", "d", "doc_id", "pos").join(every, ["c", "d"])
    rows = rows.select("doc_id", "pos", F.when(F.col("doc_id") > F.col("lowest"), F.col("every")).otherwise(F.col("own")).alias("w")).where("w.most is not null")
    length = F.lit(least) + F.col("w.most") - F.col("w.fewest")
    return rows.select("doc_id", (F.col("pos") - F.col("w.most")).alias("start"), length.alias("n_words"), F.col("w.earlier").alias("earlier_id"))


def repeated_passages(docs: DataFrame, *, least: int = LEAST_WORDS, gram: int = GRAM, longest_run: int = LONGEST_RUN, rows: int = TOGETHER) -> DataFrame:
    """doc_id, start, n_words, earlier_id: the word spans that a document with a smaller doc_id holds too.

    A span is the union of overlapping windows of `least` words that start in a smaller document as well; earlier_id is the
    smallest such document. Documents without such a span have no row, nor has the
    first holder of a passage. Null or short texts and rows without doc_id match nothing, rows
    of one doc_id do not match each other, extra columns are ignored, no rows give none. A text of any length is read
    whole, in one task. Runs of equal heads beyond `longest_run` suffixes are matched window by window instead of in one task,
    with the same result. Words are compared by 64-bit hashes.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    held = with_shared_anchors(own, least, gram)
    suffixes = cut(_suffixes(held.where("keys is not null"), least, gram).withColumn("key", F.xxhash64("head")))
    sizes = suffixes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    long = cut(sizes.where((F.col("n") > longest_run) & (F.col("a") < F.col("b"))).select("key"))
    spans = _sorted_runs(suffixes.join(long, "key", "left_anti"), least, gram, rows)
    spans = cut(spans.unionByName(_long_runs(suffixes.join(long, "key", "left_semi"), least, gram)))
    spans = spans.groupBy("doc_id", "start", "n_words").agg(F.min("earlier_id").alias("earlier_id"))
    spans = spans.withColumn("stop", F.col("start") + F.col("n_words"))
    sequence = Window.partitionBy("doc_id").orderBy("start", "stop")
    before = F.max("stop").over(sequence.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("fresh", F.when(before >= F.col("start"), 0).otherwise(1))
    grouped = fresh.withColumn("span", F.sum("fresh").over(sequence.rowsBetween(Window.unboundedPreceding, 0)))
    merged = grouped.groupBy("doc_id", "span").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("earlier_id").alias("earlier_id"))
    return merged.select("doc_id", "start", (F.col("stop") - F.col("start")).alias("n_words"), "earlier_id")
