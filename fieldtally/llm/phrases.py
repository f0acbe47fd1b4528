"""Substring deduplication with repeated-phrase automata.

Recurring windows of words are confirmed by their hashes across documents. The
documents that may hold copies are dealt over shards; each shard compiles an
Aho-Corasick automaton of the recurring passages, cut from the first documents
that hold them, and streams its documents through it. Matches are of whole word
sequences, so hashes only decide what is looked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.batches import Words, pieces
from fieldtally.llm.repeats import distinct_in_rows, window_anchors, with_shared_anchors
from fieldtally.operators.lineage import cut

WINDOW = 13
GRAM = 4
PATTERN = 6  # words of an automaton's phrases
SHARD_BYTES = 2 << 20


def _candidate_windows(held: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, hash) of the windows whose anchor several documents hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                words = Words.of(piece.column("text"))
                hashes = words.hashes()
                anchors, inside = window_anchors(words, hashes, window, gram)
                shared = np.unique(pa.compute.list_flatten(piece.column("keys")).to_numpy()).view(np.uint64)
                wanted = inside & np.isin(anchors, shared)
                owner, found = distinct_in_rows(words.owners()[wanted], words.grams(hashes, window)[0][wanted])
                ids = piece.column("doc_id").to_numpy()[owner]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found.view(np.int64))], names=["doc_id", "hash"])

    return held.mapInArrow(run, "doc_id long, hash long")


def _passages(needed: DataFrame, window: int) -> DataFrame:
    """Maximal runs of the wanted windows (`hashes`) in the texts that hold them first: (shard, first_id, passage)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                words = Words.of(piece.column("text"))
                found, inside = words.grams(words.hashes(), window)
                lists = piece.column("hashes")
                wanted = np.zeros(len(found), bool)
                ends = np.cumsum(pa.compute.list_value_length(lists).to_numpy())
                every = pa.compute.list_flatten(lists).to_numpy().view(np.uint64)
                for row, (end, a, b) in enumerate(zip(ends, words.first[:-1], words.first[1:])):
                    begin = ends[row - 1] if row else 0
                    wanted[a:b] = inside[a:b] & np.isin(found[a:b], every[begin:end])
                edges = np.diff(np.concatenate([[0], wanted.astype(np.int8), [0]]))
                starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
                rows = words.owners()[starts] if len(starts) else starts
                texts = [words.data[words.starts[a] : words.ends[b + window - 2]].tobytes().decode() for a, b in zip(starts, stops)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("shard").take(pa.array(rows)), piece.column("doc_id").take(pa.array(rows)), pa.array(texts, pa.string())],
                    names=["shard", "first_id", "passage"],
                )

    return needed.select("shard", "doc_id", "text", "hashes").mapInArrow(run, "shard int, first_id long, passage string")


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning of two arrays, looked up in growing steps."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        differ = a[at : at + step] != b[at : at + step] if at + step <= n else a[at:n] != b[at:n]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + len(differ), 2 * step
    return n


class PhraseAutomaton:
    """Aho-Corasick automaton over word numbers that finds every window of the given passages in a text.

    Patterns are the content-selected phrases of `gram` words of all distinct windows; any
    window holds one. A phrase found is extended left and right along the passage word by word,
    so what is reported are common runs of at least `window` words.
    """

    def __init__(self, passages: list[str], first_ids: list[int], window: int, gram: int = PATTERN):
        import ahocorasick

        self.window, self.gram, self.numbers = window, gram, {}
        order = sorted(range(len(passages)), key=lambda k: (first_ids[k], passages[k]))
        words = Words.of(pa.array([passages[k] for k in order], pa.string()))
        self.first_ids = [first_ids[k] for k in order]
        self.bounds = words.first.tolist()
        number = self.numbers.setdefault
        texts = words.data.tobytes()
        self.ids = np.array(
            [number(w, len(self.numbers) + 1) for a, b in zip(words.at[:-1], words.at[1:]) for w in texts[a:b].split()], np.int32
        )
        hashes = words.hashes()
        anchors, inside = window_anchors(words, hashes, window, gram)
        every, _ = words.grams(hashes, window)
        starts = np.flatnonzero(inside)
        starts = starts[np.unique(every[starts], return_index=True)[1]]  # one place a window, under the smallest id
        grams, _ = words.grams(hashes, gram)
        offsets = np.arange(window - gram + 1)
        places = np.unique(starts + (grams[starts[:, None] + offsets] == anchors[starts, None]).argmax(axis=1)) if len(starts) else starts
        patterns: dict[tuple, list[int]] = {}
        for g in places.tolist():
            patterns.setdefault(tuple(self.ids[g : g + gram].tolist()), []).append(g)
        self.owner = dict(zip(places.tolist(), (np.searchsorted(words.first, places, "right") - 1).tolist()))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, found in patterns.items():
            self.automaton.add_word(pattern, found)
        if patterns:
            self.automaton.make_automaton()

    def removed(self, words: list[bytes], doc_id: int) -> np.ndarray:
        """Which words lie in a window that starts in a document before `doc_id`."""
        covered = np.zeros(len(words) + 1, np.int64)
        if len(self.automaton) and len(words) >= self.window:
            get = self.numbers.get
            ids = [get(w, 0) for w in words]
            here, reached, gram = np.array(ids, np.int32), {}, self.gram
            for last, places in self.automaton.iter(tuple(ids)):
                for g in places:
                    shift = g - last
                    if reached.get(shift, -1) >= last:
                        continue
                    owner = self.owner[g]
                    if self.first_ids[owner] >= doc_id:
                        continue
                    low, high, i = self.bounds[owner], self.bounds[owner + 1], last - gram + 1
                    back = _agreeing(here[:i][::-1], self.ids[low:g][::-1])
                    ahead = _agreeing(here[last + 1 :], self.ids[g + gram : high])
                    reached[shift] = last + ahead
                    if back + gram + ahead >= self.window:
                        covered[i - back] += 1
                        covered[last + 1 + ahead] -= 1
        return np.cumsum(covered[:-1]) > 0


def _without(text: bytes, words: Words, row: int, gone: np.ndarray) -> bytes:
    """The kept runs of words with the white space inside them, joined by line feeds."""
    edges = np.diff(np.concatenate([[0], (~gone).astype(np.int8), [0]]))
    first, base = words.first[row], words.at[row]
    runs = zip(np.flatnonzero(edges == 1) + first, np.flatnonzero(edges == -1) + first - 1)
    return b"\n".join(text[words.starts[a] - base : words.ends[b] - base] for a, b in runs)


def dedupe_passages(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row of `docs` (doc_id, text).

    A word goes if a window of `window` words that covers it also starts in a document
    with a smaller doc_id; the first document of every passage keeps it. Where words go,
    the remaining runs are joined by a line feed; other texts stay as they are. Null texts
    have no words (kept_text empty). Rows of one doc_id do not remove each other's words; rows
    without doc_id neither lose nor take any. Extra columns are ignored, no rows give none.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    held = with_shared_anchors(own, window, gram)
    some = held.where("keys is not null")
    windows = _candidate_windows(some, window, gram)
    recurring = cut(windows.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").select("hash", "first_id"))
    volume = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-volume // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(shards)).cast("int")
    uses = windows.join(recurring, "hash").where("doc_id > first_id")
    wanted = cut(uses.groupBy("first_id", shard.alias("shard")).agg(F.collect_set("hash").alias("hashes"), F.collect_set("doc_id").alias("takers")))
    sources = some.select(F.col("doc_id").alias("first_id"), "text")
    needed = wanted.join(sources, "first_id").withColumnRenamed("first_id", "doc_id")
    # a shard's documents that take part in copies come along as rows without a passage
    takers = wanted.select("shard", F.explode("takers").alias("first_id")).distinct().withColumn("passage", F.lit(None).cast("string"))
    passages = cut(_passages(needed, window).unionByName(takers))

    def locate(left: pa.Table, right: pa.Table) -> pa.Table:
        taker = right.column("passage").is_null()
        takers = set(right.column("first_id").filter(taker).to_pylist())
        found = right.filter(pa.compute.invert(taker))
        automaton = PhraseAutomaton(found.column("passage").to_pylist(), found.column("first_id").to_pylist(), window)
        out = []
        for batch in left.to_batches():
            words = Words.of(batch.column("text"))
            data = words.data.tobytes()
            for row, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                text = data[words.at[row] : words.at[row + 1]]
                n_words, n_removed = int(words.counts[row]), 0
                if doc_id in takers:
                    gone = automaton.removed(text.split(), doc_id)
                    n_removed = int(gone.sum())
                    text = _without(text, words, row, gone) if n_removed else text
                out.append((doc_id, n_words, n_removed, text.decode("utf-8", "replace")))
        columns = list(zip(*out)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_words", "n_removed", "kept_text"])

    schema = "doc_id long, n_words long, n_removed long, kept_text string"
    dealt = some.withColumn("shard", shard).select("shard", "doc_id", "text")
    located = dealt.groupBy("shard").cogroup(passages.groupBy("shard")).applyInArrow(locate, schema)
    word = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rest = held.where("keys is null").select("doc_id", word.alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.col("text").alias("kept_text"))
    return located.unionByName(rest)
