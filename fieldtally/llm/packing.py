"""Best-fit packing of tokenised documents by the linear grouping scheme.

Pieces are dealt by hash over shards of about `SHARD_PIECES` rows; each shard is
packed on its own, so nothing passes whole through one task. Within a shard large
lengths are rounded up inside groups of equal cardinality, configurations of the
few rounded sizes are chosen, actual documents take the places, and small pieces
go best-fit into what is left.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.batches import small_batches, text_bytes
from fieldtally.operators.lineage import cut

CAPACITY = 4096
END_ID = 1
SHARD_PIECES = 16_384
GROUPS = 96
SMALL_PART = 8  # lengths up to capacity / SMALL_PART count as small
CACHED_WORDS = 600_000  # per Python worker; beyond it the cache starts anew
_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _row long"
# The vocabulary's own split into words, for ASCII text.
_ASCII_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_FORMATS = [f"<{n}I" for n in range(33)]
_LOADED: dict[str, WordIds] = {}


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    return struct.pack(_FORMATS[len(ids)] if len(ids) < len(_FORMATS) else f"<{len(ids)}I", *ids)


class WordIds:
    """Token ids of a text, word by word.

    The vocabulary never joins tokens across white space, so the ids of a text are
    those of its words in turn; repeated words are looked up. ASCII words are looked
    up in the tokenizer's own lower-case parts as well.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}

    def __call__(self, text: bytes) -> bytes:
        words = text.split()
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            self._learn(set(words).difference(self.words))
        ids = b"".join(map(self.words.__getitem__, words))
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        return ids

    def _learn(self, words: set[bytes]) -> None:
        split = {w: _ASCII_PARTS.findall(w.lower()) if w.isascii() and b"<|" not in w else [w] for w in words}
        rest, tokenize = [], self.tokenizer.model.tokenize
        for part in {p for parts in split.values() for p in parts}:
            if part not in self.parts:
                if part.isalpha() or len(part) == 1 and part.isdigit():  # one lower-case ASCII part of its own: no normaliser or splitter needed
                    self.parts[part] = _packed([x.id for x in tokenize(part.decode())])
                else:
                    rest.append(part)
        if rest:
            encoded = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in rest], add_special_tokens=False)
            self.parts.update((p, _packed(e.ids)) for p, e in zip(rest, encoded))
        get = self.parts.__getitem__
        self.words.update((w, b"".join(map(get, parts))) for w, parts in split.items())
        if len(self.parts) > CACHED_WORDS:
            self.parts.clear()


def token_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of at most `capacity` tokens: place in its document, length, CRC-32 of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids_of = _LOADED.get(tokenizer) or _LOADED.setdefault(tokenizer, WordIds(tokenizer))
        end, task, row = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            data, out = data.tobytes(), []
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                ids = ids_of(data[at[k] : at[k + 1]]) + end
                for piece, begin in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[begin : begin + 4 * capacity]
                    out.append((doc, piece, begin // 4, len(part) // 4, zlib.crc32(part), task, row))
                    row += 1
            columns = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "_task", "_row"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return small_batches(own).mapInArrow(run, _SCHEMA)


def group_sizes(large: np.ndarray, groups: int) -> np.ndarray:
    """Linear grouping: descending lengths in runs of equal cardinality, each rounded up to its run's first."""
    run = -(-len(large) // groups)
    return large[(np.arange(len(large)) // run) * run]


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Fillings of the few sizes (descending) and how often each is used, until all are placed.

    Each filling starts with the largest size left and takes the companions that
    fill the bin most: reachable sums are bit sets, built size by size.
    """
    left, used = list(counts), []
    top = 0
    while True:
        while top < len(sizes) and not left[top]:
            top += 1
        if top == len(sizes):
            return used
        room = capacity - sizes[top]
        alive = [i for i in range(top, len(sizes)) if left[i] - (i == top) > 0 and sizes[i] <= room]
        reach, levels, full = 1, [], (1 << (room + 1)) - 1
        for i in alive:
            levels.append(reach)
            for _ in range(min(left[i] - (i == top), room // sizes[i])):
                grown = reach | (reach << sizes[i]) & full
                if grown == reach:
                    break
                reach = grown
        total, filling = reach.bit_length() - 1, {top: 1}
        for i, reach in zip(reversed(alive), reversed(levels)):
            while not reach >> total & 1:
                filling[i] = filling.get(i, 0) + 1
                total -= sizes[i]
        times = min(left[i] // m for i, m in filling.items())
        for i, m in filling.items():
            left[i] -= m * times
        used.append((times, filling))


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[order]
    cut_at = int(np.searchsorted(-sorted_lengths, -(capacity // SMALL_PART), "left"))
    large, filled = order[:cut_at], []
    if len(large):
        rounded = group_sizes(sorted_lengths[:cut_at], groups)
        sizes, starts, counts = np.unique(-rounded, return_index=True, return_counts=True)
        waiting = [list(large[s : s + c][::-1]) for s, c in zip(starts, counts)]
        for times, filling in configurations((-sizes).tolist(), counts.tolist(), capacity):
            for _ in range(times):
                level = 0
                for i, m in filling.items():
                    for _ in range(m):
                        k = waiting[i].pop()
                        bins[k], offsets[k] = len(filled), level
                        level += int(lengths[k])
                filled.append(level)
    rooms: dict[int, list[int]] = {}
    for b, level in enumerate(filled):
        rooms.setdefault(capacity - level, []).append(b)
    open_rooms = 0
    for room in rooms:
        open_rooms |= 1 << room
    for k in order[cut_at:]:
        need = int(lengths[k])
        fits = open_rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_rooms &= ~(1 << room)
        else:
            room, b = capacity, len(filled)
            filled.append(0)
        bins[k], offsets[k] = b, filled[b]
        filled[b] += need
        rooms.setdefault(room - need, []).append(b)
        open_rooms |= 1 << (room - need)
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Sequences of at most `capacity` tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of `docs` is packed: null texts as empty ones (the end id alone), null or
    repeated doc_ids as documents of their own. Extra columns are ignored; no rows give none.
    """
    held = cut(token_pieces(docs, tokenizer, capacity=capacity, end_id=end_id))
    shards = max(1, -(-held.count() // shard_pieces))
    dealt = held.withColumn("_shard", F.pmod(F.xxhash64("_task", "_row"), F.lit(shards)))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_task", "ascending"), ("_row", "ascending")])
        bins, offsets = pack_lengths(table.column("length").to_numpy(), capacity)
        ids = (table.column("_shard").to_numpy() << 32) + bins
        kept = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return kept.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("_shard").applyInArrow(place, schema)
