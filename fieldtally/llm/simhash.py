"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that differ in at most `radius` of 64 bits agree on at least
`bands - radius` of `bands` equal bands, so they meet in a bucket of one such
choice of bands. Buckets are compared block by block: bit planes stand vertically,
carry-save counters advance many distances with a few word operations per plane,
and rows of a block whose every distance exceeds the radius are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.batches import small_batches, text_bytes
from fieldtally.llm.components import smallest_reachable
from fieldtally.operators.lineage import cut

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
BANDS = 4
BLOCK = 2048
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; no words give zero."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: lowers A-Z and splits at ASCII white space only
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(shingle_words)]))
    hashes = np.array([xxh64_intdigest(s, seed) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), 1 << 16):
        part = hashes[begin : begin + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and signed 64-bit `fp` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            out = np.array([fingerprint(data[a:b].tobytes(), shingle_words) for a, b in zip(at[:-1], at[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return small_batches(own).mapInArrow(run, "doc_id long, fp long")


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """(64, words) array: bit r of plane j is bit j of fingerprint r; padding rows are zero."""
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    padded = np.zeros((64, -(-packed.shape[1] // 8) * 8), np.uint8)
    padded[:, : packed.shape[1]] = packed
    return padded.view("<u8")


def close_pairs(rows: np.ndarray, others: np.ndarray, radius: int, *, same: bool, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with rows[i] and others[j] at most `radius` bits apart; `same`: one block against itself, i < j."""
    planes, found = bit_planes(others), []
    width = planes.shape[1]
    counters = (radius + 1).bit_length() if radius else 1
    bias = (1 << counters) - (radius + 1)  # the carry out of the top counter marks a distance beyond the radius
    places = np.arange(width * 64)
    for begin in range(0, len(rows), step):
        at = np.arange(begin, min(begin + step, len(rows)))
        barred = np.broadcast_to(places >= len(others), (len(at), width * 64))
        if same:
            barred = barred | (places[None, :] <= at[:, None])
        over = np.packbits(barred, axis=1, bitorder="little").view("<u8").copy()
        count = [np.full((len(at), width), _FULL if bias >> c & 1 else 0, np.uint64) for c in range(counters)]
        for j in range(64):
            bit = (rows[at] >> np.uint64(j)) & np.uint64(1)
            carry = planes[j][None, :] ^ (np.uint64(0) - bit)[:, None]
            for c in range(counters):
                count[c], carry = count[c] ^ carry, count[c] & carry
            over |= carry
            if j % 8 == 7:
                alive = ~(over == _FULL).all(axis=1)
                if not alive.all():
                    at, over, count = at[alive], over[alive], [c[alive] for c in count]
                if not len(at):
                    break
        if len(at):
            near = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")
            i, j = np.nonzero(near)
            found.append((at[i], j))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _band_choices(radius: int, bands: int) -> Column:
    """One bucket key per choice of bands that two close fingerprints may have in common."""
    width = 64 // bands
    band = [F.expr(f"shiftrightunsigned(fp, {k * width}) & {(1 << width) - 1}") for k in range(bands)]
    return F.array(*[
        F.struct(F.lit(n).alias("choice"), F.xxhash64(*[band[k] for k in chosen]).alias("key"))
        for n, chosen in enumerate(combinations(range(bands), bands - radius))
    ])


def links(distinct: DataFrame, *, radius: int = RADIUS, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """Pairs u > v of distinct fingerprints (`fp`) at most `radius` bits apart.

    A bucket of more than `block` fingerprints is dealt over several blocks and every
    pair of blocks is a task's unit, so no bucket meets whole in one task.
    """
    if not 0 <= radius < bands or 64 % bands:
        raise ValueError("bands must divide 64 and exceed the radius")
    keyed = distinct.select("fp", F.explode(_band_choices(radius, bands)).alias("b")).select("fp", "b.*")
    sizes = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keyed.join(sizes, ["choice", "key"])
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), blocks).cast("int")
    dealt = shared.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    units = dealt.select(
        "choice", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "fp"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []  # whole units that share one block
        held, last = 0, None

        def flush() -> pa.RecordBatch:
            prints = np.unique(np.concatenate(waiting))
            i, j = close_pairs(prints, prints, radius, same=True)
            waiting.clear()
            x, y = prints[i].view(np.int64), prints[j].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            prints = batch.column("fp").to_numpy().view(np.uint64)
            unit = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("choice", "key", "a", "b")], axis=1)
            change = np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1
            for begin, end in zip([0, *change], [*change, len(unit)]):
                if last is not None and (unit[begin] != last).any() and held >= 1024:
                    yield flush()
                    held = 0
                last = unit[begin]
                waiting.append(prints[begin:end])
                held += end - begin
        if waiting:
            yield flush()

    spread = units.repartition("choice", "key", "a", "b").sortWithinPartitions("choice", "key", "a", "b")
    return spread.select("choice", "key", "a", "b", "fp").mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links) of every row.

    Equal fingerprints always share a component. Null texts count as empty; empty
    texts have fingerprint zero and link like any other. A null doc_id is a member
    but never a component's id, unless no member has one (then null). Repeated rows
    give repeated rows, extra columns are ignored, no rows give none.
    """
    held = cut(fingerprints(docs, shingle_words=shingle_words))
    distinct = cut(held.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = cut(smallest_reachable(links(distinct, radius=radius)))
    placed = distinct.join(roots, distinct.fp == roots.u, "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    members = placed.join(least, "root").select("fp", "component_id")
    return held.join(members, "fp").select("doc_id", "fp", "component_id")
