"""Exact top-k inner products over a bit-sliced index.

Quantised components stand in blocks of rows as vertical bit slices, built and
written once per block. A query adds the slices of its non-zero signed digits with
carry-save adders, which gives the bit slices of every row's score; the top rows
are selected from the most significant slice downward. Slices below `coarse_bits`
are left out of the sums: a Cauchy bound on what they can add widens the boundary,
and boundary rows are resolved with their exact integer vectors.

Blocks stay where they are: a task holds one group of blocks and reads all queries
past it, keeping each query's running best. Only the queries are copied, once a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.operators.lineage import cut

QUANTUM = 256
BLOCK_ROWS = 65_536
SMALL_BLOCK_ROWS = 16_384  # small tables have smaller blocks, so that several tasks search them
GROUP_BLOCKS = 8  # blocks in one task's memory: some 12 MB each at 64 components
SPREAD_GROUPS = 64  # groups before blocks share one
QUERY_ROWS = 1024
COARSE_BITS = 3
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """(..., rows) booleans as (..., words) of 64 rows; padding is zero."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    short = -packed.shape[-1] % 8
    if short:
        packed = np.concatenate([packed, np.zeros((*packed.shape[:-1], short), np.uint8)], axis=-1)
    return packed.view("<u8")


def signed_digits(value: int) -> list[tuple[int, int]]:
    """(shift, sign) of the non-adjacent form: no two neighbouring digits are non-zero."""
    out, shift = [], 0
    while value:
        if value & 1:
            digit = 2 - (value & 3)
            out.append((shift, digit))
            value -= digit
        value >>= 1
        shift += 1
    return out


class Block:
    """Index of one block of rows, ordered by id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, coarse_bits: int = COARSE_BITS):
        order = np.argsort(ids, kind="stable")
        self.ids, exact = ids[order], vectors[order]
        self.low = exact.min(axis=0)
        raised = (exact - self.low).astype(np.uint64)
        self.vectors = exact.astype("<i2") if max(-int(self.low.min()), int(exact.max())) < 1 << 15 else exact.astype("<i4")
        spread = int(raised.max()).bit_length()
        self.coarse = min(coarse_bits, max(0, spread - 1))
        shifts = np.arange(self.coarse, max(spread, 1), dtype=np.uint64)
        self.slices = pack_bits((raised.T[:, None, :] >> shifts[None, :, None] & np.uint64(1)).astype(bool))
        half = ((1 << self.coarse) - 1) / 2
        rest = (raised & np.uint64((1 << self.coarse) - 1)).astype(np.float64) - half
        self.rest_norm = float(np.sqrt((rest**2).sum(axis=1).max()))
        self.valid = pack_bits(np.ones(len(ids), bool))

    def stored(self) -> dict[str, bytes | int | float]:
        """Columns of the written index."""
        return {
            "ids": self.ids.astype("<i8").tobytes(), "v": self.vectors.tobytes(), "bytes_each": self.vectors.itemsize,
            "slices": self.slices.tobytes(), "coarse": self.coarse, "rest_norm": self.rest_norm,
        }

    @classmethod
    def read(cls, row: dict) -> Block:
        block, width = cls.__new__(cls), row["width"]
        block.ids = np.frombuffer(row["ids"], "<i8")
        block.vectors = np.frombuffer(row["v"], f"<i{row['bytes_each']}").reshape(-1, width)
        block.valid = pack_bits(np.ones(len(block.ids), bool))
        block.slices = np.frombuffer(row["slices"], "<u8").reshape(width, -1, len(block.valid))
        block.coarse, block.rest_norm = row["coarse"], row["rest_norm"]
        return block

    def score_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Bit slices of a coarse score (in units of 2**coarse, offset to be non-negative), least significant first."""
        digits = np.array([(d, *digit) for d in np.flatnonzero(query) for digit in signed_digits(int(query[d]))], np.int64).reshape(-1, 3)
        planes = self.slices.shape[1]
        weights = (digits[:, 1:2] + np.arange(planes)).ravel()
        places = (digits[:, :1] * planes + np.arange(planes)).ravel()
        turned = np.repeat(np.where(digits[:, 2] < 0, _FULL, np.uint64(0)), planes)  # a complement differs by a constant alone
        every = self.slices.reshape(-1, self.slices.shape[2])
        by_weight = {int(w): [every[places[m := weights == w]] ^ turned[m, None]] for w in np.unique(weights)}
        out, weight = [], 0
        while by_weight:
            stack = np.concatenate(by_weight.pop(weight, [np.zeros((0, len(self.valid)), np.uint64)]))
            carried = by_weight.pop(weight + 1, [])
            while len(stack) > 2:
                n = len(stack) // 3
                a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                half = a ^ b
                carried.append((a & b) | (half & c))
                stack = np.concatenate([half ^ c, stack[3 * n :]])
            if len(stack) == 2:
                carried.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
            out.append(stack[0] if len(stack) else np.zeros(len(self.valid), np.uint64))
            if carried:
                by_weight[weight + 1] = carried
            weight += 1
        return out

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows other than `own`, ties to smaller ids."""
        candidates = self.valid.copy()
        first, last = np.searchsorted(self.ids, [own, own + 1])
        for r in range(first, last):
            candidates[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        slices = self.score_slices(query)
        margin = int(np.ceil(2 * np.linalg.norm(query.astype(np.float64)) * self.rest_norm / (1 << self.coarse))) + 1 if self.coarse else 0
        least = _kth_largest(slices, candidates, k) - margin
        rows = np.flatnonzero(np.unpackbits(_at_least(slices, candidates, least).view(np.uint8), bitorder="little"))
        scores = self.vectors[rows].astype(np.int64) @ query
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best]


def _kth_largest(slices: list[np.ndarray], candidates: np.ndarray, k: int) -> int:
    """Value of the k-th largest row (0 if there are fewer), most significant slice first."""
    wanted, value = k, 0
    for s in range(len(slices) - 1, -1, -1):
        high = candidates & slices[s]
        n = int(np.bitwise_count(high).sum())
        if n >= wanted:
            candidates, value = high, value | 1 << s
        else:
            wanted -= n
            candidates = candidates & ~slices[s]
    return value if int(np.bitwise_count(candidates).sum()) >= wanted else 0


def _at_least(slices: list[np.ndarray], candidates: np.ndarray, value: int) -> np.ndarray:
    if value <= 0:
        return candidates
    above, equal = np.zeros_like(candidates), candidates
    for s in range(len(slices) - 1, -1, -1):
        if value >> s & 1:
            equal = equal & slices[s]
        else:
            above |= equal & slices[s]
            equal = equal & ~slices[s]
    return above | equal


def _usable(vectors: DataFrame, vector: str) -> DataFrame:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * QUANTUM).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).where(finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.size(vector).alias("width"), whole.alias("v")
    )


SIDE = "width int, part int, ids binary, v binary, bytes_each int, slices binary, coarse int, rest_norm double"


def _packed(rows: DataFrame, part: Column, *, index: bool) -> DataFrame:
    """One row per width and part: ids and vectors as bytes, and for the index the bit slices of the block."""
    names = [f.split()[0] for f in SIDE.split(", ")]

    def pack(table: pa.Table) -> pa.Table:
        width = table.column("width")[0].as_py()
        ids = table.column("vec_id").to_numpy()
        v = pa.compute.list_flatten(table.column("v")).to_numpy().reshape(-1, width)
        row = Block(ids, v).stored() if index else {"ids": ids.astype("<i8").tobytes(), "v": v.astype("<i4").tobytes(), "bytes_each": 4}
        row |= {"width": width, "part": table.column("part")[0].as_py()}
        types = {"bytes_each": pa.int32(), "width": pa.int32(), "part": pa.int32(), "coarse": pa.int32(), "rest_norm": pa.float64()}
        return pa.table({n: pa.array([row.get(n)], types.get(n, pa.binary())) for n in names})

    return rows.withColumn("part", part.cast("int")).groupBy("width", "part").applyInArrow(pack, SIDE)


def _best(found: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    ids, scores = (np.concatenate(side) for side in zip(*found))
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def top_k(vectors: DataFrame, *, queries: Column, k: int = 5, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row for which `queries` holds.

    Components become floor(256 x). Vectors that are null, empty, or hold null or
    non-finite components take no part, nor do null ids; only vectors of one width are
    compared. Rows that repeat an id all count as candidates of other ids; as queries
    their candidates are ranked together, k a query id. Quantised components must
    fit 32 bits and scores 64. Fewer than k others: all of them. No rows give none.

    The index crosses the network once. A group of blocks gets every query once, so
    queries are copied as often as there are groups: SPREAD_GROUPS until a group holds
    GROUP_BLOCKS whole blocks. Each group yields k rows a query, and a last step merges those.
    """
    own_place = F.xxhash64("vec_id", F.monotonically_increasing_id())  # written, so a repeated id is spread for good
    held = cut(_usable(vectors, vector).withColumn("asked", queries).withColumn("spread", own_place))
    n, n_asked = (max(1, c) for c in held.agg(F.count(F.lit(1)), F.count(F.when(F.col("asked"), 1))).first())
    blocks = max(-(-n // BLOCK_ROWS), min(SPREAD_GROUPS, -(-n // SMALL_BLOCK_ROWS)))
    groups = max(-(-blocks // GROUP_BLOCKS), min(SPREAD_GROUPS, blocks))
    parts = -(-n_asked // QUERY_ROWS)
    index = cut(_packed(held, F.pmod("spread", F.lit(blocks)), index=True))
    asked = cut(_packed(held.where("asked"), F.pmod(F.xxhash64("spread"), F.lit(parts)), index=False))
    sent = asked.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("turn", F.lit(1))
    stayed = index.withColumn("grp", F.pmod("part", F.lit(groups)).cast("int")).withColumn("turn", F.lit(0))
    streams = stayed.unionByName(sent).repartitionById(groups, "grp").sortWithinPartitions("grp", "width", "turn", "part")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held_blocks = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if place != (row["grp"], row["width"]):
                    place, held_blocks = (row["grp"], row["width"]), []
                if row["turn"] == 0:
                    held_blocks.append(Block.read(row))
                    continue
                if not held_blocks:
                    continue
                query_ids = np.frombuffer(row["ids"], "<i8")
                query_v = np.frombuffer(row["v"], "<i4").reshape(-1, row["width"]).astype(np.int64)
                found = [_best([b.top(v, q, k) for b in held_blocks], k) for q, v in zip(query_ids, query_v)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(query_ids, [len(ids) for ids, _ in found])),
                        pa.array(np.concatenate([ids for ids, _ in found])),
                        pa.array(np.concatenate([scores for _, scores in found])),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

    near = streams.mapInArrow(search, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
