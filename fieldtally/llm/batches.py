"""Whole texts of an Arrow batch as bytes, words and hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PIECE_BYTES = 2 << 20  # working memory of the vectorised steps, not a limit on texts
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ONE = np.uint64(1)


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, in a session that hands texts to Python a thousand at a time: whole texts are long, and every batch is held twice."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return df


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets between them; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about `limit` bytes of text; a longer text makes a slice of its own."""
    _, at = text_bytes(batch.column(text))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (multiply and shift twice)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


_BYTE_POWERS, _WORD_POWERS = _Powers(0x9E3779B97F4A7C15), _Powers(0xD6E8FEB86659FD93)
_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of every text: byte spans, hashes and the first word of each text."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at
        solid = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = solid[:-1]
        self.starts = np.flatnonzero(solid & (~before | edge[:-1]))
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = solid[1:]
        self.ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, at)  # n + 1 word positions

    @classmethod
    def of(cls, column: pa.Array) -> Words:
        return cls(*text_bytes(column))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        """Row of every word."""
        return np.repeat(np.arange(len(self.at) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        up, down = _BYTE_POWERS.get(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE_CODES[self.data] * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def grams(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the `size` words from each word on, and whether they lie within one text."""
        n = len(hashes)
        if n < size:
            return np.zeros(n, np.uint64), np.zeros(n, bool)
        up, down = _WORD_POWERS.get(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * up[:n], out=sums[1:])
        out = np.zeros(n, np.uint64)
        out[: n - size + 1] = mix((sums[size:] - sums[:-size]) * down[: n - size + 1])
        return out, self.inside(size)

    def inside(self, size: int) -> np.ndarray:
        return np.arange(len(self.starts)) + size <= np.repeat(self.first[1:], self.counts)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values; the last width - 1 places repeat partial windows."""
    out, reach = values.copy(), 1
    while reach < width:
        step = min(reach, width - reach)
        np.minimum(out[:-step], out[step:].copy(), out=out[:-step])
        reach += step
    return out
