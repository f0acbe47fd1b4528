"""Where documents may share runs of words: content-selected anchors that several documents hold.

The smallest hash of the `gram`-word shingles in every window of `window` words is
the window's anchor. Equal windows have equal anchors, so a window can repeat only
if its anchor does. Anchors are a small share of all windows, and only documents
with repeated anchors take part in the costly steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.batches import Words, pieces, sliding_min, small_batches
from fieldtally.operators.lineage import cut


def window_anchors(words: Words, hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of the window from each word on, and whether the window lies within one text."""
    grams, _ = words.grams(hashes, gram)
    return sliding_min(grams, window - gram + 1), words.inside(window)


def distinct_in_rows(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value of a row once; `owner` ascends."""
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    owner, values = owner[fresh], values[fresh]
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return owner[fresh], values[fresh]


def anchor_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, key) of every row's anchors, each once a row; null doc_ids are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                words = Words.of(piece.column("text"))
                anchors, inside = window_anchors(words, words.hashes(), window, gram)
                owner, keys = distinct_in_rows(words.owners()[inside], anchors[inside])
                ids = piece.column("doc_id").to_numpy()[owner]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys.view(np.int64))], names=["doc_id", "key"])

    return small_batches(docs.select("doc_id", "text").where("doc_id is not null")).mapInArrow(run, "doc_id long, key long")


def with_shared_anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Every row of `docs` (doc_id, text) with `keys`: the anchors it shares with another doc_id, null if none."""
    anchors = anchor_rows(docs, window, gram)
    several = anchors.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    shared = cut(several.select("key"))
    hits = anchors.join(shared, "key").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    return cut(docs.join(cut(hits), "doc_id", "left").select("doc_id", "text", "keys"))
