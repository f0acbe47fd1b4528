"""From raw documents to packed token sequences: five stages, each one operator over all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm import langid, mixing, packing, phrases, simhash
from fieldtally.operators.lineage import cut

LEAST_CONFIDENCE = 0.4


def _free(name: str, docs: DataFrame) -> str:
    """A column name that `docs` does not use."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _with_keys(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows without doc_id, written once with a key of their own that comes after all doc_ids, and the key's name."""
    key = _free("row_key", docs)
    rows = docs.where("doc_id is null").withColumn(key, F.lit(1 << 62) + F.monotonically_increasing_id())
    return cut(rows), key


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told: no letters, or a score below `LEAST_CONFIDENCE`.

    Null and empty texts go; null languages are only not learned from. Repeated rows are judged alike, long texts whole, no rows give none.
    """
    model = langid.fit(docs.select("doc_id", "text", "lang"), learnable=~langid.held_out(4, 2))
    label, score = _free("language", docs), _free("confidence", docs)
    told = langid.predict(docs, model, label=label, score=score)
    sure = (F.col(label) != langid.UNKNOWN) & (F.col(score) >= LEAST_CONFIDENCE)
    return told.where(sure).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of every near-duplicate group.

    Of rows that repeat a doc_id one stays. A row without doc_id stays only where its group has none with one, and of several
    such rows one stays. Null and empty texts, and all without a word, are copies of each other. Texts are hashed whole; no
    rows give none.
    """
    nameless, key = _with_keys(docs)
    texts = docs.where("doc_id is not null").select("doc_id", "text").unionByName(nameless.select(F.col(key).alias("doc_id"), "text"))
    members = cut(simhash.near_duplicates(texts))
    kept = members.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    once = docs.join(kept.where("n = 1").select("doc_id"), "doc_id", "left_semi")
    several = docs.join(kept.where("n > 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    without = nameless.join(kept.select(F.col("doc_id").alias(key)), key, "left_semi")
    return once.select(*docs.columns).unionByName(several.select(*docs.columns)).unionByName(without.select(*docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take passages of 13 words and more out of all documents but their first; documents left without a word go.

    Rows without doc_id come after all others, each as a document of its own. Null and empty texts have no passage and stay. Texts
    of any length are read whole; no rows give none.
    """
    nameless, key = _with_keys(docs)
    texts = docs.where("doc_id is not null").select("doc_id", "text").unionByName(nameless.select(F.col(key).alias("doc_id"), "text"))
    found = phrases.dedupe_passages(texts).where("n_removed > 0")
    change = _free("change", nameless)
    row = F.struct("doc_id", "kept_text", (F.col("n_removed") == F.col("n_words")).alias("gone")).alias(change)
    changes = cut(found.select(row))
    kept = F.col(f"{change}.kept_text")
    new = {"text": F.coalesce(kept, "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(kept.isNull(), F.col("n_chars")).otherwise(F.length(kept))
    columns = [new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns]

    def changed(rows: DataFrame, by: str) -> DataFrame:
        joined = rows.join(changes, F.col(by) == F.col(f"{change}.doc_id"), "left")
        return joined.where(~F.coalesce(F.col(f"{change}.gone"), F.lit(False))).select(*columns)

    return changed(docs.where("doc_id is not null"), "doc_id").unionByName(changed(nameless, key))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights select, once for each epoch they are selected in.

    Rows of one leaf that share a doc_id (or have none) are selected together. Null languages and sources are leaves as the weights
    name them; null texts count no token. No rows give none.
    """
    return mixing.mixed_rows(docs, mixing.PRODUCTION)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 tokens, one row per piece of a document.

    Null texts are empty: one end token. Repeated rows are packed each, longer texts are cut, no rows give none.
    """
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]
# Training, automata and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written before the next reads it; odd rows as the stages say."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
