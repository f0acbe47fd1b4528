"""Near copies by SpotSigs: signature sets partitioned by length, compared through pruned Jaccard; DataFrame functions only.

A partition holds the lengths of one step of 1 / `least`, so likeness of `least` or more occurs
within a partition or between neighbours only. Sets meet through signatures among their rarest
(frequency, then value): of a set of n all but the last ceil(least * n) - 1, since two alike sets
share at least one of those. Lengths and places bound the shared number before sets are intersected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.components import smallest_reachable
from fieldtally.llm.spotsigs import likeness, signatures
from fieldtally.operators.lineage import cut

LEAST = 0.8
SLACK = 1e-9  # rounding of products of lengths; errs towards comparing


def signature_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets: set_id, found, size) and (members: doc_id, set_id); equal sets are one, named by their smallest doc_id.

    Null texts count as empty, and all texts without letters or digits that are equal share one set.
    Rows without doc_id take no part; repeated doc_ids are one member of each of their sets.
    """
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = cut(rows.select("doc_id", signatures(F.col("text")).alias("found")).withColumn("key", F.sha2(F.array_join("found", ","), 256)))
    named = cut(found.groupBy("key").agg(F.min("doc_id").alias("set_id")))
    members = found.select("doc_id", "key").join(named, "key").select("doc_id", "set_id").distinct()
    firsts = found.join(named, (found["key"] == named["key"]) & (found["doc_id"] == named["set_id"]), "left_semi")
    sets = firsts.groupBy("key").agg(F.min("doc_id").alias("set_id"), F.min("found").alias("found"))
    # a repeated doc_id may name several sets: the key tells them apart
    return cut(sets.withColumn("size", F.size("found"))), members


def _rarest(sets: DataFrame, least: float) -> DataFrame:
    """key, size, sig, place: of each set the rarest signatures that an alike set must share one of, if other sets have them."""
    single = sets.select("key", "size", F.explode("found").alias("sig"))
    often = cut(single.groupBy("sig").agg(F.count(F.lit(1)).alias("n")))
    counted = single.join(often, "sig").groupBy("key", "size").agg(F.array_sort(F.collect_list(F.struct("n", "sig"))).alias("ordered"))
    kept = F.col("size") - F.ceil(F.col("size") * least - SLACK).cast("int") + 1
    placed = counted.select("key", "size", F.posexplode(F.slice("ordered", F.lit(1), kept)).alias("place", "held"))
    return placed.where("held.n > 1").select("key", "size", "place", F.col("held.sig").alias("sig"))


def _enough(a: Column, b: Column, least: float) -> Column:
    """Signatures that sets of these sizes must share."""
    return F.ceil((a + b) * (least / (1 + least)) - SLACK)


def candidate_pairs(sets: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b): keys of every two sets that lengths, a shared rare signature and its places allow to be alike."""
    step = math.log(1 / least) * (1 + 1e-6)
    rare = cut(_rarest(sets, least).withColumn("part", F.floor(F.log("size") / step)))
    shorter = rare.select("sig", F.col("part").alias("at"), F.col("key").alias("a"), F.col("size").alias("size_a"), F.col("place").alias("place_a"))
    longer = rare.select(
        "sig", F.explode(F.array("part", F.col("part") - 1)).alias("at"), F.col("key").alias("b"), F.col("size").alias("size_b"), F.col("place").alias("place_b")
    )
    a, b = F.col("size_a"), F.col("size_b")
    ordered = (a < b) | ((a == b) & (F.col("a") < F.col("b")))
    still = F.least(a - F.col("place_a"), b - F.col("place_b"))  # shared at most from these places on
    most = F.when(a == b, a - 1).otherwise(a)  # the sets differ
    needed = _enough(a, b, least)
    met = shorter.join(longer, ["sig", "at"]).where(ordered & (a >= b * least - SLACK) & (still >= needed) & (most >= needed))
    return met.select("a", "b").distinct()


def near_pairs(sets: DataFrame, least: float = LEAST) -> DataFrame:
    """(set_a, set_b, near) of every two different sets with a Jaccard likeness of `least` or more."""
    pairs = cut(candidate_pairs(sets, least))
    left = sets.select(F.col("key").alias("a"), F.col("set_id").alias("set_a"), F.col("found").alias("found_a"))
    right = sets.select(F.col("key").alias("b"), F.col("set_id").alias("set_b"), F.col("found").alias("found_b"))
    compared = pairs.join(left, "a").join(right, "b").withColumn("near", likeness(F.col("found_a"), F.col("found_b"), least - SLACK))
    return compared.where(F.col("near") >= least - SLACK).select("set_a", "set_b", "near")


def near_classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, set_id, class_id, n_links of every document with a doc_id.

    `set_id`: smallest doc_id with an equal signature set; `class_id`: smallest doc_id reached over likenesses
    of `least` or more; `n_links`: other sets alike its own. Extra columns are ignored, no rows give none.
    Very long texts are compared whole. A doc_id that is repeated with different texts joins their classes.
    """
    if not 0 < least < 1:
        raise ValueError(f"least must lie between 0 and 1: {least}")
    sets, members = signature_sets(docs)
    members = cut(members)
    links = cut(near_pairs(sets, least))
    edges = links.select(F.col("set_a").alias("u"), F.col("set_b").alias("v")).unionByName(members.select(F.col("doc_id").alias("u"), F.col("set_id").alias("v")))
    roots = smallest_reachable(edges.where("u <> v"))
    both = links.select(F.col("set_a").alias("set_id"), F.col("set_b").alias("other")).unionByName(links.select(F.col("set_b").alias("set_id"), F.col("set_a").alias("other")))
    counts = both.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_links"))
    held = members.groupBy("doc_id").agg(F.min("set_id").alias("set_id"))
    joined = held.join(roots.withColumnRenamed("u", "doc_id"), "doc_id", "left").join(counts, "set_id", "left")
    return joined.select("doc_id", "set_id", F.coalesce("root", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
