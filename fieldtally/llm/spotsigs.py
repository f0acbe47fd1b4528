"""SpotSigs fingerprints with DataFrame functions only.

Every common word is an anchor; the anchor and the next `CHAIN` content words after
it, further common words skipped, form one signature. A text's fingerprint is its
set of signatures. Sets are compared by Jaccard likeness; their lengths bound it
from above, so pairs of too different lengths are never intersected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHAIN = 2
BUCKET_ROWS = 2048
MOST_BUCKETS = 8192  # order statistics that reach the driver at most
MARK = "\x01"
# Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be been but by can do for from had has have he her his i if in is it its not of on or our she that the their then there"
    " they this to was we were what when which who will with would you"
    " au aux avec ce ces cette dans des du elle en est et il je la le les leur mais ne nous ou par pas pour que qui sa se ses son sur un une"
    " vous aber als auch auf aus bei das dass dem den der die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch"
    " nur oder sich sie sind so und von vor war wie wird zu zum zur"
    " al como con de del el ella era esta este fue ha hay las lo los más me mi muy no o para pero por porque su sus también te todo tu y ya"
).split()


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """Sorted distinct 32-bit signatures of a text; one without any has the hash of the whole text instead."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    marked = F.transform(words, lambda w: F.when(w.isin(ANCHORS), F.concat(F.lit(MARK), w)).otherwise(w))
    line = F.concat(F.array_join(marked, " "), F.lit(" "))
    skipped = rf"(?: {MARK}[^ ]++)*+"
    spots = F.regexp_extract_all(line, F.lit(rf"{MARK}(?=([^ ]++(?:{skipped} [^{MARK} ][^ ]*+){{{chain}}}))"), 1)
    chains = F.transform(spots, lambda s: F.regexp_replace(s, rf" {MARK}[^ ]++", ""))
    hashed = F.array_sort(F.array_distinct(F.transform(chains, lambda s: F.xxhash64(s).bitwiseAND(F.lit(0xFFFFFFFF)))))
    alone = F.array(F.xxhash64(text, F.lit("whole")).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(F.size(hashed) > 0, hashed).otherwise(alone)


def as_text(found: Column) -> Column:
    """Eight hex digits a signature, in order."""
    return F.array_join(F.transform(found, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two signature sets; 0 where their lengths rule out more than `least`."""
    bound = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    return F.when(bound > least, shared / (F.size(a) + F.size(b) - shared)).otherwise(F.lit(0.0))


def _bucket(bounds: list[int]) -> Column:
    """Number of `bounds` up to doc_id, found in two steps of about the square root of their number; null gives 0."""
    if not bounds:
        return F.lit(0)
    step = int(len(bounds) ** 0.5) + 1
    up_to = lambda array: F.size(F.filter(array, lambda b: b <= F.col("doc_id")))
    coarse = up_to(F.array(*[F.lit(b) for b in bounds[::step]]))
    fine = up_to(F.slice(F.array(*[F.lit(b) for b in bounds]), (coarse - 1) * step + 1, step))
    return F.when(coarse > 0, (coarse - 1) * step + fine).otherwise(0)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Add struct `next` with `columns` of the row after each one by (doc_id, text); after the last comes the first.

    Rows are dealt into neighbouring buckets by approximate quantiles of doc_id; only each
    bucket's first row crosses over. Null doc_ids come first.
    """
    n = docs.count()
    buckets = min(MOST_BUCKETS, max(1, n // BUCKET_ROWS))
    marks = docs.select(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], 20 * buckets)).first()[0] if buckets > 1 else []
    bounds = sorted(set(marks or []))
    dealt = docs.withColumn("_bucket", _bucket(bounds))
    order = [F.asc_nulls_first("doc_id"), "text"]
    follower = F.lead(F.struct(*columns)).over(Window.partitionBy("_bucket").orderBy(*order))
    within = dealt.withColumn("next", follower)
    head = dealt.groupBy("_bucket").agg(F.min(F.struct("doc_id", "text", *[c for c in columns if c != "text"])).alias("head"))
    head = head.select("_bucket", F.struct(*[F.col(f"head.{c}").alias(c) for c in columns]).alias("head"))
    around = Window.orderBy("_bucket")  # one row a bucket, MOST_BUCKETS at most
    heads = head.select("_bucket", F.coalesce(F.lead("head").over(around), F.first("head").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"))
    return within.join(heads, "_bucket").withColumn("next", F.coalesce("next", "head")).drop("head", "_bucket")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Every row's text, the text edited with its successor's beginning, and the signature sets of both and of the successor.

    Columns: doc_id, text, edited, found, found_edited, found_next. Null texts count as
    empty. Null doc_ids come first in the order, ties go by text; extra columns are
    ignored, no rows give none, a single row follows itself.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    linked = with_next(own, ["text"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("next.text"), F.lit(1), half))
    pairs = linked.select("doc_id", "text", edited.alias("edited"), F.col("next.text").alias("next_text"))
    return pairs.select(
        "doc_id", "text", "edited", signatures(F.col("text")).alias("found"),
        signatures(F.col("edited")).alias("found_edited"), signatures(F.col("next_text")).alias("found_next"),
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row; see `edited_pairs`."""
    return edited_pairs(docs).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("found")).alias("fingerprint"),
        as_text(F.col("found_edited")).alias("edited_fingerprint"),
        likeness(F.col("found"), F.col("found_edited")).alias("near_edited"),
        likeness(F.col("found"), F.col("found_next")).alias("near_next"),
    )
