"""Mixing sources to target weights in a domain-language-source tree.

A node's budget is shared among its children by weight; a child that cannot use
its share (its tokens times the allowed epochs) leaves the rest to its siblings,
and only what they cannot use either goes up to the parent's siblings. Each leaf
then takes the token prefix of its seeded epochs.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.operators.lineage import cut

LEVELS = ("domain", "lang", "source")
BUCKET_DOCS = 4096  # documents per ordered bucket of a leaf's epoch
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Target:
    """Whole-number weights by node name and level; nodes not named get the level's `others`."""

    domain_of: Mapping[str, str]  # source to domain
    weights: Mapping[str, Mapping[str, int]]
    others: Mapping[str, int] = field(default_factory=lambda: {"domain": 10, "lang": 5, "source": 10})
    other_domain: str = "other"
    share: float = 1.0  # total budget as a share of all tokens
    epochs: int = 2  # a document is repeated at most so often
    seed: int = 17


def _lookup(column: Column, table: Mapping[str, object], other: object) -> Column:
    found = F.lit(other)
    for key, value in table.items():
        found = F.when(column == key, F.lit(value)).otherwise(found)
    return found


def _share_out(children: DataFrame, parent: list[str], name: str, others: Mapping[str, int], weights: Mapping[str, int]) -> DataFrame:
    """Add `budget`: of the parent's `given`, by weight, nobody above `capacity`."""
    wide = "decimal(38,0)"
    weighed = children.withColumn("w", _lookup(F.col(name), weights, others[name]).cast("long"))
    group = Window.partitionBy(*parent)
    rising = group.orderBy(F.col("capacity").cast("double") / F.col("w"), name)
    before = F.coalesce(F.sum("capacity").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # in order of capacity per weight the sated children come first
    sated = F.col("capacity").cast("decimal(19,0)") * F.col("rest").cast("decimal(18,0)") <= F.col("w").cast("decimal(18,0)") * (
        F.col("given") - F.col("before")
    ).cast("decimal(19,0)")
    marked = weighed.withColumn("before", before).withColumn("rest", rest).withColumn("sated", sated)
    left = F.col("given") - F.sum(F.when(F.col("sated"), F.col("capacity")).otherwise(0)).over(group)
    open_weight = F.sum(F.when(F.col("sated"), 0).otherwise(F.col("w"))).over(group)
    part = F.expr(f"cast((cast(w as decimal(18,0)) * cast(`left` as decimal(19,0))) div cast(open_weight as {wide}) as long)")
    shared = marked.withColumn("left", left).withColumn("open_weight", open_weight)
    return shared.withColumn("budget", F.when(F.col("sated"), F.col("capacity")).otherwise(part)).drop(
        "w", "before", "rest", "sated", "left", "open_weight", "given"
    )


def leaf_budgets(documents: DataFrame, target: Target) -> DataFrame:
    """Tokens, documents and budget of every leaf. `documents` has the three levels and n_tokens."""
    leaves = documents.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    leaves = cut(leaves.withColumn("capacity", F.col("tokens") * target.epochs))
    given = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(target.share)).cast("long").alias("given"), F.coalesce(F.sum("capacity"), F.lit(0)).alias("most")).first()
    parent: list[str] = []
    above = None
    for depth, name in enumerate(LEVELS):
        keys = [*parent, name]
        nodes = leaves if depth == 2 else leaves.groupBy(*keys).agg(F.sum("capacity").alias("capacity"))
        if above is None:
            nodes = nodes.withColumn("given", F.lit(min(given["given"], given["most"])).cast("long"))
        else:
            nodes = nodes.join(above.select(*parent, F.col("budget").alias("given")), parent)
        above = cut(_share_out(nodes, parent or [F.lit(0)], name, target.others, target.weights.get(name, {})))
        parent = keys
    return above


def _leaf_columns(target: Target) -> dict[str, Column]:
    source, lang = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    return {"domain": _lookup(source, target.domain_of, target.other_domain), "lang": lang, "source": source}


def _order(target: Target, whole: Column) -> Column:
    """Place of a document in the seeded order of epoch `whole`."""
    return F.md5(F.concat_ws("|", F.lit(str(target.seed)), whole.cast("string"), F.col("doc_id").cast("long").cast("string")))


def mix(docs: DataFrame, target: Target) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epoch: one row per selected document and epoch.

    Tokens are words. A leaf takes whole epochs and then, in the seeded order of the next
    one, every document that starts before its budget is reached. Null languages and
    sources are leaves named by the empty text, null texts have no tokens (they go along
    with whole epochs and prefixes, a leaf without tokens gives none), null doc_ids share one place in
    the order, repeated rows count as documents of their own. Extra columns are ignored.
    """
    ready, prefix = _selected(docs, target)
    out = ["doc_id", *LEVELS, "n_tokens", "epoch"]
    repeated = ready.where("whole > 0").withColumn("epoch", F.explode(F.expr("sequence(0, whole - 1)"))).select(*out)
    return repeated.unionByName(prefix.withColumn("epoch", F.col("whole")).select(*out))


def mixed_rows(docs: DataFrame, target: Target) -> DataFrame:
    """The whole rows of `docs` that `mix` selects, each once for every epoch it is selected in.

    A leaf's last epoch is a prefix of its order, so one place a leaf says which rows it
    takes and the texts need not move. Rows of one leaf that share a doc_id (or have none)
    are selected together.
    """
    ready, prefix = _selected(docs, target)
    reach = prefix.groupBy(*LEVELS).agg(F.max("order").alias("reach"))
    leaves = cut(ready.select(*LEVELS, "whole").distinct().join(reach, list(LEVELS), "left"))
    taken, name = {c.lower() for c in docs.columns}, "leaf"
    while name in taken:
        name += "_"
    leaf = leaves.select(F.struct(*leaves.columns).alias(name))
    same = [column == F.col(f"{name}.{level}") for level, column in _leaf_columns(target).items()]
    whole = F.col(f"{name}.whole")
    times = whole + F.when(_order(target, whole) <= F.col(f"{name}.reach"), 1).otherwise(0)
    repeats = F.explode(F.array_repeat(F.lit(0), times)).alias(name)
    return docs.join(leaf, same).select(*[F.col(f"`{c}`") for c in docs.columns], repeats).drop(name)


def _selected(docs: DataFrame, target: Target) -> tuple[DataFrame, DataFrame]:
    """All documents of leaves with a budget (`whole` epochs each), and the `order` prefix of the epoch after those."""
    levels = _leaf_columns(target)
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[levels[name].alias(name) for name in LEVELS],
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
    )
    held = cut(narrow)
    budgets = leaf_budgets(held, target).where("tokens > 0 and budget > 0").select(
        *LEVELS,
        F.expr("cast(budget div tokens as int)").alias("whole"),
        F.expr("budget % tokens").alias("rest"),
        F.ceil(F.col("docs") / F.lit(BUCKET_DOCS)).alias("buckets"),
    )
    ready = held.join(budgets, list(LEVELS))
    # the last epoch: a seeded order, cut into buckets of neighbouring places that are summed first
    place = F.conv(F.substring("order", 1, 10), 16, 10).cast("long")
    last = ready.where("rest > 0").withColumn("order", _order(target, F.col("whole"))).withColumn("bucket", F.shiftright(place * F.col("buckets"), 40))
    keys = [*LEVELS, "bucket"]
    sums = last.groupBy(*keys).agg(F.sum("n_tokens").alias("inside"))
    earlier = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, F.coalesce(F.sum("inside").over(earlier), F.lit(0)).alias("bucket_start"))
    reached = last.join(starts, keys).where("bucket_start < rest")
    within = Window.partitionBy(*keys).orderBy("order", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("bucket_start") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    return ready, reached.withColumn("start", start).where("start < rest")


def mix_sql(target: Target) -> str:
    """The same selection in SQL over a table `documents`."""

    def case(column: str, table: Mapping[str, object], other: object) -> str:
        quoted = lambda x: str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"
        return f"CASE {column} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items()) + f" ELSE {quoted(other)} END" if table else quoted(other)

    parts = [
        f"""docs AS (SELECT doc_id, {case("coalesce(source, '')", target.domain_of, target.other_domain)} AS domain, coalesce(lang, '') AS lang,
            coalesce(source, '') AS source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents)""",
        f"leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {target.epochs} AS BIGINT) AS capacity FROM docs GROUP BY ALL)",
        f"given0 AS (SELECT least(CAST(floor(coalesce(sum(tokens), 0) * CAST({target.share} AS DOUBLE)) AS BIGINT), CAST(coalesce(sum(capacity), 0) AS BIGINT)) AS given FROM leaves)",
    ]
    for depth, name in enumerate(LEVELS):
        keys, parent = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth])
        nodes = "SELECT * FROM leaves" if depth == 2 else f"SELECT {keys}, CAST(sum(capacity) AS BIGINT) AS capacity FROM leaves GROUP BY {keys}"
        joined = f"({nodes}) n, given0 g" if depth == 0 else f"({nodes}) n JOIN (SELECT {parent}, budget AS given FROM budget{depth - 1}) g USING ({parent})"
        by = f"PARTITION BY {parent}" if parent else ""
        rising = f"{by} ORDER BY CAST(capacity AS DOUBLE) / w, {name}"
        parts += [
            f"""marked{depth} AS (SELECT *, CAST(capacity AS HUGEINT) * rest <= CAST(w AS HUGEINT) * (given - before) AS sated FROM (
                SELECT *, coalesce(sum(capacity) OVER ({rising} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                    sum(w) OVER ({rising} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
                FROM (SELECT n.*, g.given, CAST({case(name, target.weights.get(name, {}), target.others[name])} AS BIGINT) AS w FROM {joined})))""",
            f"""budget{depth} AS (SELECT * EXCLUDE (given, w, before, rest, sated), CAST(CASE WHEN sated THEN capacity ELSE
                CAST(w AS HUGEINT) * (given - sum(CASE WHEN sated THEN capacity ELSE 0 END) OVER ({by})) //
                nullif(sum(CASE WHEN sated THEN 0 ELSE w END) OVER ({by}), 0) END AS BIGINT) AS budget FROM marked{depth})""",
        ]
    parts.append(
        f"""ready AS (SELECT d.*, budget // tokens AS whole, budget % tokens AS rest,
            md5(concat_ws('|', '{target.seed}', CAST(budget // tokens AS VARCHAR), CAST(doc_id AS VARCHAR))) AS place
            FROM docs d JOIN budget2 USING (domain, lang, source) WHERE tokens > 0 AND budget > 0)"""
    )
    last = """SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, n_tokens
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ready"""
    columns = "doc_id, domain, lang, source, n_tokens"
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT {columns}, CAST(unnest(range(whole)) AS INTEGER) AS epoch FROM ready"
        f"\nUNION ALL SELECT {columns}, CAST(whole AS INTEGER) AS epoch FROM ({last}) WHERE start < rest"
    )


PRODUCTION = Target(
    domain_of={f"src{k}": ("web" if k < 10 else "reference" if k < 15 else "forum") for k in range(20)},
    weights={
        "domain": {"web": 50, "reference": 30, "forum": 20},
        "lang": {"en": 40, "de": 20, "fr": 20, "es": 20},
        "source": {"src0": 20},
    },
)
