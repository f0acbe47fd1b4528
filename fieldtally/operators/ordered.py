"""Running totals, ranks and quantiles over a global order, without a global window.

A window with no partition (or one partition per hot group) puts all rows on
one task. Here rows are range-partitioned, whatever their number: each range is
a window partition of its own and only the per-range totals (at most one row per
group and range) are accumulated across ranges. Any contiguous ranges give the
same result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.operators.lineage import cut


def split_ranges(df: DataFrame, keys: Sequence[str], *, ranges: int | None = None) -> DataFrame:
    """Add `_range`: contiguous, balanced pieces of the order given by `keys`, as many as shuffle partitions.

    Written once the rows are range-partitioned, so every later branch, and every
    retried task, sees the same ranges.
    """
    pieces = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(pieces, *[F.col(k) for k in keys])
    return cut(spread.withColumn("_range", F.spark_partition_id()))


def _join_ranges(ranged: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null groups are groups too."""
    renamed = offsets.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in offsets.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return ranged.join(renamed, same).drop(*[f"_key_{k}" for k in keys])


def add_running(
    df: DataFrame,
    *,
    order: Sequence[str],
    by: Sequence[str] = (),
    sums: Mapping[str, str] | None = None,
    maxima: Mapping[str, str | Column] | None = None,
    totals: Mapping[str, str] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Running values along `order`, restarted for every `by` group.

    `sums` gives totals of the rows before the current one (0 for the first),
    `totals` the group total, `maxima` the largest value up to and including the
    current one. Each maps a new column to its source; the source of a maximum may
    use sums and totals. `by` + `order` must identify a row.
    """
    sums, maxima, totals = dict(sums or {}), dict(maxima or {}), dict(totals or {})
    ranged = split_ranges(df, [*by, *order], ranges=ranges)
    keys = [*by, "_range"]
    before = Window.partitionBy(*[F.col(b) for b in by]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*[F.col(b) for b in by])
    within = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(*order)
    placed = ranged
    if sums or totals:
        parts = ranged.groupBy(*keys).agg(*[F.sum(src).alias(f"_s_{new}") for new, src in {**sums, **totals}.items()])
        offsets = parts.select(
            *keys,
            *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
            *[F.sum(f"_s_{n}").over(whole).alias(n) for n in totals],
        )
        earlier = within.rowsBetween(Window.unboundedPreceding, -1)
        placed = _join_ranges(ranged, offsets, keys).select(
            *ranged.columns,
            *totals,
            *[(F.col(f"_o_{n}") + F.coalesce(F.sum(src).over(earlier), F.lit(0))).alias(n) for n, src in sums.items()],
        )
    if maxima:
        placed = placed.select(*placed.columns, *[(F.col(src) if isinstance(src, str) else src).alias(f"_v_{n}") for n, src in maxima.items()])
        parts = placed.groupBy(*keys).agg(*[F.max(f"_v_{n}").alias(f"_m_{n}") for n in maxima])
        offsets = parts.select(*keys, *[F.max(f"_m_{n}").over(before).alias(f"_o_{n}") for n in maxima])
        so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = _join_ranges(placed, offsets, keys).select(
            *[c for c in placed.columns if not c.startswith("_v_")],
            *[F.greatest(F.col(f"_o_{n}"), F.max(f"_v_{n}").over(so_far)).alias(n) for n in maxima],
        )
    return placed.select(*df.columns, *totals, *sums, *maxima)


def with_position(df: DataFrame, name: str, *, order: Sequence[str], by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Zero-based position of each row along a unique order."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    return add_running(ones, order=order, by=by, sums={name: "_one"}, ranges=ranges).drop("_one")


def group_quantiles(
    df: DataFrame, *, by: Sequence[str] = (), value: str, quantiles: Mapping[str, float], ranges: int | None = None
) -> DataFrame:
    """Exact interpolated quantiles per group, one column each.

    Same definition as `percentile`, whose buffer holds a whole group in one
    task; here equal values are counted first and a hot group spans many ranges.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = add_running(counts, by=by, order=[value], sums={"_before": "_n"}, totals={"_total": "_n"}, ranges=ranges)

    def at(position: Column) -> Column:
        inside = (F.col("_before") <= position) & (position < F.col("_before") + F.col("_n"))
        return F.max(F.when(inside, F.col(value)))

    picks, out = [], []
    for i, (name, p) in enumerate(quantiles.items()):
        target = (F.col("_total") - 1) * F.lit(float(p))
        picks += [
            at(F.floor(target)).alias(f"_lo{i}"),
            at(F.ceil(target)).alias(f"_hi{i}"),
            F.max(target - F.floor(target)).alias(f"_w{i}"),
        ]
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((low + (high - low) * F.col(f"_w{i}")).alias(name))
    return ranked.groupBy(*by).agg(*picks).select(*by, *out)


def average_ranks(df: DataFrame, *, by: Sequence[str] = (), value: str, name: str = "rank", weight: str | None = None, ranges: int | None = None) -> DataFrame:
    """One row per distinct value with its tie-averaged rank and count.

    `weight` holds the number of rows each row stands for, if rows were counted before.
    """
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(rows.alias("n_ties"))
    ranked = add_running(counts, by=by, order=[value], sums={"_before": "n_ties"}, ranges=ranges)
    return ranked.select(*by, value, "n_ties", (F.col("_before") + (F.col("n_ties") + 1) / 2).alias(name))


def add_rank(df: DataFrame, name: str, *, order: Sequence[str], by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Row number from 1 along a unique ascending order."""
    placed = with_position(df, name, order=order, by=by, ranges=ranges)
    return placed.withColumn(name, (F.col(name) + 1).cast("long"))
