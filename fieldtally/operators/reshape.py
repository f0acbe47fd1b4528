"""Long and wide forms, grids and column selection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC_KINDS = ("double", "float", "int", "bigint", "smallint", "tinyint")


def columns_like(df: DataFrame, *, prefix: str | None = None, numeric: bool = False) -> list[str]:
    """Column names by prefix and/or by numeric type, in table order."""
    return [
        name
        for name, kind in df.dtypes
        if (prefix is None or name.startswith(prefix))
        and (not numeric or kind in NUMERIC_KINDS or kind.startswith("decimal"))
    ]


def columns_between(df: DataFrame, first: str, last: str) -> list[str]:
    return df.columns[df.columns.index(first) : df.columns.index(last) + 1]


def prefix_last(df: DataFrame, prefix: str) -> DataFrame:
    """Move the columns that start with `prefix` to the end."""
    moved = columns_like(df, prefix=prefix)
    return df.select(*[c for c in df.columns if c not in moved], *moved)


def level_list(df: DataFrame, column: str, *, limit: int) -> list[str]:
    """Sorted distinct levels, refused beyond `limit` since each becomes a column."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} levels: keep the table long")
    return sorted(row[0] for row in rows)


def only_value(column: str) -> Column:
    """Aggregate: the value of a group's single row; an error where there are several."""
    several = F.raise_error(F.lit(f"several rows for one cell of {column}"))
    return F.when(F.count(F.lit(1)) > 1, several).otherwise(F.max(column))


def to_wide(
    df: DataFrame,
    *,
    keys: Sequence[str],
    names: str,
    values: str,
    levels: Sequence[str],
    fill: float | None = 0.0,
) -> DataFrame:
    """One column per given level of `names`; several rows for one cell are an error."""
    levels = list(levels)
    wide = df.groupBy(*keys).pivot(names, levels).agg(only_value(values))
    return wide if fill is None else wide.fillna(fill, subset=levels)


def to_long(df: DataFrame, *, keys: Sequence[str], columns: Sequence[str], names: str, values: str) -> DataFrame:
    return df.unpivot(list(keys), list(columns), names, values)


def levels_array(df: DataFrame, column: str) -> Column:
    """All distinct levels of a column, NULL too, as one array of structs (a scalar subquery)."""
    return df.select(column).distinct().agg(F.array_sort(F.collect_list(F.struct(F.col(column).alias("level"))))).scalar()


def full_grid(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Every combination of observed levels; NULL is a level where it occurs.

    The first dimension stays distributed as rows; the others are exploded from
    arrays of their levels. The output is as large as the grid asked for.
    """
    grid = df.select(dimensions[0]).distinct()
    for name in dimensions[1:]:
        grid = grid.withColumn(name, F.explode(levels_array(df, name))).withColumn(name, F.col(name)["level"])
    return grid


def complete_counts(df: DataFrame, dimensions: Sequence[str], *, name: str = "n") -> DataFrame:
    """Row count for every combination of levels, zero where none was seen."""
    counts = df.groupBy(*dimensions).agg(F.count(F.lit(1)).alias(name))
    seen = counts.select(*[F.col(c).alias(f"_{c}") for c in dimensions], name)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in dimensions]
    filled = full_grid(counts, dimensions).join(seen, reduce(and_, same), "left")
    return filled.select(*dimensions, F.coalesce(F.col(name), F.lit(0)).alias(name))


def monthly_change_table(catch_full: DataFrame) -> DataFrame:
    """Log counts per site, flood year, month and species (long form of the change matrices)."""
    return catch_full.select("month", "year_s", "refuge", "species", F.log1p("count").alias("log_count"))
