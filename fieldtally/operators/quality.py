"""Key checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class DuplicateKeyError(ValueError):
    """A table that should have one row per key has more."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def require_unique(df: DataFrame, keys: Sequence[str], *, table: str, shown: int = 5) -> DataFrame:
    """Return `df`, or raise naming a few offending keys."""
    offending = duplicate_keys(df, keys).orderBy(*keys).limit(shown).collect()
    if offending:
        sample = ", ".join(str(tuple(row[k] for k in keys)) for row in offending)
        raise DuplicateKeyError(f"{table}: several rows per {', '.join(keys)}: {sample}")
    return df


def key_report(checks: Sequence[tuple[str, DataFrame, Sequence[str]]]) -> DataFrame:
    """All duplicate keys of several tables: `table_name, key_columns, key_value, n_rows`."""
    parts = [
        duplicate_keys(df, keys).select(
            F.lit(table).alias("table_name"),
            F.lit(",".join(keys)).alias("key_columns"),
            F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("NA")) for k in keys]).alias("key_value"),
            "n_rows",
        )
        for table, df, keys in checks
    ]
    return reduce(DataFrame.unionByName, parts)


def unpaired_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of `left` that have no partner in `right`."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")
