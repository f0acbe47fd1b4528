"""CSV in and out, and named datasets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.functions.text import normalise_headers

# Tokens that mean "missing" in the raw file.
NA_TOKENS = ("", "NA", "#VALUE!")


def _header(spark: SparkSession, path: str, encoding: str, sep: str) -> list[str]:
    """Raw header names of a CSV file or folder, exactly as written."""
    first = spark.read.option("encoding", encoding).option("sep", sep).option("header", False).csv(path).first()
    if first is None:
        raise ValueError(f"no header line in {path}")
    return [(name or "") for name in first]


def read_survey_csv(
    spark: SparkSession,
    path: str,
    *,
    types: Mapping[str, str] | None = None,
    na_tokens: Sequence[str] = NA_TOKENS,
    encoding: str = "ISO-8859-1",
    sep: str = ",",
) -> DataFrame:
    """Read a survey CSV with snake-case headers and several missing-value tokens.

    The CSV reader knows one null token only, so every column is read as text,
    the tokens become NULL, and `types` (header -> SQL type) is applied with a
    cast that yields NULL for malformed values.
    """
    names = normalise_headers(_header(spark, path, encoding, sep))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    text = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("encoding", encoding)
        .option("sep", sep)
        .csv(path)
    )
    types = dict(types or {})
    tokens = [t for t in na_tokens]

    def parsed(name: str):
        value = F.col(name)
        present = F.when(~value.isin(*tokens), value)
        wanted = types.get(name)
        return (present.try_cast(wanted) if wanted else present).alias(name)

    return text.select(*[parsed(n) for n in names])


def write_report_csv(df: DataFrame, path: str, *, single_file: bool = False) -> None:
    """Write a result as CSV; ask for one file only for small summaries."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)


def save_dataset(df: DataFrame, root: str, name: str, *, partition_by: Sequence[str] = ()) -> DataFrame:
    """Store a named result and return it read back, which also cuts its lineage."""
    target = f"{root.rstrip('/')}/{name}"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(target)
    return df.sparkSession.read.parquet(target)


def load_dataset(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")
