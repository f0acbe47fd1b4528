"""Principal components and correspondence analysis."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import numbers
from fieldtally.operators.lineage import cut
from fieldtally.operators.ordered import with_position


@dataclass
class Ordination:
    """Axis variances, variable (column) coordinates and row scores."""

    axes: DataFrame
    variables: DataFrame
    scores: DataFrame
    n_axes: int


def mean_imputed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace missing values by the column mean."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns])).scalar()
    held = df.withColumn("_means", means)
    return held.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_means.{c}")) for c in columns}).drop("_means")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlations of mean-imputed columns, upper triangle with the diagonal."""
    filled = mean_imputed(df, columns)
    cells = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    measured = filled.agg(*[numbers.correlation_of(F.col(a), F.col(b)).alias(f"r_{i}") for i, (a, b) in enumerate(cells)])
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("col_1"), F.lit(b).alias("col_2"), F.col(f"r_{i}").alias("r"))
            for i, (a, b) in enumerate(cells)
        ]
    )
    return measured.select(F.inline(rows))


def _fixed_signs(vectors: np.ndarray) -> np.ndarray:
    """Make the largest absolute entry of each axis positive."""
    largest = np.abs(vectors).argmax(axis=0)
    return vectors * np.sign(vectors[largest, range(vectors.shape[1])])


def pca(df: DataFrame, columns: Sequence[str], *, n_axes: int = 5, keep: Sequence[str] = ()) -> Ordination:
    """Components of standardised, mean-imputed columns (population deviation).

    Means, deviations and correlations are aggregated on the cluster; the
    eigenproblem has as many rows as there are columns, and the scores are column
    arithmetic. Columns that do not vary are left out.
    """
    spark = df.sparkSession
    columns = list(columns)
    filled = cut(mean_imputed(df, columns).select(*keep, *[c for c in columns if c not in keep]))
    row = filled.agg(
        F.array(*[F.avg(c) for c in columns]).alias("mean"),
        F.array(*[F.stddev_pop(c) for c in columns]).alias("sd"),
    ).first()
    varying = [i for i, s in enumerate(row["sd"]) if s]
    vectors_of = VectorAssembler(inputCols=[columns[i] for i in varying], outputCol="_x")
    matrix = Correlation.corr(vectors_of.transform(filled).select("_x"), "_x").first()[0].toArray()
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], _fixed_signs(vectors[:, order])
    k = min(n_axes, len(varying))

    axes = spark.createDataFrame(
        [(i + 1, float(v), float(v / values.sum())) for i, v in enumerate(values)],
        "axis int, eigenvalue double, share double",
    )
    variables = spark.createDataFrame(
        [
            (columns[c], a + 1, float(vectors[pos, a]), float(vectors[pos, a] * np.sqrt(max(values[a], 0.0))))
            for pos, c in enumerate(varying)
            for a in range(k)
        ],
        "variable string, axis int, loading double, coordinate double",
    )

    def score(axis: int):
        terms = [
            (F.col(columns[c]) - F.lit(row["mean"][c])) * F.lit(float(vectors[pos, axis] / row["sd"][c]))
            for pos, c in enumerate(varying)
        ]
        return sum(terms[1:], terms[0]).alias(f"dim_{axis + 1}")

    scores = filled.select(*keep, *[score(a) for a in range(k)])
    return Ordination(axes, variables, scores, k)


def supplementary_numeric(scores: DataFrame, columns: Sequence[str], *, n_axes: int) -> DataFrame:
    """Correlation of each extra numeric column with each axis."""
    cells = [(c, a) for c in columns for a in range(1, n_axes + 1)]
    measured = scores.agg(*[numbers.correlation_of(F.col(c), F.col(f"dim_{a}")).alias(f"r_{i}") for i, (c, a) in enumerate(cells)])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("variable"), F.lit(a).alias("axis"), F.col(f"r_{i}").alias("coordinate"))
            for i, (c, a) in enumerate(cells)
        ]
    )
    return measured.select(F.inline(rows))


def supplementary_categories(
    scores: DataFrame, columns: Sequence[str], *, n_axes: int, weight: str | None = None
) -> DataFrame:
    """(Weighted) mean score of each level of each extra category."""
    axes = [f"dim_{a}" for a in range(1, n_axes + 1)]
    w = F.col(weight) if weight else F.lit(1.0)
    long = scores.select(
        *axes, w.alias("_w"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in columns])),
    )
    return long.groupBy("variable", "level").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.try_divide(F.sum(F.col(a) * F.col("_w")), F.sum("_w")).alias(a) for a in axes],
    )


def total_inertia(cells: DataFrame, *, rows: Sequence[str], column: str, value: str) -> DataFrame:
    """Inertia of a contingency table (chi-squared over n) from its non-empty cells."""
    filled = cells.where(F.col(value) > 0).groupBy(*rows, column).agg(F.sum(value).alias("_x"))
    row_mass = filled.groupBy(*rows).agg(F.sum("_x").alias("_r"))
    column_mass = filled.groupBy(column).agg(F.sum("_x").alias("_c"))
    share = F.col("_x") * F.col("_x") / (F.col("_r") * F.col("_c"))
    return (
        filled.join(row_mass, list(rows))
        .join(column_mass, column)
        .agg((F.sum(share) - 1).alias("inertia"), F.sum("_x").alias("total"), F.count(F.lit(1)).alias("n_cells"))
        .withColumn("chi_squared", F.col("inertia") * F.col("total"))
    )


def correspondence(cells: DataFrame, *, rows: Sequence[str], column: str, value: str, n_axes: int = 2) -> Ordination:
    """Correspondence analysis of long, sparse counts.

    The sparse matrix of p / sqrt(r c) has the trivial singular value 1; its other
    singular vectors are those of the centred table, so zeros never need to be
    stored. Row coordinates follow from the column coordinates by averaging.
    """
    spark = cells.sparkSession
    keys = list(rows)
    filled = cut(
        cells.where(F.col(value) > 0).groupBy(*keys, column).agg(F.sum(value).cast("double").alias("_x"))
    )
    row_mass = filled.groupBy(*keys).agg(F.sum("_x").alias("_r"))
    column_mass = cut(with_position(filled.groupBy(column).agg(F.sum("_x").alias("_c")), "_j", order=[column]))
    width = column_mass.count()
    total = filled.agg(F.sum("_x")).first()[0]

    joined = filled.join(row_mass, keys).join(column_mass, column)
    scaled = joined.groupBy(*keys).agg(
        F.sort_array(
            F.collect_list(F.struct(F.col("_j").cast("int").alias("j"), (F.col("_x") / F.sqrt(F.col("_r") * F.col("_c"))).alias("z")))
        ).alias("cells")
    )
    vectors = scaled.select("cells.j", "cells.z").rdd.map(lambda r: Vectors.sparse(width, r[0], r[1]))
    svd = RowMatrix(vectors, 0, width).computeSVD(min(n_axes + 1, width), computeU=False)
    values = svd.s.toArray()[1:]
    basis = _fixed_signs(svd.V.toArray()[:, 1:])
    k = len(values)

    masses = column_mass.select(column, "_j", (F.col("_c") / F.lit(float(total))).alias("mass"))
    loadings = spark.createDataFrame(
        [(j, *[float(v) for v in basis[j] * values]) for j in range(width)],
        "_j long, " + ", ".join(f"_v{a} double" for a in range(k)),
    )
    variables = masses.join(loadings, "_j").select(
        column, "mass", *[(F.col(f"_v{a}") / F.sqrt("mass")).alias(f"dim_{a + 1}") for a in range(k)]
    )
    axes = spark.createDataFrame([(a + 1, float(v * v)) for a, v in enumerate(values)], "axis int, eigenvalue double")
    profile = F.col("_x") / F.col("_r")
    scores = (
        filled.join(row_mass, keys)
        .join(variables, column)
        .groupBy(*keys)
        .agg(
            (F.sum("_x") / F.lit(float(total))).alias("mass"),
            *[(F.sum(profile * F.col(f"dim_{a + 1}")) / F.lit(float(values[a]))).alias(f"dim_{a + 1}") for a in range(k)],
        )
    )
    return Ordination(axes, variables, scores, k)
