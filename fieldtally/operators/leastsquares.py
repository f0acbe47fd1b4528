"""Least squares with categories and interactions through merged QR factors.

Each partition is folded into the triangular factor of its design rows, and the factors
are merged as a tree, so cross-products (which square the condition number) are never
formed. Terms that the earlier ones determine are found in the last factor and reported.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import labels, special
from fieldtally.operators.lineage import cut
from fieldtally.operators.ordered import group_quantiles

INTERCEPT = "(Intercept)"
MERGED = (32, 1024)  # partitions whose factors meet in one task, step by step, before the last one
FACTOR = "part long, factor array<double>"
QUARTILES = {"residual_min": 0.0, "residual_q1": 0.25, "residual_median": 0.5, "residual_q3": 0.75, "residual_max": 1.0}


@dataclass
class LinearFit:
    """`coefficients` (one row per term), `summary` (one row), `fitted` (the rows used, with `fitted` and `residual`)."""

    coefficients: DataFrame
    summary: DataFrame
    fitted: DataFrame


def design_of(frame: DataFrame, terms: Sequence[str]) -> dict[str, Column]:
    """Columns of a model: numbers as they are, treatment contrasts of strings and booleans, `a:b` for interactions.

    The first level ("None" before all others) is the baseline of a category.
    """
    kinds = dict(frame.dtypes)
    named = list(dict.fromkeys(part for term in terms for part in term.split(":")))
    categories = [c for c in named if kinds[c] in ("string", "boolean")]
    levels = frame.agg(*[F.collect_set(F.col(c).cast("string")).alias(c) for c in categories]).first() if categories else {}

    def main(name: str) -> dict[str, Column]:
        if name not in categories:
            return {name: F.col(name).cast("double")}
        level = F.col(name).cast("string")
        return {f"{name}{v}": F.when(level == v, 1.0).otherwise(0.0) for v in labels.ordered_levels(levels[name])[1:]}

    design: dict[str, Column] = {INTERCEPT: F.lit(1.0)}
    for term in terms:
        products: dict[str, Column] = {}
        for part in term.split(":"):
            own = main(part)
            products = {f"{a}:{b}": x * y for b, y in own.items() for a, x in products.items()} if products else own
        design.update(products)
    return design


def triangular_factor(rows: DataFrame, columns: Sequence[Column]) -> np.ndarray:
    """Triangular factor of the matrix with these columns; its height is the number of columns, or of rows if fewer."""
    width = len(columns)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = np.zeros((0, width))
        for batch in batches:
            block = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            factor = np.linalg.qr(np.vstack([factor, block]), mode="r") if len(block) else factor
        if len(factor):
            part = pa.array([TaskContext.get().partitionId()], pa.int64())
            yield pa.RecordBatch.from_arrays([part, pa.array([factor.ravel()], pa.list_(pa.float64()))], ["part", "factor"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        stacked = np.vstack([f.reshape(-1, width) for f in group.sort_values("part")["factor"]])
        return pd.DataFrame({"part": [group["part"].min()], "factor": [np.linalg.qr(stacked, mode="r").ravel()]})

    factors = rows.select(F.array(*columns).alias("row")).mapInArrow(fold, FACTOR)
    for span in MERGED:
        factors = factors.groupBy(F.floor(F.col("part") / span)).applyInPandas(merge, FACTOR)
    last = factors.groupBy().applyInPandas(merge, FACTOR).first()
    return np.array(last["factor"]).reshape(-1, width) if last else np.zeros((0, width))


def solve_factor(factor: np.ndarray, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Coefficients (NaN for aliased terms), their unscaled deviations, residual and total sums of squares.

    The last column is the response, the first one the intercept. A term is aliased if what earlier terms
    leave of it is below `tolerance` of its deviation from the mean, or lost in rounding.
    """
    x, y = factor[:, :-1], factor[:, -1]
    basis, kept = np.zeros((len(factor), 0)), []
    for j in range(x.shape[1]):
        left, spread = x[:, j].copy(), 0.0
        for turn in range(2):
            left -= basis @ (basis.T @ left)
            if turn == 0:
                spread = np.linalg.norm(x[:, j] - basis[:, :1] @ (basis[:, :1].T @ x[:, j]))
        size = np.linalg.norm(left)
        if size > tolerance * spread and size > 1e-13 * np.linalg.norm(x[:, j]):
            basis, kept = np.column_stack([basis, left / size]), [*kept, j]
    estimate, deviation = np.full(x.shape[1], np.nan), np.full(x.shape[1], np.nan)
    if kept:
        inverse = np.linalg.inv(basis.T @ x[:, kept])
        estimate[kept], deviation[kept] = inverse @ (basis.T @ y), np.sqrt((inverse**2).sum(axis=1))
    rest = y - basis @ (basis.T @ y)
    rest -= basis @ (basis.T @ rest)
    about_mean = y - basis[:, :1] @ (basis[:, :1].T @ y)
    return estimate, deviation, float(rest @ rest), float(about_mean @ about_mean)


def _or_none(value: float) -> float | None:
    return float(value) if np.isfinite(value) else None


def least_squares(frame: DataFrame, response: str, terms: Sequence[str]) -> LinearFit:
    """Fit of `response` on an intercept and `terms` (columns, or `a:b` for interactions).

    Rows with a missing or infinite value are left out. Aliased terms have `aliased` true and NULL
    estimates. Statistics without residual freedom or variation are NULL; without rows all are.
    """
    spark = frame.sparkSession
    used = list(dict.fromkeys([response, *[part for term in terms for part in term.split(":")]]))
    held = frame.dropna(subset=used)
    for name, kind in frame.select(*used).dtypes:
        if kind not in ("string", "boolean"):
            held = held.where(F.abs(F.col(name).cast("double")) < float("inf"))
    complete = cut(held)
    design, y = design_of(complete, terms), F.col(response).cast("double")
    names = list(design)
    n = complete.count()
    estimate, deviation, rss, tss = solve_factor(triangular_factor(complete, [*design.values(), y]))
    known = np.isfinite(estimate)
    rank = int(known.sum())
    free, model_df = n - rank, rank - 1
    sigma = (rss / free) ** 0.5 if free > 0 else float("nan")

    rows = [(t, _or_none(b), _or_none(sigma * s), bool(not ok)) for t, b, s, ok in zip(names, estimate, deviation, known)]
    table = spark.createDataFrame(rows, "term string, estimate double, std_error double, aliased boolean")
    t = F.try_divide(F.col("estimate"), F.col("std_error"))
    coefficients = table.withColumn("t", t).withColumn("p_value", special.student_t_p(F.col("t"), F.lit(free)))

    fitted = sum((design[t] * F.lit(float(b)) for t, b, ok in zip(names, estimate, known) if ok), F.lit(0.0))
    rows_used = complete.withColumn("fitted", fitted).withColumn("residual", y - F.col("fitted"))
    r2 = 1 - rss / tss if tss > 0 else float("nan")
    adjusted = 1 - (1 - r2) * (n - 1) / free if free > 0 else float("nan")
    f = ((tss - rss) / model_df) / sigma**2 if model_df > 0 and sigma > 0 else float("nan")
    one = spark.createDataFrame(
        [(n, rank, len(names) - rank, free, *[_or_none(v) for v in (r2, adjusted, sigma, f)])],
        "n long, rank int, n_aliased int, df_residual long, r_squared double, adj_r_squared double, sigma double, f_statistic double",
    )
    quartiles = group_quantiles(rows_used, value="residual", quantiles=QUARTILES)
    tested = one.withColumn("p_value", special.f_p(F.col("f_statistic"), F.lit(model_df), F.col("df_residual")))
    summary = tested.withColumn("_q", quartiles.select(F.struct("*")).scalar()).select("*", "_q.*").drop("_q")
    return LinearFit(coefficients, summary, rows_used)
