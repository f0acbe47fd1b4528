"""Correlation, regression and covariance summaries."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.ml.feature import RFormula
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import numbers, special
from fieldtally.operators.lineage import cut
from fieldtally.operators.ordered import average_ranks


def _finish(pairs: DataFrame) -> DataFrame:
    """Add the two-sided p-value of a correlation from its t statistic (0 for a perfect one)."""
    r, n = F.col("r"), F.col("n")
    perfect = F.abs(r) > 1 - 1e-12
    t = r * F.sqrt(F.try_divide((n - 2).cast("double"), 1 - r * r))
    p = special.student_t_p(F.when((n > 2) & ~perfect, t), n - 2)
    return pairs.withColumn("p_value", F.when((n > 2) & perfect, F.lit(0.0)).otherwise(p))


def _pearson_of(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """All correlations from one aggregation; rows missing either value do not count."""
    measured = df.agg(
        *[numbers.correlation_of(F.col(a), F.col(b)).alias(f"r_{i}") for i, (a, b) in enumerate(pairs)],
        *[
            F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias(f"n_{i}")
            for i, (a, b) in enumerate(pairs)
        ],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("col_1"), F.lit(b).alias("col_2"),
                F.col(f"n_{i}").alias("n"), F.col(f"r_{i}").alias("r"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return measured.select(F.inline(rows))


def correlation(df: DataFrame, columns: Sequence[str], *, method: str = "pearson", p_values: bool = True) -> DataFrame:
    """Pairwise-complete correlations: `col_1, col_2, n, r[, p_value]`.

    Spearman ranks each column anew among the rows complete for the pair. Rows
    become (pair, a, b) with equal rows counted, and the ranks come from
    distributed tie counts, so no column is sorted in one task.
    """
    pairs = list(combinations(columns, 2))
    if method == "pearson":
        measured = _pearson_of(df.select([F.col(c).cast("double").alias(c) for c in columns]), pairs)
    elif method == "spearman":
        measured = _spearman(df, pairs)
    else:
        raise ValueError(f"unknown correlation method: {method}")
    return _finish(measured) if p_values else measured


def _spearman(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("col_1"), F.lit(b).alias("col_2"),
                F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"),
            )
            for a, b in pairs
        ]
    )
    keys = ["col_1", "col_2"]
    counted = cut(
        df.select(F.inline(rows))
        .where("a IS NOT NULL AND b IS NOT NULL")
        .groupBy(*keys, "a", "b")
        .agg(F.count(F.lit(1)).alias("w"))
    )

    def ranks(side: str) -> DataFrame:
        values = counted.groupBy(*keys, side).agg(F.sum("w").alias("w"))
        return average_ranks(values, by=keys, value=side, name=f"rank_{side}", weight="w").drop("n_ties")

    ranked = counted.join(ranks("a"), [*keys, "a"]).join(ranks("b"), [*keys, "b"])
    x, y, w = F.col("rank_a"), F.col("rank_b"), F.col("w")
    sums = ranked.groupBy(*keys).agg(
        F.sum("w").alias("n"),
        F.sum(w * x).alias("_x"), F.sum(w * y).alias("_y"),
        F.sum(w * x * x).alias("_xx"), F.sum(w * y * y).alias("_yy"), F.sum(w * x * y).alias("_xy"),
    )
    n = F.col("n")
    cov = F.col("_xy") - F.col("_x") * F.col("_y") / n
    spread = (F.col("_xx") - F.col("_x") * F.col("_x") / n) * (F.col("_yy") - F.col("_y") * F.col("_y") / n)
    return sums.select(*keys, "n", F.try_divide(cov, F.sqrt(F.greatest(spread, F.lit(0.0)))).alias("r"))


def simple_regression(df: DataFrame, response: str, predictor: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Intercept, slope, R2 and slope test of a one-predictor regression."""
    y, x = F.col(response), F.col(predictor)
    fitted = df.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_r2(y, x).alias("r_squared"),
        F.regr_syy(y, x).alias("_syy"),
        F.regr_sxx(y, x).alias("_sxx"),
    )
    residual = F.col("_syy") * (1 - F.col("r_squared"))
    sigma = F.sqrt(F.try_divide(residual, F.col("n") - 2))
    se = F.try_divide(sigma, F.sqrt("_sxx"))
    return fitted.withColumns({"slope_se": se, "t": F.try_divide(F.col("slope"), se)}).drop("_syy", "_sxx")


def ols(df: DataFrame, response: str, terms: Sequence[str]) -> tuple[DataFrame, dict[str, float]]:
    """Least squares with categorical terms: coefficient table and fit summary.

    The first level of a category is its baseline. Rows with a missing value
    are left out. Only the coefficient vector comes to the driver.
    """
    spark = df.sparkSession
    complete = df.select(response, *terms).dropna()
    encoder = RFormula(
        formula=f"{response} ~ {' + '.join(terms)}", featuresCol="_x", labelCol="_y",
        stringIndexerOrderType="alphabetDesc",
    )
    encoded = encoder.fit(complete).transform(complete)
    model = LinearRegression(featuresCol="_x", labelCol="_y", solver="normal").fit(encoded)
    summary = model.summary
    attrs = encoded.schema["_x"].metadata["ml_attr"]["attrs"]
    names = sorted((a["idx"], a["name"]) for kind in attrs.values() for a in kind)
    terms_out = [name for _, name in names] + ["(Intercept)"]
    estimates = [*model.coefficients.toArray(), model.intercept]
    rows = [
        (t, float(e), float(s), float(v), float(p))
        for t, e, s, v, p in zip(
            terms_out, estimates, summary.coefficientStandardErrors, summary.tValues, summary.pValues
        )
    ]
    k, dof = len(rows) - 1, summary.degreesOfFreedom
    r2 = summary.r2
    fit = {
        "r_squared": r2,
        "adj_r_squared": summary.r2adj,
        "sigma": float((summary.meanSquaredError * summary.numInstances / dof) ** 0.5),
        "df_residual": float(dof),
        "f_statistic": float((r2 / k) / ((1 - r2) / dof)) if k and r2 < 1 else float("nan"),
        "n": float(summary.numInstances),
    }
    schema = "term string, estimate double, std_error double, t double, p_value double"
    return spark.createDataFrame(rows, schema), fit


def regression_moments(df: DataFrame, response: str, predictors: Sequence[str]) -> DataFrame:
    """Cross-product sums of a regression (upper triangle, intercept first) in one pass."""
    complete = df.select(response, *predictors).dropna()
    columns = {"(Intercept)": F.lit(1.0), **{c: F.col(c).cast("double") for c in (*predictors, response)}}
    names = list(columns)
    cells = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    measured = complete.agg(*[F.sum(columns[a] * columns[b]).alias(f"m_{i}") for i, (a, b) in enumerate(cells)])
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("term_1"), F.lit(b).alias("term_2"), F.col(f"m_{i}").alias("total"))
            for i, (a, b) in enumerate(cells)
        ]
    )
    return measured.select(F.inline(rows))


def group_means(df: DataFrame, value: str, *, by: Sequence[str]) -> DataFrame:
    """Mean with its standard error per group (the intercept-only model)."""
    return df.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("std_error"),
    )


def group_ellipses(df: DataFrame, x: str, y: str, *, by: Sequence[str], fewest: int = 4) -> DataFrame:
    """Centre and covariance of two scores per category, flagging categories too small for an ellipse."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"),
        F.var_samp(x).alias("var_x"), F.var_samp(y).alias("var_y"), F.covar_samp(x, y).alias("cov_xy"),
    ).withColumn("enough_points", F.col("n") >= fewest)
