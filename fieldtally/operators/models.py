"""Regressions at table scale: offset models, cluster bootstrap, variance components, subset search."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import RFormula
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import labels
from fieldtally.operators.lineage import cut
from fieldtally.operators.permutation import hash_uint32


def offset_model(
    frame: DataFrame, response: str, terms: Sequence[str], *, offset: Column | None = None
) -> tuple[DataFrame, dict[str, float]]:
    """Gaussian model with an offset: coefficients and fit metrics (R2, AIC)."""
    spark = frame.sparkSession
    shifted = frame.withColumn("_offset", (offset if offset is not None else F.lit(0.0)).cast("double"))
    complete = shifted.select(response, *terms, "_offset").dropna()
    encoder = RFormula(
        formula=f"{response} ~ {' + '.join(terms)}", featuresCol="_x", labelCol="_y",
        stringIndexerOrderType="alphabetDesc",
    )
    encoded = encoder.fit(complete).transform(complete)
    model = GeneralizedLinearRegression(
        family="gaussian", link="identity", featuresCol="_x", labelCol="_y", offsetCol="_offset"
    ).fit(encoded)
    attrs = encoded.schema["_x"].metadata["ml_attr"]["attrs"]
    names = [n for _, n in sorted((a["idx"], a["name"]) for kind in attrs.values() for a in kind)]
    summary = model.summary
    rows = [
        (n, float(e), float(s), float(t), float(p))
        for n, e, s, t, p in zip(
            [*names, "(Intercept)"], [*model.coefficients.toArray(), model.intercept],
            summary.coefficientStandardErrors, summary.tValues, summary.pValues,
        )
    ]
    variance = complete.agg(F.var_pop(F.col(response) - F.col("_offset"))).first()[0]
    n = summary.numInstances
    metrics = {
        "r_squared": 1 - summary.deviance / (variance * n) if variance else float("nan"),
        "aic": float(summary.aic),
        "n": float(n),
    }
    schema = "term string, estimate double, std_error double, t double, p_value double"
    return spark.createDataFrame(rows, schema), metrics


def compare_models(candidates: Sequence[tuple[str, DataFrame, str, Sequence[str], Column | None]]) -> DataFrame:
    """Fit metrics of several candidate models, one row each."""
    rows = []
    for name, frame, response, terms, offset in candidates:
        _, metrics = offset_model(frame, response, terms, offset=offset)
        rows.append((name, metrics["r_squared"], metrics["aic"], int(metrics["n"])))
    spark = candidates[0][1].sparkSession
    return spark.createDataFrame(rows, "model string, r_squared double, aic double, n long")


def design_columns(levels: dict[str, Sequence[str]], numeric: Sequence[str]) -> dict[str, Column]:
    """Intercept, treatment contrasts (first level is the baseline, "None" before all others) and numeric terms."""
    columns: dict[str, Column] = {"(Intercept)": F.lit(1.0)}
    for variable, names in levels.items():
        for level in labels.ordered_levels(names)[1:]:
            columns[f"{variable}{level}"] = F.when(F.col(variable) == level, 1.0).otherwise(0.0)
    for variable in numeric:
        columns[variable] = F.col(variable).cast("double")
    return columns


def _cells(terms: Sequence[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]


def cluster_moments(frame: DataFrame, response: str, design: dict[str, Column], *, cluster: str) -> DataFrame:
    """Cross-products per cluster: `xx` (upper triangle) and `xy`, plus rows and sums of squares."""
    terms = list(design)
    held = frame.where(F.col(response).isNotNull()).select(
        F.col(cluster).alias("cluster"), F.col(response).cast("double").alias("_y"),
        *[design[t].alias(f"_x{i}") for i, t in enumerate(terms)],
    ).dropna()
    x = [F.col(f"_x{i}") for i in range(len(terms))]
    return held.groupBy("cluster").agg(
        F.array(*[F.sum(x[i] * x[j]) for i, j in _cells(terms)]).alias("xx"),
        F.array(*[F.sum(c * F.col("_y")) for c in x]).alias("xy"),
        F.sum(F.col("_y") * F.col("_y")).alias("yy"),
        F.count(F.lit(1)).alias("n"),
    )


def poisson_weight(*parts: Column) -> Column:
    """Poisson(1) count from a hash of the parts: the number of cumulative probabilities passed."""
    uniform = hash_uint32(*parts) / F.lit(2.0**32)
    bounds, total = [], 0.0
    for k in range(12):
        total += math.exp(-1.0) / math.factorial(k)
        bounds.append(total)
    weight = F.lit(len(bounds))
    for k in reversed(range(len(bounds))):
        weight = F.when(uniform < bounds[k], F.lit(k)).otherwise(weight)
    return weight


def bootstrap_moments(moments: DataFrame, design: dict[str, Column], *, n_draws: int, seed: int = 0) -> DataFrame:
    """Cross-products of each bootstrap draw: clusters weighted by Poisson(1) counts."""
    p = len(design)
    weighted = moments.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws)))).withColumn(
        "w", poisson_weight(F.lit(seed), F.col("draw"), F.col("cluster"))
    )
    return weighted.groupBy("draw").agg(
        F.array(*[F.sum(F.col("w") * F.col("xx")[i]) for i in range(p * (p + 1) // 2)]).alias("xx"),
        F.array(*[F.sum(F.col("w") * F.col("xy")[i]) for i in range(p)]).alias("xy"),
        F.sum(F.col("w") * F.col("yy")).alias("yy"),
        F.sum(F.col("w") * F.col("n")).alias("n"),
    )


def bootstrap_draws(
    frame: DataFrame, response: str, design: dict[str, Column], *, cluster: str, n_draws: int = 200, seed: int = 0,
    prefix: str = "b_",
) -> DataFrame:
    """Coefficient draws by cluster bootstrap: `draw, param, value`.

    Data are reduced to cross-products per cluster once; a draw is a weighted sum
    of those, and the solve has as many rows as there are terms.
    """
    terms = list(design)
    cells = _cells(terms)
    p = len(terms)
    moments = cluster_moments(frame, response, design, cluster=cluster)
    summed = bootstrap_moments(moments, design, n_draws=n_draws, seed=seed).select("draw", "xx", "xy")
    names = [f"{prefix}{'Intercept' if t == '(Intercept)' else t}" for t in terms]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, cols = zip(*cells)
        for batch in batches:
            if not len(batch):
                continue
            xx = np.zeros((len(batch), p, p))
            flat = np.array(batch["xx"].tolist(), dtype=float).reshape(len(batch), len(cells))
            xx[:, rows, cols] = flat
            xx[:, cols, rows] = flat
            xy = np.array(batch["xy"].tolist(), dtype=float).reshape(len(batch), p)
            beta = np.einsum("dij,dj->di", np.linalg.pinv(xx), xy)
            yield pd.DataFrame(
                {
                    "draw": np.repeat(batch["draw"].to_numpy(dtype="int64"), p),
                    "param": names * len(batch),
                    "value": beta.ravel(),
                }
            )

    return summed.mapInPandas(solve, "draw long, param string, value double")


def variance_components(frame: DataFrame, response: str, group: str) -> DataFrame:
    """One-way between- and within-group variance by moments (unequal group sizes)."""
    groups = (
        frame.where(F.col(response).isNotNull())
        .groupBy(group)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(response).alias("m"), F.var_pop(response).alias("v"))
    )
    sums = groups.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("n") * F.col("v")).alias("ss_within"),
        F.sum(F.col("n") * F.col("m")).alias("s"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sm"),
    )
    within = F.try_divide(F.col("ss_within"), F.col("n") - F.col("k"))
    between_ms = F.try_divide(F.col("sm") - F.col("s") * F.col("s") / F.col("n"), F.col("k") - 1)
    n0 = F.try_divide(F.col("n") - F.col("nn") / F.col("n"), F.col("k") - 1)
    between = F.greatest(F.try_divide(between_ms - within, n0), F.lit(0.0))
    return sums.select(
        F.lit(group).alias("group_name"), F.col("k").alias("n_groups"),
        F.sqrt(between).alias("sd_between"), F.sqrt(within).alias("sd_within"),
    )


def spread_draws(
    frame: DataFrame, response: str, group: str, *, n_draws: int = 200, seed: int = 0, prefix: str = "sd_"
) -> DataFrame:
    """Bootstrap draws of the between-group deviation: groups weighted by Poisson(1) counts."""
    groups = (
        frame.where(F.col(response).isNotNull())
        .groupBy(F.col(group).cast("string").alias("g"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(response).alias("m"), F.var_pop(response).alias("v"))
        .withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))
        .withColumn("w", poisson_weight(F.lit(seed), F.col("draw"), F.col("g")))
    )
    w, n, m = F.col("w"), F.col("n"), F.col("m")
    sums = groups.groupBy("draw").agg(
        F.sum(w).alias("k"), F.sum(w * n).alias("n"), F.sum(w * n * n).alias("nn"),
        F.sum(w * n * F.col("v")).alias("ssw"), F.sum(w * n * m).alias("s"), F.sum(w * n * m * m).alias("sm"),
    )
    within = F.try_divide(F.col("ssw"), F.col("n") - F.col("k"))
    between_ms = F.try_divide(F.col("sm") - F.try_divide(F.col("s") * F.col("s"), F.col("n")), F.col("k") - 1)
    n0 = F.try_divide(F.col("n") - F.try_divide(F.col("nn"), F.col("n")), F.col("k") - 1)
    between = F.greatest(F.try_divide(between_ms - within, n0), F.lit(0.0))
    return sums.select(
        F.col("draw").cast("long").alias("draw"), F.lit(f"{prefix}{group}").alias("param"), F.sqrt(between).alias("value")
    ).where(F.col("value").isNotNull())


def subset_models(
    frame: DataFrame, response: str, predictors: Sequence[str], *, most_terms: int | None = None
) -> DataFrame:
    """Every subset of predictors up to a size, with AIC and Akaike weight.

    The data are read once, for their cross-products; subsets are then scored in
    parallel from that small matrix. `model` reads `y ~ 1 + a + b`.
    """
    spark = frame.sparkSession
    predictors = list(predictors)
    most = len(predictors) if most_terms is None else min(most_terms, len(predictors))
    design = {"(Intercept)": F.lit(1.0), **{c: F.col(c).cast("double") for c in predictors}}
    totals = cluster_moments(frame.withColumn("_all", F.lit(1)), response, design, cluster="_all").first()
    terms, cells = list(design), _cells(list(design))
    gram = np.zeros((len(terms), len(terms)))
    for (i, j), v in zip(cells, totals["xx"]):
        gram[i, j] = gram[j, i] = v
    xy, yy, n = np.array(totals["xy"]), totals["yy"], totals["n"]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for mask in batch["mask"]:
                chosen = [i for i in range(len(predictors)) if mask >> i & 1]
                idx = [0, *[i + 1 for i in chosen]]
                beta = np.linalg.lstsq(gram[np.ix_(idx, idx)], xy[idx], rcond=None)[0]
                rss = max(yy - float(beta @ xy[idx]), 1e-300)
                aic = n * math.log(rss / n) + n * (1 + math.log(2 * math.pi)) + 2 * (len(idx) + 1)
                model = f"{response} ~ 1" + "".join(f" + {predictors[i]}" for i in chosen)
                out.append((model, len(chosen), aic))
            yield pd.DataFrame(out, columns=["model", "n_terms", "aic"])

    masks = spark.range(2 ** len(predictors)).withColumnRenamed("id", "mask").where(F.bit_count("mask") <= most)
    scored = cut(masks.mapInPandas(score, "model string, n_terms int, aic double"))
    best = scored.agg(F.min("aic")).scalar()
    relative = scored.withColumn("_rel", F.exp(-0.5 * (F.col("aic") - best)))
    total = relative.agg(F.sum("_rel")).scalar()
    return relative.select("model", "n_terms", "aic", (F.col("_rel") / total).alias("weight"))


def formula_terms(models: DataFrame) -> DataFrame:
    """One row per term of each model formula."""
    return models.withColumn("variable", F.explode(F.regexp_extract_all("model", F.lit(r"\+ (\w+)"), F.lit(1))))


def variable_importance(models: DataFrame) -> DataFrame:
    """Sum of the weights of the models that contain each variable."""
    return formula_terms(models).groupBy("variable").agg(F.sum("weight").alias("weight"))
