"""Variance components of several crossed or nested factors, estimated together by moments.

Unadjusted sums of squares of every factor are set equal to their expectations
(Henderson's first method). Those need only how many rows each pair of levels
shares, so the data are reduced once to one row per combination of levels and
then to one small matrix; no design matrix is built.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.operators.models import poisson_weight

RESIDUAL = "residual"


def level_cells(frame: DataFrame, response: str, factors: Sequence[str]) -> DataFrame:
    """Rows, mean and spread of each combination of levels; rows without response or a level are left out."""
    held = frame.select(F.col(response).cast("double").alias("_y"), *[F.col(f).cast("string").alias(f"_f{i}") for i, f in enumerate(factors)]).dropna()
    return held.groupBy(*[f"_f{i}" for i in range(len(factors))]).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_y").alias("_m"), F.var_pop("_y").alias("_v")
    )


def crossed_moments(cells: DataFrame, n_factors: int, *, weight: Column | None = None, cluster: int | None = None, draws: bool = False) -> DataFrame:
    """One row per draw and ordered pair of factors: `k` (expected rows shared), and for a pair of one factor
    its `levels`, `ss` (sum of squares of level sums over sizes) and `sizes2` (sum of squared sizes).

    `weight` repeats whole levels of the factor `cluster`: its copies are levels of their own,
    while other factors keep their levels and gain rows.
    """
    by = ["_draw"] if draws else []
    w = weight if weight is not None else F.lit(1)
    weighted = cells.withColumn("_w", w).where("_w > 0")

    def pair(f: int, g: int) -> Column:
        copied = cluster in (f, g)
        rows = F.col("_n") if copied else F.col("_w") * F.col("_n")
        return F.struct(
            F.lit(f).alias("f"), F.lit(g).alias("g"), F.col(f"_f{f}").alias("a"), F.col(f"_f{g}").alias("b"),
            rows.cast("double").alias("n"), (rows * F.col("_m")).alias("s"), (F.col("_w") if copied else F.lit(1)).cast("double").alias("copies"),
        )

    pairs = F.array(*[pair(f, g) for f in range(n_factors) for g in range(n_factors)])
    shared = weighted.select(*by, F.inline(pairs)).groupBy(*by, "f", "g", "a", "b").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("copies").alias("copies")
    )
    # copies of a level of g lie side by side within a level of f; copies of a level of f are levels of their own
    inner = F.when((F.col("f") != F.col("g")) & (F.col("g") == F.lit(-1 if cluster is None else cluster)), F.col("copies")).otherwise(1.0)
    outer = F.when(F.col("f") == F.lit(-1 if cluster is None else cluster), F.col("copies")).otherwise(1.0)
    per_level = shared.groupBy(*by, "f", "g", "a").agg(
        F.sum(inner * F.col("n") * F.col("n")).alias("n2"), F.sum(inner * F.col("n")).alias("n"), F.sum(inner * F.col("s")).alias("s"), F.max(outer).alias("copies")
    )
    c, n = F.col("copies"), F.col("n")
    return per_level.groupBy(*by, "f", "g").agg(
        F.sum(c * F.col("n2") / n).alias("k"), F.sum(c).alias("levels"),
        F.sum(c * F.col("s") * F.col("s") / n).alias("ss"), F.sum(c * n * n).alias("sizes2"),
    )


def solve_components(moments: pd.DataFrame, n: float, total: float, total2: float) -> tuple[np.ndarray, np.ndarray]:
    """Variances of the factors and the residual, and the numbers of levels; NaN where the factors cannot be told apart."""
    p = int(moments["f"].max()) + 1
    k, own = np.zeros((p, p)), moments[moments["f"] == moments["g"]].sort_values("f")
    k[moments["f"], moments["g"]] = moments["k"]
    mean_part, of_mean = total * total / n, own["sizes2"].to_numpy() / n
    levels = own["levels"].to_numpy()
    left = np.zeros((p + 1, p + 1))
    left[:p, :p], left[:p, p] = k - of_mean, levels - 1
    left[p, :p], left[p, p] = n - of_mean, n - 1
    right = np.append(own["ss"].to_numpy() - mean_part, total2 - mean_part)
    if np.linalg.matrix_rank(left) <= p:
        return np.full(p + 1, np.nan), levels
    return np.linalg.solve(left, right), levels


def _components(cells: DataFrame, factors: Sequence[str], weight: Column | None, cluster: int | None, draws: bool) -> DataFrame:
    by = ["_draw"] if draws else []
    names, p = [*factors, RESIDUAL], len(factors)
    w = weight if weight is not None else F.lit(1)
    rows = w * F.col("_n")
    totals = cells.groupBy(*by).agg(F.sum(rows).alias("_rows"), F.sum(rows * F.col("_m")).alias("_sum"), F.sum(rows * (F.col("_v") + F.col("_m") * F.col("_m"))).alias("_sum2"))
    moments = crossed_moments(cells, p, weight=weight, cluster=cluster, draws=draws)
    together = moments.join(totals, by) if draws else moments.withColumn("_totals", totals.select(F.struct("*")).scalar()).select("*", "_totals.*")

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[0]
        variances, levels = solve_components(part, float(first["_rows"]), float(first["_sum"]), float(first["_sum2"]))
        return pd.DataFrame({
            "draw": int(first["_draw"]) if draws else 0, "component": names, "n_levels": [int(x) for x in levels] + [int(first["_rows"])],
            "variance": [None if np.isnan(v) else float(v) for v in variances],
        })

    out = together.groupBy(*by).applyInPandas(solve, "draw long, component string, n_levels long, variance double")
    return out.withColumn("sd", F.sqrt(F.greatest("variance", F.lit(0.0))))


def _centred(frame: DataFrame, response: str, factors: Sequence[str]) -> DataFrame:
    """Cells around the overall mean, so that sums of squares lose no digits."""
    cells = level_cells(frame, response, factors)
    overall = cells.agg(F.try_divide(F.sum(F.col("_n") * F.col("_m")), F.sum("_n")).alias("_overall"))
    return cells.withColumn("_m", F.col("_m") - overall.scalar())


def crossed_components(frame: DataFrame, response: str, factors: Sequence[str]) -> DataFrame:
    """component, n_levels, variance, sd of each factor and the residual (`n_levels`: its rows), all estimated together.

    Rows without response or with a null level take no part. Moment estimates may be
    negative: `variance` keeps them, `sd` is zero then. Both are NULL where the factors
    cannot be told apart (one level, or two factors of the same levels). No rows give none.
    """
    return _components(_centred(frame, response, factors), factors, None, None, False).drop("draw")


def crossed_spread_draws(
    frame: DataFrame, response: str, factors: Sequence[str], *, cluster: str, n_draws: int = 200, seed: int = 0, prefix: str = "sd_"
) -> DataFrame:
    """`draw, param, value`: bootstrap draws of the deviations, whole levels of `cluster` weighted by Poisson(1) counts.

    Draws whose levels cannot tell the factors apart are left out.
    """
    at = list(factors).index(cluster)
    cells = _centred(frame, response, factors).withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))
    cells = cells.withColumn("_count", poisson_weight(F.lit(seed), F.col("_draw"), F.col(f"_f{at}"))).where("_count > 0")
    found = _components(cells, factors, F.col("_count"), at, True).where(F.col("sd").isNotNull())
    return found.select("draw", F.concat(F.lit(prefix), "component").alias("param"), F.col("sd").alias("value"))
