"""Two-part models of shares with zeros: whether a share is zero, and how large it is otherwise."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import numbers
from fieldtally.operators.lineage import cut
from fieldtally.operators.models import bootstrap_draws, poisson_weight

CEILING = 0.999  # shares of one have no logit
PRIOR = 0.1  # precision of the normal prior on the zero part's coefficients


def zero_patterns(frame: DataFrame, response: str, design: Mapping[str, Column], *, cluster: str) -> DataFrame:
    """Rows and zeros of every distinct row of the design within a cluster: `cluster, x, n, zeros`; incomplete rows are left out."""
    terms = [c.cast("double").alias(f"_x{i}") for i, c in enumerate(design.values())]
    zero = F.when(F.col(response) == 0, 1).when(F.col(response).isNotNull(), 0)
    held = frame.select(F.col(cluster).cast("string").alias("cluster"), zero.alias("_zero"), *terms).dropna()
    x = F.array(*[F.col(f"_x{i}") for i in range(len(terms))])
    return held.select("cluster", x.alias("x"), "_zero").groupBy("cluster", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("_zero").alias("zeros"))


def _moments(weighted: DataFrame, betas: np.ndarray, draws: list[int], p: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Information matrix and score of every draw at its coefficients, from one aggregation over the patterns."""
    spark = weighted.sparkSession
    table = spark.createDataFrame([(d, [float(b) for b in betas[k]]) for k, d in enumerate(draws)], "draw int, beta array<double>")
    eta = F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    chance = 1 / (1 + F.exp(-F.col("_eta")))
    spread = F.col("w") * F.col("n") * F.col("_p") * (1 - F.col("_p"))
    left = F.col("w") * (F.col("zeros") - F.col("n") * F.col("_p"))
    cells = [(i, j) for i in range(p) for j in range(i, p)]
    at = weighted.join(table, "draw").withColumn("_eta", eta).withColumn("_p", chance).withColumns({"_s": spread, "_l": left})
    x = [F.col("x")[i] for i in range(p)]
    rows = at.groupBy("draw").agg(
        F.array(*[F.sum(F.col("_s") * x[i] * x[j]) for i, j in cells]).alias("information"), F.array(*[F.sum(F.col("_l") * c) for c in x]).alias("score")
    )
    out = {}
    for r in rows.collect():  # p * (p + 3) / 2 numbers a draw
        matrix = np.zeros((p, p))
        for (i, j), v in zip(cells, r["information"]):
            matrix[i, j] = matrix[j, i] = v
        out[r["draw"]] = matrix, np.array(r["score"])
    return out


def zero_draws(
    frame: DataFrame, response: str, design: Mapping[str, Column], *, cluster: str, n_draws: int = 200, seed: int = 0, prefix: str = "b_zi_", prior: float = PRIOR,
    rounds: int = 30,
) -> DataFrame:
    """Coefficient draws of a logistic model of zeros by cluster bootstrap: `draw, param, value`.

    Clusters are weighted by Poisson(1) counts, the same as in `models.bootstrap_draws`. All draws take their Newton steps
    together: a round is one aggregation over patterns x draws, and only the draws' information matrices reach the driver.
    A weak normal prior keeps coefficients finite where the zeros are separated.
    """
    terms = list(design)
    p = len(terms)
    patterns = cut(zero_patterns(frame, response, design, cluster=cluster))
    drawn = patterns.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))
    weighted = cut(drawn.withColumn("w", poisson_weight(F.lit(seed), F.col("draw"), F.col("cluster"))).where("w > 0"))
    draws = sorted(r["draw"] for r in weighted.select("draw").distinct().collect())
    betas, active = np.zeros((len(draws), p)), np.ones(len(draws), bool)
    for _ in range(rounds):
        if not active.any():
            break
        chosen = [d for d, a in zip(draws, active) if a]
        found = _moments(weighted, betas[active], chosen, p)
        for k in np.flatnonzero(active):
            matrix, score = found[draws[k]]
            step = np.linalg.solve(matrix + prior * np.eye(p), score - prior * betas[k])
            longest = np.abs(step).max()
            betas[k] += step * min(1.0, 4.0 / longest) if longest else 0.0
            active[k] = longest > 1e-6
    names = [f"{prefix}{'Intercept' if t == '(Intercept)' else t}" for t in terms]
    rows = [(int(d), name, float(b)) for d, beta in zip(draws, betas) for name, b in zip(names, beta)]
    return frame.sparkSession.createDataFrame(rows, "draw long, param string, value double")


def two_part_draws(
    frame: DataFrame, response: str, design: Mapping[str, Column], *, cluster: str, n_draws: int = 200, seed: int = 0, prefix: str = "b_"
) -> DataFrame:
    """Draws of both parts: `<prefix><term>` for the logit of the shares above zero, `<prefix>zi_<term>` for the zeros."""
    share = F.least(F.col(response), F.lit(CEILING))
    above = frame.where(F.col(response) > 0).withColumn("_logit", numbers.logit(share))
    size = bootstrap_draws(above, "_logit", dict(design), cluster=cluster, n_draws=n_draws, seed=seed, prefix=prefix)
    return size.unionByName(zero_draws(frame, response, design, cluster=cluster, n_draws=n_draws, seed=seed, prefix=f"{prefix}zi_"))


def expected_shares(draws: DataFrame, rows: DataFrame, design: Mapping[str, Column], *, keep: list[str], prefix: str = "b_") -> DataFrame:
    """Every draw's prediction for every row: `zero_share`, the `share` where it is not zero, and `expected`, over both parts."""
    names = ["Intercept" if t == "(Intercept)" else t for t in design]
    part = lambda lead: F.map_from_entries(F.collect_list(F.when(F.col("param").isin([f"{lead}{n}" for n in names]), F.struct("param", "value"))))
    wide = draws.groupBy("draw").agg(part(prefix).alias("_size"), part(f"{prefix}zi_").alias("_zero"))
    x = rows.select(*keep, F.array(*[c.cast("double") for c in design.values()]).alias("_x")).where(~F.exists("_x", lambda v: v.isNull()))
    each = x.withColumn("draw", F.explode(F.sequence(F.lit(1), draws.agg(F.max("draw")).scalar()))).join(wide, "draw")

    def chance(table: str, lead: str) -> Column:
        terms = [F.col("_x")[i] * F.col(table)[f"{lead}{n}"] for i, n in enumerate(names)]
        return 1 / (1 + F.exp(-sum(terms[1:], terms[0])))

    out = each.select("draw", *keep, chance("_zero", f"{prefix}zi_").alias("zero_share"), chance("_size", prefix).alias("share"))
    return out.withColumn("expected", (1 - F.col("zero_share")) * F.col("share"))
