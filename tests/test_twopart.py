"""Two-part models of shares against plain Newton steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.operators import models, twopart


@pytest.fixture(scope="module")
def shares(spark):
    """240 rows in 12 sites; zeros depend on x, a gap in x, a missing response."""
    draw = np.random.default_rng(4)
    x, site = np.round(draw.normal(size=240), 1), np.arange(240) % 12
    zero = draw.random(240) < 1 / (1 + np.exp(1.0 - 1.5 * x))
    y = np.where(zero, 0.0, 1 / (1 + np.exp(-(0.5 - 0.7 * x + draw.normal(scale=0.3, size=240)))))
    rows = [(f"s{site[i]:02}", float(x[i]), float(y[i])) for i in range(240)]
    df = spark.createDataFrame([*rows, ("s01", None, 0.0), ("s01", 0.0, None)], "site string, x double, y double")
    return df, x, site, y


def design_of():
    return {"(Intercept)": F.lit(1.0), "x": F.col("x")}


def weights_of(spark, n_draws):
    """Bootstrap weights of the sites, draw by draw."""
    table = spark.range(12).select(F.format_string("s%02d", "id").alias("cluster"), F.explode(F.sequence(F.lit(1), F.lit(n_draws))).alias("draw"))
    rows = table.withColumn("w", models.poisson_weight(F.lit(0), F.col("draw"), F.col("cluster"))).collect()
    return {(r["draw"], int(r["cluster"][1:])): r["w"] for r in rows}


def test_scores_are_zero_at_the_solution(spark, shares):
    df, x, site, y = shares
    got = twopart.zero_draws(df, "y", design_of(), cluster="site", n_draws=15, prior=0.5).collect()
    held, weights = {(r["draw"], r["param"]): r["value"] for r in got}, weights_of(spark, 15)
    design = np.column_stack([np.ones(240), x])
    for d in range(1, 16):
        beta = np.array([held[d, "b_zi_Intercept"], held[d, "b_zi_x"]])
        w = np.array([weights[d, s] for s in site])
        score = design.T @ (w * ((y == 0) - 1 / (1 + np.exp(-design @ beta)))) - 0.5 * beta
        assert np.abs(score).max() < 1e-5
    assert len(got) == 30


def test_patterns_collapse_rows(shares):
    df, x, site, y = shares
    rows = twopart.zero_patterns(df, "y", design_of(), cluster="site").collect()
    assert sum(r["n"] for r in rows) == 240 and sum(r["zeros"] for r in rows) == (y == 0).sum()
    assert len(rows) == len({(s, v) for s, v in zip(site, x)})


def test_separated_zeros_stay_finite(spark):
    df = spark.createDataFrame([(f"s{i % 5}", float(i), 0.0 if i > 10 else 0.5) for i in range(20)], "site string, x double, y double")
    values = [r["value"] for r in twopart.zero_draws(df, "y", design_of(), cluster="site", n_draws=5).collect()]
    assert np.isfinite(values).all()


def test_both_parts_and_expected_shares(shares):
    df, x, _, y = shares
    draws = twopart.two_part_draws(df, "y", design_of(), cluster="site", n_draws=40)
    params = {r["param"] for r in draws.select("param").distinct().collect()}
    assert params == {"b_Intercept", "b_x", "b_zi_Intercept", "b_zi_x"}
    means = {r["param"]: r["m"] for r in draws.groupBy("param").agg(F.avg("value").alias("m")).collect()}
    assert abs(means["b_x"] + 0.7) < 0.15 and abs(means["b_zi_x"] - 1.5) < 0.6
    found = twopart.expected_shares(draws, df.where("y is not null"), design_of(), keep=["site", "x"])
    one = found.agg(F.avg("zero_share").alias("z"), F.count(F.lit(1)).alias("n")).first()
    assert abs(one["z"] - (y == 0).mean()) < 0.05 and one["n"] == 40 * 240
    row = found.where("draw = 3").first()
    held = {r["param"]: r["value"] for r in draws.where("draw = 3").collect()}
    zero = 1 / (1 + np.exp(-(held["b_zi_Intercept"] + held["b_zi_x"] * row["x"])))
    share = 1 / (1 + np.exp(-(held["b_Intercept"] + held["b_x"] * row["x"])))
    assert np.allclose([row["zero_share"], row["share"], row["expected"]], [zero, share, (1 - zero) * share])
