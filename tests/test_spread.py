"""Variance components of several factors at once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldtally.operators import models, spread


def table(rng, sites=12, years=5, reps=3, drop=0.0):
    site, year = rng.normal(0, 2, sites), rng.normal(0, 1, years)
    rows = [(f"s{i}", f"k{i % 3}", f"y{j}", float(100 + site[i] + year[j] + rng.normal(0, 0.5))) for i in range(sites) for j in range(years) for _ in range(reps)]
    return [r for r in rows if rng.random() >= drop]


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "site string, kind string, year string, y double")


def by_design(rows, factors, weights=None):
    """Quadratic forms and their expectations from explicit indicator matrices."""
    data = pd.DataFrame(rows, columns=["site", "kind", "year", "y"])
    y, n = data["y"].to_numpy() - data["y"].mean(), len(data)
    z = [pd.get_dummies(data[f]).to_numpy(float) for f in factors]
    forms = [zi @ np.diag(1 / zi.sum(0)) @ zi.T for zi in z] + [np.eye(n)]
    centre = np.full((n, n), 1 / n)
    parts = [*z, np.eye(n)]
    left = [[np.trace((q - centre) @ u @ u.T) for u in parts] for q in forms]
    return np.linalg.solve(left, [y @ (q - centre) @ y for q in forms])


def test_one_factor_equals_one_way(spark):
    frame = frame_of(spark, table(np.random.default_rng(1), drop=0.4))
    got = {r.component: r for r in spread.crossed_components(frame, "y", ["site"]).collect()}
    want = models.variance_components(frame, "y", "site").first()
    assert got["site"].sd == pytest.approx(want.sd_between) and got["residual"].sd == pytest.approx(want.sd_within)
    assert got["site"].n_levels == want.n_groups


def test_balanced_table_equals_mean_squares(spark):
    rows = table(np.random.default_rng(2))
    got = {r.component: r.variance for r in spread.crossed_components(frame_of(spark, rows), "y", ["site", "year"]).collect()}
    data = pd.DataFrame(rows, columns=["site", "kind", "year", "y"])
    a, b, r, overall = 12, 5, 3, data["y"].mean()
    ms_site = b * r * ((data.groupby("site")["y"].mean() - overall) ** 2).sum() / (a - 1)
    ms_year = a * r * ((data.groupby("year")["y"].mean() - overall) ** 2).sum() / (b - 1)
    ss = ((data["y"] - overall) ** 2).sum()
    ms_rest = (ss - (a - 1) * ms_site - (b - 1) * ms_year) / (a * b * r - a - b + 1)
    assert got["residual"] == pytest.approx(ms_rest)
    assert got["site"] == pytest.approx((ms_site - ms_rest) / (b * r)) and got["year"] == pytest.approx((ms_year - ms_rest) / (a * r))


def test_unbalanced_nested_and_crossed_equal_explicit_matrices(spark):
    rows = table(np.random.default_rng(3), drop=0.5)
    factors = ["site", "kind", "year"]
    got = {r.component: r.variance for r in spread.crossed_components(frame_of(spark, rows), "y", factors).collect()}
    assert [got[c] for c in (*factors, "residual")] == pytest.approx(by_design(rows, factors))


def test_draws_equal_tables_with_copied_levels(spark):
    rows = table(np.random.default_rng(4), drop=0.5)
    frame, factors = frame_of(spark, rows), ["site", "year"]
    drawn = spread.crossed_spread_draws(frame, "y", factors, cluster="site", n_draws=3, seed=5).toPandas()
    counts = {
        (r.draw, r.site): r.w
        for r in frame.select("site").distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(3))))
        .withColumn("w", models.poisson_weight(F.lit(5), F.col("draw"), F.col("site"))).collect()
    }
    for draw in (1, 2, 3):
        copied = [(f"{s}.{c}", k, year, y) for s, k, year, y in rows for c in range(counts[draw, s])]
        want = np.sqrt(np.maximum(0, by_design(copied, factors)))
        mine = drawn[drawn.draw == draw].set_index("param")["value"]
        assert [mine[f"sd_{c}"] for c in (*factors, "residual")] == pytest.approx(want)


def test_cases_without_answer(spark):
    rows = [("a", "k", "y1", 1.0), ("b", "k", "y1", 2.0), (None, "k", "y1", 9.0), ("b", "k", "y1", None), ("a", "k", "y1", 4.0)]
    frame = frame_of(spark, rows)
    assert [r.variance for r in spread.crossed_components(frame, "y", ["site", "kind"]).collect()] == [None] * 3
    assert spread.crossed_components(frame.limit(0), "y", ["site"]).count() == 0
    one = {r.component: r for r in spread.crossed_components(frame, "y", ["site"]).collect()}
    assert one["residual"].variance == pytest.approx(4.5) and one["site"].sd == 0 and one["site"].variance < 0
