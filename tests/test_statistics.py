"""Correlation, regression, ordination, draws and models against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldtally.operators import draws, models, ordination, stats


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    n = 120
    x = rng.normal(size=n)
    pdf = pd.DataFrame(
        {
            "id": np.arange(n), "x": x, "z": rng.normal(size=n).round(1), "y": 2 * x + rng.normal(size=n),
            "m": rng.choice(["2", "5", "8", "11"], n), "g": rng.choice(["s1", "s2", "s3", "s4", "s5", "s6"], n),
        }
    )
    pdf.loc[:4, "z"] = np.nan
    pdf["flat"] = 1.0
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)]
    schema = "id long, x double, z double, y double, m string, g string, flat double"
    return pdf, spark.createDataFrame([tuple(v.item() if hasattr(v, "item") else v for v in r) for r in rows], schema)


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlation(frame, method):
    pdf, df = frame
    got = {(r.col_1, r.col_2): r for r in stats.correlation(df, ["x", "z", "y", "flat"], method=method).collect()}
    for (a, b), r in got.items():
        both = pdf[[a, b]].dropna()
        assert r.n == len(both)
        if "flat" in (a, b):
            assert r.r is None and r.p_value is None
        else:
            ranked = both.rank() if method == "spearman" else both
            assert r.r == pytest.approx(np.corrcoef(ranked[a], ranked[b])[0, 1])
            assert 0 <= r.p_value <= 1
    assert got[("x", "y")].p_value < 1e-6 < got[("x", "z")].p_value


def test_ols_with_categories(frame):
    pdf, df = frame
    coefficients, fit = stats.ols(df, "y", ["x", "m"])
    got = {r.term: r for r in coefficients.collect()}
    assert set(got) == {"x", "m_2", "m_5", "m_8", "(Intercept)"}  # the first level, "11", is the baseline
    design = np.column_stack([np.ones(len(pdf)), pdf.x, *[(pdf.m == level) for level in ("2", "5", "8")]]).astype(float)
    beta, rss, *_ = np.linalg.lstsq(design, pdf.y, rcond=None)
    assert [got[t].estimate for t in ("(Intercept)", "x", "m_2", "m_5", "m_8")] == pytest.approx(beta.tolist(), abs=1e-6)
    assert fit["r_squared"] == pytest.approx(1 - rss[0] / ((pdf.y - pdf.y.mean()) ** 2).sum(), abs=1e-6)
    assert fit["df_residual"] == len(pdf) - 5 and fit["sigma"] == pytest.approx((rss[0] / (len(pdf) - 5)) ** 0.5, abs=1e-6)


def test_offset_model(frame):
    pdf, df = frame
    coefficients, metrics = models.offset_model(df, "y", ["x"], offset=F.col("x"))
    got = {r.term: r.estimate for r in coefficients.collect()}
    slope, intercept = np.polyfit(pdf.x, pdf.y - pdf.x, 1)
    assert (got["x"], got["(Intercept)"]) == (pytest.approx(slope, abs=1e-6), pytest.approx(intercept, abs=1e-6))
    residual = pdf.y - pdf.x - slope * pdf.x - intercept
    n = len(pdf)
    assert metrics["aic"] == pytest.approx(n * (np.log(2 * np.pi * (residual**2).sum() / n) + 1) + 2 * 3, abs=1e-4)


def test_pca(frame):
    pdf, df = frame
    result = ordination.pca(df, ["x", "z", "y", "flat"], keep=["id", "m"])
    filled = pdf[["x", "z", "y"]].fillna(pdf[["x", "z", "y"]].mean())
    standard = (filled - filled.mean()) / filled.std(ddof=0)
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(standard.T)))[::-1]
    assert [r.eigenvalue for r in result.axes.orderBy("axis").collect()] == pytest.approx(values.tolist())
    assert sum(r.eigenvalue for r in result.axes.collect()) == pytest.approx(3)
    scores = result.scores.toPandas().sort_values("id")
    assert scores.dim_1.var(ddof=0) == pytest.approx(values[0]) and abs(scores.dim_1.corr(scores.dim_2)) < 1e-9
    extra = {(r.variable, r.axis): r.coordinate for r in ordination.supplementary_numeric(result.scores.withColumn("id2", F.col("id") * 1.0), ["id2"], n_axes=2).collect()}
    assert extra[("id2", 1)] == pytest.approx(np.corrcoef(scores.id, scores.dim_1)[0, 1])
    levels = ordination.supplementary_categories(result.scores, ["m"], n_axes=2).toPandas().set_index("level")
    assert levels.loc["2", "dim_1"] == pytest.approx(scores[scores.m == "2"].dim_1.mean())


def test_correspondence_analysis(spark):
    rng = np.random.default_rng(11)
    table = rng.poisson(2.0, (25, 8)).astype(float)
    table[:, 0] += 1
    cells = spark.createDataFrame(
        [(f"r{i:02d}", f"c{j}", float(v)) for i, row in enumerate(table) for j, v in enumerate(row)], "row string, col string, n double"
    )
    p = table / table.sum()
    r, c = p.sum(1), p.sum(0)
    centred = (p - np.outer(r, c)) / np.sqrt(np.outer(r, c))
    u, s, vt = np.linalg.svd(centred, full_matrices=False)
    inertia = ordination.total_inertia(cells, rows=["row"], column="col", value="n").first()
    assert inertia.inertia == pytest.approx((s**2).sum()) and inertia.chi_squared == pytest.approx((s**2).sum() * table.sum())
    result = ordination.correspondence(cells, rows=["row"], column="col", value="n", n_axes=2)
    assert [a.eigenvalue for a in result.axes.orderBy("axis").collect()] == pytest.approx((s[:2] ** 2).tolist())
    scores = result.scores.toPandas().sort_values("row")
    for axis in range(2):
        want = u[:, axis] * s[axis] / np.sqrt(r)
        got = scores[f"dim_{axis + 1}"].to_numpy()
        assert np.allclose(got, want, atol=1e-8) or np.allclose(got, -want, atol=1e-8)


@pytest.fixture(scope="module")
def draw_table(spark):
    rng = np.random.default_rng(13)
    pdf = pd.DataFrame({"draw": np.arange(1, 401), "a": rng.normal(1, 1, 400), "b": rng.normal(0, 1, 400)})
    return pdf, draws.draws_to_long(spark.createDataFrame(pdf))


def test_direction_golden(spark):
    df = spark.createDataFrame([(i, "p", v) for i, v in enumerate((-1.0, 2.0, 3.0, 4.0))], "draw int, param string, value double")
    assert draws.probability_of_direction(df).first().pd == 0.75


def test_hypotheses_and_intervals(draw_table):
    pdf, df = draw_table
    got = draws.hypotheses(df, [("a>b", F.col("a") - F.col("b"), ">"), ("a=0", F.col("a"), "=")], params=["a", "b"]).toPandas().set_index("hypothesis")
    diff = pdf.a - pdf.b
    assert got.loc["a>b", "probability"] == pytest.approx((diff > 0).mean())
    assert got.loc["a>b", "lower"] == pytest.approx(np.quantile(diff, 0.05))  # 90 % interval when directional
    assert got.loc["a=0", "upper"] == pytest.approx(np.quantile(pdf.a, 0.975)) and np.isnan(got.loc["a=0", "probability"])
    wide = draws.point_intervals(df, widths=(0.66, 0.95), point="median").toPandas().set_index(["param", "width"])
    assert wide.loc[("a", 0.66), "lower"] == pytest.approx(np.quantile(pdf.a, 0.17))


def test_predictions_and_ratios(spark, draw_table):
    pdf, df = draw_table
    grid = spark.createDataFrame([(0, 0.0), (1, 2.0)], "row int, x double")
    got = draws.predict_draws(df, grid, {"b": "x"}, intercept="a", link="logit").where("row = 1").toPandas().sort_values("draw")
    assert np.allclose(got.value, 1 / (1 + np.exp(-(pdf.a + 2 * pdf.b))))
    ratio = draws.ratio_draws(df, {"r": ("a", "b")}).toPandas().sort_values("draw")
    assert np.allclose(ratio.value, pdf.a / pdf.b)
    sampled = draws.sample_draws(df, 0.3)
    assert sampled.groupBy("draw").count().where("count <> 2").count() == 0  # whole draws only


def test_bootstrap_centres_on_the_fit(frame):
    pdf, df = frame
    table = models.bootstrap_draws(df, "y", models.design_columns({}, ["x"]), cluster="g", n_draws=300).toPandas()
    slope = np.polyfit(pdf.x, pdf.y, 1)[0]
    drawn = table[table.param == "b_x"].value
    assert len(drawn) == 300 and abs(drawn.mean() - slope) < 4 * drawn.std() / 300**0.5 + 0.05


def test_poisson_weights(spark):
    w = spark.range(20000).select(models.poisson_weight(F.lit(0), F.col("id")).alias("w")).toPandas().w
    assert w.mean() == pytest.approx(1, abs=0.03) and w.var() == pytest.approx(1, abs=0.06)


def test_variance_components_balanced(spark):
    rng = np.random.default_rng(17)
    effects = rng.normal(0, 2, 60)
    rows = [(f"g{i}", float(e + v)) for i, e in enumerate(effects) for v in rng.normal(0, 1, 20)]
    got = models.variance_components(spark.createDataFrame(rows, "g string, y double"), "y", "g").first()
    assert got.sd_within == pytest.approx(1, abs=0.1) and got.sd_between == pytest.approx(effects.std(ddof=1), abs=0.2)


def test_subset_search(frame):
    pdf, df = frame
    found = models.subset_models(df.dropna(), "y", ["x", "z"]).toPandas().set_index("model")
    assert len(found) == 4 and found.weight.sum() == pytest.approx(1)
    assert found.loc[["y ~ 1 + x", "y ~ 1 + x + z"]].weight.sum() > 0.99
    importance = {r.variable: r.weight for r in models.variable_importance(models.subset_models(df.dropna(), "y", ["x", "z"])).collect()}
    assert importance["x"] == pytest.approx(1, abs=1e-6) and importance["z"] < 0.9
