"""Least squares through merged QR factors, against numpy on the whole design."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.operators import leastsquares


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = []
    for i in range(200):
        kind, side, x = int(rng.integers(3)), "ab"[rng.integers(2)], float(rng.normal())
        out.append((i, str(kind), side, float(rng.normal(1e6, 1)), x, float(rng.normal() + kind + x)))
    return out


SCHEMA = "id long, kind string, side string, far double, x double, y double"


def test_matches_numpy(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    fit = leastsquares.least_squares(df, "y", ["kind", "side", "kind:side", "far", "x"])
    kind, side, far, x, y = (np.array([r[i] for r in rows]) for i in range(1, 6))
    far = far - 1e6  # centred here only, to give numpy an easier problem
    columns = {"kind1": kind == "1", "kind2": kind == "2", "sideb": side == "b"}
    columns |= {f"{a}:sideb": columns[a] & columns["sideb"] for a in ("kind1", "kind2")} | {"far": far, "x": x}
    design = np.column_stack([np.ones(len(y)), *columns.values()]).astype(float)
    beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    got = {r.term: r for r in fit.coefficients.collect()}
    assert set(got) == {"(Intercept)", *columns} and not any(r.aliased for r in got.values())
    assert [got[c].estimate for c in columns] == pytest.approx(beta[1:].tolist(), rel=1e-7, abs=1e-9)
    sigma2 = rss[0] / (len(y) - design.shape[1])
    errors = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * sigma2)
    assert [got[c].std_error for c in columns] == pytest.approx(errors[1:].tolist(), rel=1e-7)
    s = fit.summary.first()
    assert (s.n, s.rank, s.n_aliased, s.df_residual) == (200, 8, 0, 192)
    assert s.sigma == pytest.approx(sigma2**0.5) and s.r_squared == pytest.approx(1 - rss[0] / ((y - y.mean()) ** 2).sum())
    residuals = y - design @ beta
    assert [s.residual_min, s.residual_q1, s.residual_median, s.residual_q3, s.residual_max] == pytest.approx(np.quantile(residuals, [0, 0.25, 0.5, 0.75, 1]).tolist(), abs=1e-8)
    assert 0 < s.p_value < 1e-3


def test_aliased_terms_are_reported(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"twice": F.col("x") * 2 + 3, "flat": F.lit(5.0)})
    fit = leastsquares.least_squares(df, "y", ["x", "twice", "flat", "kind"])
    got = {r.term: r for r in fit.coefficients.collect()}
    assert {t for t, r in got.items() if r.aliased} == {"twice", "flat"}
    assert got["twice"].estimate is None and got["twice"].p_value is None
    plain = leastsquares.least_squares(df, "y", ["x", "kind"])
    assert got["x"].estimate == pytest.approx(next(r.estimate for r in plain.coefficients.collect() if r.term == "x"))
    assert fit.summary.first().n_aliased == 2


def test_missing_values_and_small_tables(spark, rows):
    gaps = [(900, None, "a", 1.0, 1.0, 1.0), (901, "1", "a", float("nan"), 1.0, 1.0), (902, "1", "a", 1.0, float("inf"), 1.0), (903, "1", "a", 1.0, 1.0, None)]
    whole = leastsquares.least_squares(spark.createDataFrame(rows + gaps, SCHEMA), "y", ["kind", "far", "x"]).summary.first()
    assert whole.n == 200
    empty = leastsquares.least_squares(spark.createDataFrame([], SCHEMA), "y", ["kind", "x"])
    assert empty.summary.first().n == 0 and all(r.estimate is None for r in empty.coefficients.collect())
    two = leastsquares.least_squares(spark.createDataFrame(rows[:2], SCHEMA), "y", ["x"]).summary.first()
    assert (two.df_residual, two.sigma, two.p_value) == (0, None, None)


def test_partitioning_does_not_matter(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    a, b = (leastsquares.least_squares(df.repartition(k), "y", ["kind", "x"]).summary.first() for k in (1, 70))
    assert a.r_squared == pytest.approx(b.r_squared, rel=1e-12)
