"""Range-partitioned running values, ranks and quantiles must agree with pandas, for any number of ranges."""

import numpy as np
import pandas as pd
import pytest

from fieldtally.operators import ordered
from fieldtally.operators.permutation import add_holm

PATHS = [{"ranges": 7}, {"ranges": 1}, {}]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    # one group holds most rows and one value most of that group
    g = np.where(rng.random(3000) < 0.8, "hot", rng.choice(list("abc"), 3000))
    x = np.where(rng.random(3000) < 0.4, 0.0, rng.normal(size=3000).round(2))
    return pd.DataFrame({"k": np.arange(3000), "g": g, "x": x, "w": rng.integers(1, 5, 3000)})


@pytest.mark.parametrize("tuning", PATHS)
def test_running_values(spark, rows, tuning):
    df = spark.createDataFrame(rows)
    got = ordered.add_running(
        df, by=["g"], order=["x", "k"], sums={"before": "w"}, maxima={"peak": "w"}, totals={"total": "w"}, **tuning
    ).toPandas().sort_values("k").reset_index(drop=True)
    s = rows.sort_values(["g", "x", "k"])
    s["before"] = s.groupby("g")["w"].cumsum() - s["w"]
    s["peak"] = s.groupby("g")["w"].cummax()
    s["total"] = s.groupby("g")["w"].transform("sum")
    want = s.sort_values("k").reset_index(drop=True)
    for c in ("before", "peak", "total"):
        assert got[c].tolist() == want[c].tolist()


@pytest.mark.parametrize("tuning", PATHS)
def test_quantiles_match_linear_interpolation(spark, rows, tuning):
    got = ordered.group_quantiles(
        spark.createDataFrame(rows), by=["g"], value="x", quantiles={"a": 0.05, "m": 0.5, "z": 0.975}, **tuning
    ).toPandas().set_index("g")
    for g, part in rows.groupby("g"):
        assert got.loc[g].tolist() == pytest.approx(np.quantile(part.x, [0.05, 0.5, 0.975]).tolist())


def test_quantile_golden(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "x double")
    assert ordered.group_quantiles(df, value="x", quantiles={"q": 0.25}).first().q == 1.5


@pytest.mark.parametrize("tuning", PATHS)
def test_average_ranks(spark, rows, tuning):
    got = ordered.average_ranks(spark.createDataFrame(rows), by=["g"], value="x", **tuning).toPandas()
    want = rows.assign(r=rows.groupby("g")["x"].rank(method="average")).drop_duplicates(["g", "x"])
    merged = got.merge(want, on=["g", "x"])
    assert len(merged) == len(got) == len(want)
    assert np.allclose(merged["rank"], merged["r"])


@pytest.mark.parametrize("tuning", PATHS)
def test_holm(spark, tuning):
    def adjusted(values):
        df = spark.createDataFrame(list(enumerate(values)), "i int, p double")
        return [r.adj for r in add_holm(df, "p", "adj", **tuning).orderBy("i").collect()]

    assert adjusted([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])
    assert adjusted([0.01, None, 0.03]) == [pytest.approx(0.02), None, pytest.approx(0.03)]
    p = np.random.default_rng(2).random(200).round(2).tolist()
    order = np.argsort(p, kind="stable")
    steps = np.maximum.accumulate([(200 - i) * p[j] for i, j in enumerate(order)])
    want = np.empty(200)
    want[order] = np.minimum(steps, 1)
    assert adjusted(p) == pytest.approx(want.tolist())


def test_result_does_not_depend_on_partitions(spark, rows):
    df = spark.createDataFrame(rows)
    runs = [
        ordered.add_rank(df.repartition(n), "r", order=["x", "k"], ranges=5).orderBy("k").toPandas().r.tolist()
        for n in (1, 6)
    ]
    assert runs[0] == runs[1] and sorted(runs[0]) == list(range(1, 3001))


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("a", 1, 4)], "g string, k int, w int")
    got = ordered.add_running(df, by=["g"], order=["k"], sums={"before": "w"}, totals={"total": "w"}, ranges=3)
    assert sorted((str(r.g), r.k, r.before, r.total) for r in got.collect()) == [("None", 1, 0, 5), ("None", 2, 2, 5), ("a", 1, 0, 4)]


def test_no_plan_depends_on_the_row_count(spark):
    """The same operators stand in the plan for few and for many rows."""
    shapes = []
    for n in (5, 5000):
        ranked = ordered.add_rank(spark.range(n), "r", order=["id"], ranges=4)
        plan = ranked._jdf.queryExecution().optimizedPlan().toString()
        shapes.append([line.strip(" :+-").split(" ")[0] for line in plan.splitlines()])
    assert shapes[0] == shapes[1]
