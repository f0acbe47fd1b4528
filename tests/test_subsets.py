"""Subset search against all subsets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.operators import subsets


@pytest.fixture(scope="module")
def frame(spark):
    """60 rows, ten numbers (one an alias of two others), two factors, a grouping and gaps."""
    draw = np.random.default_rng(6)
    x = draw.normal(size=(60, 10))
    x[:, 9] = x[:, 0] + x[:, 1]
    kind, shape = draw.integers(0, 3, 60), draw.integers(0, 2, 60)
    year = np.arange(60) % 3
    y = 5e3 + 2 * x[:, 0] - x[:, 3] + (kind == 2) * 1.5 + year * 4 + draw.normal(size=60)
    rows = [(*map(float, x[i]), f"k{kind[i]}", f"s{shape[i]}", int(year[i]), float(y[i])) for i in range(60)]
    rows += [(None, *[0.0] * 9, "k0", "s0", 0, 1.0), (*[0.0] * 10, "k0", "s0", 0, None)]
    names = [f"x{j}" for j in range(10)]
    schema = ", ".join(f"{n} double" for n in names) + ", kind string, shape string, year int, y double"
    return spark.createDataFrame(rows, schema), names, x, kind, shape, year, y


def every_subset(frame, within):
    _, names, x, kind, shape, year, y = frame
    blocks = {n: x[:, [j]] for j, n in enumerate(names)}
    blocks["kind"], blocks["shape"] = np.column_stack([kind == 1, kind == 2]).astype(float), (shape == 1).astype(float)[:, None]
    base = np.column_stack([year == g for g in range(3)]).astype(float) if within else np.ones((60, 1))
    out = []
    for k in range(len(blocks) + 1):
        for chosen in itertools.combinations(blocks, k):
            design = np.column_stack([base, *[blocks[c] for c in chosen]])
            rank = np.linalg.matrix_rank(design)
            rss = ((y - design @ np.linalg.lstsq(design, y, rcond=None)[0]) ** 2).sum()
            p = rank + 1
            out.append((60 * math.log(rss / 60) + 60 * (1 + math.log(2 * math.pi)) + 2 * p + 2 * p * (p + 1) / (59 - p), rank, frozenset(chosen)))
    return sorted(out, key=lambda e: e[0]), list(blocks)


@pytest.mark.parametrize("within", [None, "year"])
def test_search_equals_all_subsets_of_twelve(frame, within):
    wanted, names = every_subset(frame, within)
    design = subsets.predictor_columns(frame[0], names)
    held = subsets.moments(frame[0], {"y": F.col("y")}, design, within=within)["y"]
    found, looked = subsets.best_subsets(held, most=40)
    assert held.n == 60 and held.fixed == (3 if within else 1)
    # a subset with an alias of its own columns is as good as the one without: compare the distinct criteria
    distinct = lambda rows: np.unique(np.round([s for s, *_ in rows], 6))
    got = distinct(found)
    assert np.allclose(got, distinct(wanted)[: len(got)], atol=1e-5)
    exact = {c: (s, r) for s, r, c in wanted}
    assert all(np.isclose(s, exact[c][0], atol=1e-5) and t == exact[c][1] for s, t, c in found)
    assert looked < 2**12 / 2


def test_registered_form_and_weights(frame):
    df, names = frame[0], [*frame[1], "kind", "shape"]
    rows = subsets.subset_search(df, {"y": F.col("y"), "minus": -F.col("y")}, names, within="year", most=20).collect()
    assert {r["response"] for r in rows} == {"y", "minus"} and len(rows) == 40
    for name in ("y", "minus"):
        own = [r for r in rows if r["response"] == name]
        assert abs(sum(r["weight"] for r in own) - 1) < 1e-9 and own[0]["aicc"] == min(r["aicc"] for r in own)
        assert own[0]["model"].startswith(f"{name} ~ 1 + x0") and "kind" in own[0]["model"]
    best = {r["response"]: r["aicc"] for r in reversed(rows)}
    assert np.isclose(best["y"], best["minus"])


def test_more_columns_than_rows_are_refused_a_criterion():
    assert subsets._score(1.0, 5, 4) == math.inf and subsets._score(1.0, 50, 4) < math.inf
