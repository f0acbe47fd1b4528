"""Composition operators against brute force on small tables."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.operators import composition, diversity, ordination

ROWS = ["site", "visit"]


@pytest.fixture(scope="module")
def community(spark):
    """18 visits, 7 species with ties and zeros, three groups of unlike composition, covariates with a gap and an alias."""
    draw = np.random.default_rng(3)
    counts = draw.poisson(2.0, (18, 7)).astype(float)
    group = np.repeat([0, 1, 2], 6)
    counts[group == 1, 0] += 3
    counts[group == 2, 5] += 4
    counts[:, 6] = [1, 1, 2, 2, 2, 0, 0, 0, 1, 3, 3, 0, 1, 0, 0, 2, 2, 1]
    x = np.column_stack([draw.normal(size=18), group + draw.normal(scale=0.3, size=18), draw.normal(size=18)])
    cells = [(f"s{i % 3}", i, f"sp{j}", float(counts[i, j])) for i in range(18) for j in range(7) if counts[i, j]]
    cells += [("s0", 99, "sp0", 0.0)]
    traits = [(f"s{i % 3}", i, f"g{group[i]}", *map(float, x[i]), 2.0 * float(x[i, 0])) for i in range(18)]
    traits += [("s9", 50, "g0", 0.0, 0.0, 0.0, 0.0), ("s1", 98, None, 1.0, None, 0.0, 2.0)]
    return (
        spark.createDataFrame(cells, "site string, visit int, species string, n double"),
        spark.createDataFrame(traits, "site string, visit int, grp string, a double, b double, c double, a2 double"),
        counts, group, x,
    )


def hellinger(counts):
    return np.sqrt(counts / counts.sum(axis=1, keepdims=True))


def squares(h, group):
    """Total and within sums of squares from all pairs."""
    pairs = [(i, j, ((h[i] - h[j]) ** 2).sum()) for i, j in itertools.combinations(range(len(h)), 2)]
    sizes = np.bincount(group)
    return sum(d for *_, d in pairs) / len(h), sum(d / sizes[group[i]] for i, j, d in pairs if group[i] == group[j])


def test_groups_equal_all_pairs(community):
    cells, traits, counts, group, _ = community
    row = composition.composition_groups(cells, traits, rows=ROWS, column="species", value="n", group="grp").first()
    total, within = squares(hellinger(counts), group)
    assert (row["n"], row["k"]) == (18, 3)
    assert np.allclose([row["ss_total"], row["ss_within"]], [total, within])
    assert np.isclose(row["pseudo_f"], ((total - within) / 2) / (within / 15)) and np.isclose(row["r_squared"], 1 - within / total)


def test_permutations_agree_with_brute_force(spark, community):
    cells, traits, counts, group, _ = community
    draw, h = np.random.default_rng(0), hellinger(counts)
    weak = draw.permutation(group)  # labels that mean nothing
    labels = spark.createDataFrame([(f"s{i % 3}", i, f"w{weak[i]}") for i in range(18)], "site string, visit int, weak string")
    for table, name, own in ((traits, "grp", group), (labels, "weak", weak)):
        seen = squares(h, own)[1]
        brute = np.mean([squares(h, draw.permutation(own))[1] <= seen + 1e-9 for _ in range(1500)])
        row = composition.composition_test(cells, table, rows=ROWS, column="species", value="n", group=name, n_perm=1999).first()
        assert row["n_perm"] == 1999 and abs(row["p_value"] - brute) < 0.06
    again = composition.composition_test(cells.repartition(7), table, rows=ROWS, column="species", value="n", group=name, n_perm=1999).first()
    assert again["p_value"] == row["p_value"]


def test_one_group_has_no_test(community):
    cells, traits, *_ = community
    one = traits.withColumn("grp", F.lit("x"))
    row = composition.composition_test(cells, one, rows=ROWS, column="species", value="n", group="grp", n_perm=60).first()
    assert row["k"] == 1 and row["pseudo_f"] is None and row["p_value"] is None and abs(row["r_squared"]) < 1e-9


def test_dealt_groups_keep_their_sizes(community, monkeypatch):
    """Every permutation deals each row one group: the squares of a constant species never change."""
    cells, traits, *_ = community
    flat = cells.where("n > 0").select(*ROWS).distinct().withColumn("species", F.lit("only")).withColumn("n", F.lit(1.0))
    row = composition.composition_test(flat, traits, rows=ROWS, column="species", value="n", group="grp", n_perm=130).first()
    assert row["p_value"] == 1.0 and abs(row["ss_total"]) < 1e-9


def cca(counts, x):
    """Weighted regression of the dense chi-squared table."""
    p = counts / counts.sum()
    r, c = p.sum(axis=1), p.sum(axis=0)
    table = (p - np.outer(r, c)) / np.sqrt(np.outer(r, c))
    z = np.sqrt(r)[:, None] * (x - r @ x)
    fitted = z @ np.linalg.pinv(z) @ table
    u, s, vt = np.linalg.svd(fitted, full_matrices=False)
    k = int((s > 1e-9).sum())
    return (table**2).sum(), s[:k] ** 2, (vt[:k].T * s[:k]) / np.sqrt(c)[:, None], (u[:, :k] * s[:k]) / np.sqrt(r)[:, None], z, u[:, :k]


def up_to_sign(got, want):
    return all(np.allclose(g, w, atol=1e-8) or np.allclose(g, -w, atol=1e-8) for g, w in zip(got.T, want.T))


def test_constrained_ordination_equals_dense_regression(community):
    cells, traits, counts, _, x = community
    design = {"a": F.col("a"), "b": F.col("b"), "alias": F.col("a2")}
    got = composition.constrained_ordination(cells, traits, rows=ROWS, column="species", value="n", design=design)
    total, values, species, sites, z, u = cca(counts, x[:, :2])
    inertia = got.inertia.first()
    assert np.isclose(inertia["total"], total) and np.isclose(inertia["constrained"], values.sum()) and got.n_axes == 2
    assert np.isclose(inertia["constrained"] + inertia["residual"], ordination.total_inertia(cells, rows=ROWS, column="species", value="n").first()["inertia"])
    assert np.allclose([r["eigenvalue"] for r in got.axes.orderBy("axis").collect()], values)
    assert up_to_sign(np.array([[r["dim_1"], r["dim_2"]] for r in got.variables.orderBy("species").collect()]), species)
    assert up_to_sign(np.array([[r["dim_1"], r["dim_2"]] for r in got.scores.orderBy("visit").collect()]), sites)
    unit = z / np.sqrt((z**2).sum(axis=0))
    held = {(r["variable"], r["axis"]): r["correlation"] for r in got.predictors.collect()}
    wanted = unit.T @ u
    assert all(np.isclose(abs(held[n, a + 1]), abs(wanted[i, a])) for i, n in enumerate("ab") for a in range(2))
    assert np.isclose(held["alias", 1], held["a", 1])


def rda(h, x):
    y, z = h - h.mean(axis=0), x - x.mean(axis=0)
    fitted, rank = z @ np.linalg.pinv(z) @ y, np.linalg.matrix_rank(z)
    r2 = (fitted**2).sum() / (y**2).sum()
    return r2, 1 - (1 - r2) * (len(h) - 1) / (len(h) - 1 - rank)


def test_variation_partition_equals_dense_regressions(community):
    cells, traits, counts, _, x = community
    groups = {"one": {"a": F.col("a"), "again": F.col("a2")}, "two": {"b": F.col("b")}, "three": {"c": F.col("c")}}
    rows = composition.variation_partition(cells, traits, rows=ROWS, column="species", value="n", groups=groups).collect()
    fits = {frozenset(u): rda(hellinger(counts), x[:, list(u)]) for k in (1, 2, 3) for u in itertools.combinations(range(3), k)}
    names = ["one", "two", "three"]
    unions = {frozenset(r["part"].split(" + ")): r for r in rows if r["kind"] == "union"}
    for u, (r2, adjusted) in fits.items():
        row = unions[frozenset(names[i] for i in u)]
        assert np.isclose(row["r_squared"], r2) and np.isclose(row["adj_r_squared"], adjusted) and row["n_terms"] == len(u)
    fractions = {r["part"]: r["adj_r_squared"] for r in rows if r["kind"] == "fraction"}
    full = fits[frozenset({0, 1, 2})][1]
    assert np.isclose(sum(v for k, v in fractions.items() if k != "residual"), full) and np.isclose(fractions["residual"], 1 - full)
    assert np.isclose(fractions["one"], full - fits[frozenset({1, 2})][1])
    for name in names:  # what a group explains alone is the sum of its fractions
        held = sum(v for k, v in fractions.items() if name in k.split(" + "))
        assert np.isclose(held, fits[frozenset({names.index(name)})][1])


def test_sweep_inverts_and_skips_aliases():
    draw = np.random.default_rng(1)
    z = draw.normal(size=(30, 4))
    z[:, 2] = z[:, 0] - z[:, 1]
    gram = z.T @ z
    swept, used = composition.sweep(gram, range(4))
    assert used == [0, 1, 3] and np.allclose(-swept[np.ix_(used, used)], np.linalg.inv(gram[np.ix_(used, used)]))


def midranks(v):
    return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])


def kendall(counts):
    ranks = np.array([midranks(c) for c in counts.T]).T
    n, m = ranks.shape
    ties = sum((t**3 - t) for c in counts.T for t in np.unique(c, return_counts=True)[1])
    s = ((ranks.sum(axis=1) - m * (n + 1) / 2) ** 2).sum()
    return 12 * s / (m**2 * (n**3 - n) - m * ties), ranks


def test_concordance_equals_dense_ranks(community):
    cells, _, counts, *_ = community
    row = composition.concordance_test(cells, objects=ROWS, judge="species", value="n", n_perm=1999).first()
    w, ranks = kendall(counts)
    m = counts.shape[1]
    assert (row["n_objects"], row["n_judges"]) == (18, 7) and np.isclose(row["w"], w)
    assert np.isclose(row["chi_squared"], m * 17 * w) and np.isclose(row["f_statistic"], (m - 1) * w / (1 - w))
    draw = np.random.default_rng(2)
    seen = (ranks.sum(axis=1) ** 2).sum()
    brute = np.mean([(sum(draw.permutation(c) for c in ranks.T) ** 2).sum() >= seen - 1e-9 for _ in range(4000)])
    assert abs(row["p_value_perm"] - brute) < 0.05 and abs(row["p_value_f"] - brute) < 0.1


def test_agreeing_judges_are_concordant(spark):
    cells = spark.createDataFrame([(o, j, float(o + 1)) for o in range(8) for j in range(5)], "o int, j int, n double")
    row = composition.concordance_test(cells, objects=["o"], judge="j", value="n", n_perm=199).first()
    assert np.isclose(row["w"], 1.0) and row["p_value_perm"] <= 0.02
    assert composition.concordance(cells.limit(0), objects=["o"], judge="j", value="n").collect() == []


def test_evenness_and_importance_by_hand(spark):
    rows = [("a", "o1", "GN", "x", 2.0, 5.0), ("a", "o1", "GN", "y", 2.0, 15.0), ("a", "o2", "GN", "x", 4.0, 0.0), ("b", "o1", "GN", "y", 0.0, 0.0)]
    totals = spark.createDataFrame(rows, "refuge string, occasion string, gear string, species string, no_fish double, total_weight double")
    even = {(r["refuge"], r["occasion"]): r for r in diversity.evenness(totals).collect()}
    assert set(even) == {("a", "o1"), ("a", "o2")}
    assert np.allclose([even["a", "o1"][c] for c in ("hill_1", "hill_2", "shannon_evenness", "hill_ratio")], [2, 2, 1, 1])
    held = {r["species"]: r for r in diversity.relative_importance(totals.withColumn("s", F.lit(1)), by=["s"], visit=["refuge", "occasion"]).collect()}
    assert np.isclose(held["x"]["iri"], (75 + 25) * 200 / 3) and np.isclose(held["y"]["iri"], (25 + 75) * 100 / 3)
    assert np.isclose(held["x"]["iri_pct"], 200 / 3)


def test_no_pairs_and_combined_sums(community):
    """No cross product of rows; permutation sums are combined before they are exchanged."""
    cells, traits, *_ = community
    plan = composition.composition_groups(cells, traits, rows=ROWS, column="species", value="n", group="grp")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
