"""Effort, diversity, turnover and species tests against hand values and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.config import SurveyConfig
from fieldtally.operators import change, diversity, effort, turnover

CFG = SurveyConfig(n_perm=130, complete_years=6)


def catches(spark, rows):
    schema = "refuge string, occasion string, replicate string, gear string, species string, no_fish double, total_weight double"
    return spark.createDataFrame([(r, o, p, g, s, n, n) for r, o, p, g, s, n in rows], schema)


def test_effort_standardisation(spark):
    rows = [("fr01", "oc01", f"re{i}", "GN", "sp1", 1.0) for i in range(5)]
    rows += [("fr02", "oc01", f"re{i}", "GN", "sp1", 25.0 / 80 if i < 80 else 0.0) for i in range(80)]
    rows += [("fr01", "oc01", "re9", "HL", "sp1", 99.0)]  # other gear: neither caught nor counted as effort
    catch = catches(spark, rows)
    got = {r.refuge: (r.no_fish, r.n_samples) for r in effort.effort_totals(catch, CFG).collect()}
    assert got == {"fr01": (8.0, 5), "fr02": (2.0, 80)}  # 2.5 rounds to the even number
    tagged = effort.tagged_effort_totals(catch, CFG).where("refuge = 'fr01'").collect()
    assert {r.standard: r.no_fish for r in tagged} == {"standard_totals": 8.0, "raw_totals": 5.0}


def test_missing_counts_sum_to_zero(spark):
    catch = catches(spark, [("fr01", "oc01", "re1", "GN", "sp1", None)])
    assert effort.effort_totals(catch, CFG).first().no_fish == 0.0
    assert effort.mean_scaled_totals(catch, CFG).first().no_fish == 0.0


@pytest.mark.parametrize(
    "index, counts, expected",
    [
        ("shannon", (1, 1), math.log(2)), ("shannon", (4, 0), 0.0), ("shannon", (0, 0), 0.0),
        ("simpson", (1, 1), 0.5), ("simpson", (0, 0), 1.0), ("invsimpson", (1, 1), 2.0), ("invsimpson", (0, 0), math.inf),
    ],
)
def test_diversity_values(spark, index, counts, expected):
    rows = [("fr1", "oc1", "GN", f"sp{i}", float(c), 3) for i, c in enumerate(counts)]
    totals = spark.createDataFrame(rows, "refuge string, occasion string, gear string, species string, no_fish double, n_samples int")
    assert diversity.alpha_diversity(totals, index=index).first().diversity_alpha == pytest.approx(expected)


def test_diversity_properties(spark):
    rng = np.random.default_rng(3)
    rows = [("fr1", f"oc{v}", "GN", f"sp{i}", float(n)) for v in range(20) for i, n in enumerate(rng.integers(0, 30, 12))]
    totals = spark.createDataFrame(rows, "refuge string, occasion string, gear string, species string, no_fish double")
    base = diversity.alpha_diversity(totals).toPandas().set_index("occasion").diversity_alpha
    scaled = diversity.alpha_diversity(totals.withColumn("no_fish", F.col("no_fish") * 7)).toPandas().set_index("occasion").diversity_alpha
    assert np.allclose(base, scaled.loc[base.index])
    assert (base >= 0).all() and (base <= math.log(12)).all()
    bits = diversity.alpha_diversity(totals, base=2.0).toPandas().set_index("occasion").diversity_alpha
    assert np.allclose(bits.loc[base.index], base / math.log(2))


def season_table(spark, rows):
    return spark.createDataFrame(rows, "year_s int, season string, month string, refuge string, species string, count double")


def pair(spark, first, second, site="fr01"):
    rows = [(0, "dry", "2", site, f"sp{i}", math.expm1(v)) for i, v in enumerate(first)]
    return season_table(spark, rows + [(0, "dry", "5", site, f"sp{i}", math.expm1(v)) for i, v in enumerate(second)])


def test_turnover_values(spark):
    # counts are given on the log scale, so the amounts compared are the listed ones
    got = {r.pa_tr: r for r in turnover.turnover(pair(spark, (3, 0, 2), (1, 4, 2)), CFG).where("comparison = '2 5'").collect()}
    assert (got[False].b, got[False].c) == (pytest.approx(2), pytest.approx(4))
    assert (got[False].b_stnd, got[False].c_stnd, got[False].d) == (pytest.approx(1 / 6), pytest.approx(1 / 3), pytest.approx(1 / 2))
    assert (got[True].b_stnd, got[True].c_stnd, got[True].d) == (0.0, pytest.approx(0.2), pytest.approx(0.2))


def test_turnover_empty_and_identical(spark):
    empty = turnover.turnover(pair(spark, (0, 0), (0, 0)), CFG).where("comparison = '2 5'").first()
    assert empty.d is None and empty.b_stnd is None
    same = turnover.turnover(pair(spark, (1, 2), (1, 2)), CFG).where("comparison = '2 5'").first()
    assert same.d == 0.0


def test_turnover_swaps_losses_and_gains(spark):
    a = turnover.turnover(pair(spark, (3, 0, 2), (1, 4, 2)), CFG).where("comparison = '2 5' AND NOT pa_tr").first()
    b = turnover.turnover(pair(spark, (1, 4, 2), (3, 0, 2)), CFG).where("comparison = '2 5' AND NOT pa_tr").first()
    assert (a.b_stnd, a.c_stnd, a.d) == (pytest.approx(b.c_stnd), pytest.approx(b.b_stnd), pytest.approx(b.d))


def test_unpaired_visits_are_reported(spark):
    full = season_table(spark, [(0, "dry", "2", "fr01", "sp1", 1.0)])
    assert turnover.turnover(full, CFG).count() == 0
    assert [tuple(r) for r in turnover.unpaired_visits(full, CFG).collect()] == [(0, "fr01", "2 5", "5")]


@pytest.fixture(scope="module")
def survey_table(spark):
    rng = np.random.default_rng(5)
    rows = []
    for year in range(3):
        for site in range(12):
            for month in ("2", "5", "8", "11"):
                for sp in range(9):
                    n = float(rng.poisson(2 if sp else 20) * (rng.random() < 0.5))
                    if n or sp == 0:
                        rows.append((year, "dry" if month in "25" else "wet", month, f"fr{site:02d}", f"sp{sp}", n))
    return season_table(spark, rows)


def matrices(table, first="2", second="5"):
    pdf = table.toPandas()
    out = []
    for month in (first, second):
        m = pdf[pdf.month == month].pivot_table(index=["year_s", "refuge"], columns="species", values="count", fill_value=0)
        out.append(m.reindex(columns=[f"sp{i}" for i in range(9)], fill_value=0))
    keys = out[0].index.intersection(out[1].index)
    return np.log1p(out[0].loc[keys]), np.log1p(out[1].loc[keys])


def test_species_tests_match_brute_force(spark, survey_table):
    feb, may = matrices(survey_table)
    diff = may - feb
    got = change.species_tests(survey_table, CFG).toPandas().set_index("species")
    n = len(diff)
    for sp in got.index:
        d = diff[sp].to_numpy()
        assert got.loc[sp, "n_pairs"] == n
        assert got.loc[sp, "mean_diff"] == pytest.approx(d.mean())
        assert got.loc[sp, "t"] == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(n)))
    assert got.p_value_perm.between(1 / (CFG.n_perm + 1), 1).all()
    # permutation and parametric p-values estimate the same probability
    assert np.abs(got.p_value_perm - got.p_value_param).max() < 0.2


def test_sign_flip_hits_match_direct_enumeration(spark, survey_table):
    import hashlib

    feb, may = matrices(survey_table)
    diff = may - feb
    got = change.species_tests(survey_table, CFG).toPandas().set_index("species").p_value_perm
    signs = []
    for perm in range(CFG.n_perm):
        row = []
        for year, site in diff.index:
            bits = int(hashlib.md5(f"{CFG.seed}|{site}|{year}|{perm // 60}".encode()).hexdigest()[:15], 16)
            row.append(1 - 2 * (bits >> perm % 60 & 1))
        signs.append(row)
    sums = np.array(signs) @ diff.to_numpy()
    for i, sp in enumerate(diff.columns):
        hits = (np.abs(sums[:, i]) >= abs(diff[sp].sum()) - 1e-9).sum()
        assert got[sp] == pytest.approx((hits + 1) / (CFG.n_perm + 1))


def test_paired_golden(spark):
    table = pair(spark, (1, 1, 1), (1, 1, 1), site="x")
    rows = []
    for i, d in enumerate((1, 2, 3)):
        rows += [(0, "dry", "2", f"fr{i}", "sp1", 0.0), (0, "dry", "5", f"fr{i}", "sp1", math.expm1(d))]
    got = change.species_tests(season_table(spark, rows), SurveyConfig(n_perm=4000)).first()
    assert (got.mean_diff, got.t) == (pytest.approx(2), pytest.approx(3.464102, abs=1e-6))
    assert got.p_value_perm == pytest.approx(2 / 8, abs=0.03)
    assert change.species_tests(table, CFG).count() == 0  # no species varies


@pytest.mark.parametrize("per_bin", [100, 5])
def test_site_p_values_match_brute_force(spark, survey_table, monkeypatch, per_bin):
    monkeypatch.setattr(turnover, "SITES_PER_BIN", per_bin)
    feb, may = matrices(survey_table)
    got = turnover.turnover_p_values(survey_table, CFG, n_perm=2000).where("comparison = '2 5' AND NOT pa_tr").toPandas()
    got = got.set_index(["year_s", "refuge"]).loc[feb.index]
    rng = np.random.default_rng(0)
    a, b = feb.to_numpy(), may.to_numpy()

    def d(x, y):
        return np.abs(x - y).sum(1) / (x + y).sum(1)

    observed = d(a, b)
    assert got.d.to_numpy() == pytest.approx(observed)
    hits = np.zeros(len(a))
    for _ in range(2000):
        order = np.array([rng.permutation(len(a)) for _ in range(a.shape[1])]).T
        hits += d(np.take_along_axis(a, order, 0), np.take_along_axis(b, order, 0)) >= observed - 1e-9
    # full reshuffles estimate the same p-value as rotations and shifts do
    gap = got.p_value.to_numpy() - hits / 2000
    assert np.abs(gap).max() < 0.1 and abs(gap.mean()) < 0.02


def test_report_and_top_species(spark):
    rows = [(0, "dry", m, "fr01", f"sp{i}", float(n) / 2) for m in ("2", "5") for i, n in enumerate((40, 30, 20, 10))]
    full = season_table(spark, rows)
    names = spark.createDataFrame([(f"sp{i}", f"Name {i}") for i in range(4)], "species string, species_name string")
    assert change.top_species_text(full, names, threshold=0.5).first().species_list == "Name 0, and Name 1"
    occurrence = change.dry_season_occurrence(full, top=2).toPandas().set_index("species")
    assert occurrence.loc["sp0", "mean_count"] == 20.0 and occurrence.top.tolist().count(True) == 2


def test_occurrence_counts_empty_samplings(spark):
    rows = [(0, "dry", "2", "fr01", "sp1", 4.0), (0, "dry", "5", "fr01", "sp2", 1.0)]
    got = change.dry_season_occurrence(season_table(spark, rows)).toPandas().set_index("species")
    assert got.loc["sp1", "mean_count"] == 2.0 and got.loc["sp1", "perc_samplings"] == 0.5
    assert got.loc["sp1", "mean_count_pres"] == 4.0


def test_covariates_that_vary_do_not_multiply_catches(spark):
    catch = catches(spark, [("fr01", "oc02", "re1", "GN", "sp1", 4.0)])
    cov = spark.createDataFrame(
        [("fr01", "oc02", 0, "dry", "2", 1.0), ("fr01", "oc02", 0, "dry", "2", 2.0)],
        "refuge string, occasion string, year_s int, season string, month string, water_temp double",
    )
    full = effort.catch_by_season(catch, cov, CFG)
    assert [r["count"] for r in full.collect()] == [32.0]


def test_dropped_site_year(spark):
    catch = catches(spark, [("fr15", "oc02", "re1", "GN", "sp1", 4.0), ("fr15", "oc06", "re1", "GN", "sp1", 4.0)])
    cov = spark.createDataFrame(
        [("fr15", "oc02", 0, "dry", "2"), ("fr15", "oc06", 1, "dry", "2")],
        "refuge string, occasion string, year_s int, season string, month string",
    )
    assert [r.year_s for r in effort.catch_by_season(catch, cov, CFG).collect()] == [1]


