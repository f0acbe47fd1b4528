"""Community composition: grouping tests, constrained ordination, variation partitioning, concordance."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import special
from fieldtally.operators.lineage import cut
from fieldtally.operators.ordered import add_running, average_ranks, with_position
from fieldtally.operators.ordination import total_inertia
from fieldtally.operators.permutation import SIGNS_PER_BLOCK, TOLERANCE


def _filled(cells: DataFrame, rows: Sequence[str], column: str, value: str) -> DataFrame:
    """One row per filled cell."""
    return cells.where(F.col(value) > 0).groupBy(*rows, F.col(column).alias("_column")).agg(F.sum(value).cast("double").alias("_x"))


def _profiles(filled: DataFrame, rows: Sequence[str]) -> DataFrame:
    """Square roots of the row profiles: rows of length one, whose distances are Hellinger's."""
    totals = filled.groupBy(*rows).agg(F.sum("_x").alias("_r"))
    return filled.join(totals, list(rows)).select(*rows, "_column", F.sqrt(F.col("_x") / F.col("_r")).alias("_h"))


# --- grouping test ----------------------------------------------------------------


def composition_groups(cells: DataFrame, groups: DataFrame, *, rows: Sequence[str], column: str, value: str, group: str) -> DataFrame:
    """Sums of squares of a grouping of rows: `n, k, ss_total, ss_within, pseudo_f, r_squared`.

    `groups` gives each row its group; rows without filled cells or without group are left out. Distances are
    Hellinger's. The squared distances of m rows to their centroid add up to m - |sum of the rows|^2 / m, so
    sums per group and species are all that is needed: no pair of rows is formed.
    """
    return _facts(cut(_grouped(cells, groups, rows, column, value, group)), rows).drop("_between")


def _grouped(cells: DataFrame, groups: DataFrame, rows: Sequence[str], column: str, value: str, group: str) -> DataFrame:
    labelled = groups.where(F.col(group).isNotNull()).select(*rows, F.col(group).cast("string").alias("_group")).distinct()
    return _profiles(_filled(cells, rows, column, value), rows).join(labelled, list(rows))


def _facts(placed: DataFrame, rows: Sequence[str]) -> DataFrame:
    sizes = placed.select(*rows, "_group").distinct().groupBy("_group").agg(F.count(F.lit(1)).alias("_m"))
    sums = placed.groupBy("_group", "_column").agg(F.sum("_h").alias("_s")).join(sizes, "_group")
    between = sums.agg(F.sum(F.col("_s") * F.col("_s") / F.col("_m")).alias("_between")).scalar()
    squared = sums.groupBy("_column").agg(F.sum("_s").alias("_s")).agg(F.sum(F.col("_s") * F.col("_s"))).scalar()
    counted = sizes.agg(F.sum("_m").alias("n"), F.count(F.lit(1)).alias("k")).withColumns({"_between": between, "_squared": squared})
    total, within = F.col("n") - F.col("_squared") / F.col("n"), F.col("n") - F.col("_between")
    f = F.try_divide(F.try_divide(total - within, F.col("k") - 1), F.try_divide(within, F.col("n") - F.col("k")))
    return counted.select(
        "n", "k", total.alias("ss_total"), within.alias("ss_within"), f.alias("pseudo_f"), F.try_divide(total - within, total).alias("r_squared"), "_between"
    )


def composition_test(
    cells: DataFrame, groups: DataFrame, *, rows: Sequence[str], column: str, value: str, group: str, n_perm: int = 9999, seed: int = 0
) -> DataFrame:
    """`composition_groups` with `n_perm` and a permutation p-value (null with fewer than two groups).

    A permutation deals the groups anew. Rows are put in a random order, one for each block of 60 permutations,
    and the row at place k takes the group of place k + shift, with a random shift for each permutation. The total
    does not change, so the squares between groups decide. For each row, block and group one long tells
    which of the 60 permutations deal that group to the row; a block is 60 running sums in one aggregation buffer, combined
    before the exchange.
    """
    keys = list(rows)
    placed = cut(_grouped(cells, groups, rows, column, value, group))
    members = cut(placed.select(*keys, "_group").distinct())
    counts = members.groupBy("_group").agg(F.count(F.lit(1)).alias("_m"))
    starts = cut(add_running(counts, order=["_group"], sums={"_start": "_m"}))
    dealing = starts.agg(F.collect_list(F.struct("_start", "_m"))).scalar()  # one entry a group
    n = members.agg(F.count(F.lit(1))).scalar()
    blocks = math.ceil(n_perm / SIGNS_PER_BLOCK)

    drawn = members.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    drawn = drawn.withColumn("_draw", F.xxhash64(F.lit(seed), "_block", *keys))
    ordered = with_position(drawn, "_k", by=["_block"], order=["_draw", *keys])
    number = F.col("id") * SIGNS_PER_BLOCK
    shift = lambda p: F.pmod(F.xxhash64(F.lit(seed), F.lit("shift"), number + p), F.lit(1 << 40))
    shifts = members.sparkSession.range(blocks).select(
        F.col("id").cast("int").alias("_block"), F.transform(F.sequence(F.lit(0), F.lit(SIGNS_PER_BLOCK - 1)), shift).alias("_shifts")
    )
    at = ordered.join(shifts, "_block").withColumn("_n", n)
    at = at.select(*keys, "_block", F.transform("_shifts", lambda s: (F.col("_k") + s) % F.col("_n")).alias("_places"), F.explode(dealing).alias("_g"))
    inside = lambda p: (p >= F.col("_g._start")) & (p < F.col("_g._start") + F.col("_g._m"))
    bits = F.transform("_places", lambda p, i: F.when(inside(p), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    dealt = cut(at.select(*keys, "_block", "_g._start", "_g._m", F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)).alias("_bits")))
    sums = (
        placed.select(*keys, "_column", "_h")
        .join(dealt, keys)
        .groupBy("_block", "_column", "_start", "_m")
        .agg(*[F.sum(F.when(F.getbit("_bits", F.lit(p)) == 1, F.col("_h"))).alias(f"_p{p}") for p in range(SIGNS_PER_BLOCK)])
    )
    between = sums.groupBy("_block").agg(*[F.sum(F.col(f"_p{p}") * F.col(f"_p{p}") / F.col("_m")).alias(f"_p{p}") for p in range(SIGNS_PER_BLOCK)])
    facts = cut(_facts(placed, rows))
    seen = facts.select("_between").scalar()
    valid = F.least(F.lit(SIGNS_PER_BLOCK), F.lit(n_perm) - F.col("_block") * SIGNS_PER_BLOCK)
    reached = F.slice(F.array(*[F.col(f"_p{p}") for p in range(SIGNS_PER_BLOCK)]), F.lit(1), valid)
    hits = between.withColumn("_seen", seen).agg(F.sum(F.size(F.filter(reached, lambda b: b >= F.col("_seen") - TOLERANCE)))).scalar()
    p_value = F.when(F.col("k") > 1, (F.coalesce(hits, F.lit(0)) + 1) / F.lit(n_perm + 1))
    return facts.drop("_between").withColumns({"n_perm": F.lit(n_perm), "p_value": p_value})


# --- composition explained by covariates ------------------------------------------


@dataclass
class Constrained:
    """Inertia table, axes, species and site coordinates, and the predictors' correlations with the axes."""

    inertia: DataFrame
    axes: DataFrame
    variables: DataFrame
    scores: DataFrame
    predictors: DataFrame
    n_axes: int


def sweep(matrix: np.ndarray, pivots: Sequence[int], *, tolerance: float = 1e-9) -> tuple[np.ndarray, list[int]]:
    """Sweep a symmetric matrix on `pivots`; those that earlier ones explain are left out. Returns the pivots used.

    Afterwards the used block holds the negative inverse, the rest the residual moments.
    """
    swept, scale, used = matrix.astype(float).copy(), np.abs(np.diag(matrix)), []
    for k in pivots:
        d = swept[k, k]
        if d <= tolerance * scale[k] or d <= 0:
            continue
        row = swept[k].copy()
        swept -= np.outer(row, row) / d
        swept[k], swept[:, k] = row / d, row / d
        swept[k, k] = -1 / d
        used.append(k)
    return swept, used


def _upper(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _symmetric(cells: Sequence[float], p: int) -> np.ndarray:
    out = np.zeros((p, p))
    for (i, j), v in zip(_upper(p), cells):
        out[i, j] = out[j, i] = v
    return out


def _with_predictors(filled: DataFrame, covariates: DataFrame, rows: Sequence[str], design: Mapping[str, Column]) -> DataFrame:
    """Filled cells with their row's predictors `_x0`, `_x1`, ...; rows that miss one are left out."""
    columns = [F.col(r) for r in rows] + [c.cast("double").alias(f"_x{i}") for i, c in enumerate(design.values())]
    return filled.join(covariates.select(*columns).dropna().distinct(), list(rows))


def constrained_ordination(
    cells: DataFrame, covariates: DataFrame, *, rows: Sequence[str], column: str, value: str, design: Mapping[str, Column], n_axes: int = 2
) -> Constrained:
    """Canonical correspondence analysis of long, sparse counts on row covariates.

    The chi-squared table is regressed on the covariates, weighted by row mass, and the fitted part is
    decomposed. With p covariates that takes two p x p matrices: their weighted moments G, and the moments M of
    the species' weighted sums of centred covariates, in which empty cells vanish. Eigenvalues are those of G^-1/2 M G^-1/2;
    only G and M come to the driver. `design` names the predictors (no intercept, see
    `models.design_columns`); rows that miss one are left out of all figures; aliased predictors do no harm.
    """
    spark, names, keys = cells.sparkSession, list(design), list(rows)
    p = len(names)
    x = [F.col(f"_x{i}") for i in range(p)]
    held = cut(_with_predictors(_filled(cells, rows, column, value), covariates, rows, design))
    masses = cut(held.groupBy(*keys, *x).agg(F.sum("_x").alias("_r")))
    total, *means = masses.agg(F.sum("_r"), *[F.sum(F.col("_r") * c) / F.sum("_r") for c in x]).first()
    if total is None:
        raise ValueError("no row has filled cells and all predictors")
    centred = [c - F.lit(float(m)) for c, m in zip(x, means)]
    share = F.lit(float(total))
    gram = _symmetric(masses.agg(*[F.sum(F.col("_r") * centred[i] * centred[j]) / share for i, j in _upper(p)]).first(), p)
    sums = held.groupBy("_column").agg((F.sum("_x") / share).alias("mass"), *[(F.sum(F.col("_x") * c) / share).alias(f"_c{i}") for i, c in enumerate(centred)])
    sums = cut(sums)
    cross = _symmetric(sums.agg(*[F.sum(F.col(f"_c{i}") * F.col(f"_c{j}") / F.col("mass")) for i, j in _upper(p)]).first(), p)

    sizes, turns = np.linalg.eigh(gram / np.sqrt(np.outer(np.diag(gram), np.diag(gram)).clip(1e-300)))
    kept = sizes > 1e-9 * max(1.0, sizes.max())
    root = turns[:, kept] / np.sqrt(sizes[kept]) / np.sqrt(np.diag(gram).clip(1e-300))[:, None]  # G^-1/2 without aliased directions
    values, vectors = np.linalg.eigh(root.T @ cross @ root)
    order = np.argsort(values)[::-1]
    values, weights = values[order].clip(0), root @ vectors[:, order]
    largest = np.abs(gram @ weights).argmax(axis=0)
    weights = weights * np.sign((gram @ weights)[largest, range(weights.shape[1])])
    fitted, k = float(values.sum()), min(n_axes, int((values > 1e-12).sum()))

    every = total_inertia(held, rows=keys, column="_column", value="_x").first()["inertia"]
    inertia = spark.createDataFrame([(float(every), fitted, float(every) - fitted, fitted / every if every else None)], "total double, constrained double, residual double, share double")
    axes = spark.createDataFrame(
        [(a + 1, float(v), float(v / fitted) if fitted else None) for a, v in enumerate(values) if v > 1e-12], "axis int, eigenvalue double, share double"
    )
    project = lambda parts, a: sum((c * F.lit(float(weights[i, a])) for i, c in enumerate(parts)), F.lit(0.0))
    species = [F.col(f"_c{i}") / F.col("mass") for i in range(p)]
    variables = sums.select(F.col("_column").alias(column), "mass", *[project(species, a).alias(f"dim_{a + 1}") for a in range(k)])
    scores = masses.select(
        *keys, (F.col("_r") / share).alias("mass"), *[(project(centred, a) * F.lit(float(np.sqrt(values[a])))).alias(f"dim_{a + 1}") for a in range(k)]
    )
    spread = np.sqrt(np.diag(gram).clip(1e-300))
    predictors = spark.createDataFrame(
        [(names[i], a + 1, float((gram @ weights)[i, a] / spread[i])) for i in range(p) for a in range(k)], "variable string, axis int, correlation double"
    )
    return Constrained(inertia, axes, variables, scores, predictors, k)


def variation_partition(
    cells: DataFrame, covariates: DataFrame, *, rows: Sequence[str], column: str, value: str, groups: Mapping[str, Mapping[str, Column]]
) -> DataFrame:
    """How much of the composition do groups of covariates explain, alone and shared?

    `part, kind, n_terms, r_squared, adj_r_squared`: a `union` of groups is the redundancy analysis of Hellinger values on all
    its covariates; a `fraction` is what exactly the groups named share, by inclusion and exclusion of adjusted
    R2 over unions; `residual` is the rest. The covariates' moments and the moments of the species' sums are read
    once; a union is a sweep of those. Rows that miss a covariate are left out; aliased covariates count once.
    """
    design = {f"{g}:{name}": c for g, columns in groups.items() for name, c in columns.items()}
    p, keys = len(design), list(rows)
    x = [F.col(f"_x{i}") for i in range(p)]
    held = cut(_with_predictors(_profiles(_filled(cells, rows, column, value), rows), covariates, rows, design))
    sites = cut(held.select(*keys, *x).distinct())
    n, *means = sites.agg(F.count(F.lit(1)), *[F.avg(c) for c in x]).first()
    if not n:
        raise ValueError("no row has filled cells and all covariates")
    centred = [c - F.lit(float(m)) for c, m in zip(x, means)]
    gram = _symmetric(sites.agg(*[F.sum(centred[i] * centred[j]) for i, j in _upper(p)]).first(), p)
    sums = cut(held.groupBy("_column").agg(F.sum("_h").alias("_s"), *[F.sum(F.col("_h") * c).alias(f"_c{i}") for i, c in enumerate(centred)]))
    squared, *cross = sums.agg(F.sum(F.col("_s") * F.col("_s")), *[F.sum(F.col(f"_c{i}") * F.col(f"_c{j}")) for i, j in _upper(p)]).first()
    cross, spread = _symmetric(cross, p), n - squared / n

    owner = [g for g, columns in groups.items() for _ in columns]
    fits: dict[frozenset, tuple[int, float, float]] = {frozenset(): (0, 0.0, 0.0)}
    for size in range(1, len(groups) + 1):
        for chosen in combinations(groups, size):
            swept, used = sweep(gram, [i for i in range(p) if owner[i] in chosen])
            r2 = float(-(swept[np.ix_(used, used)] * cross[np.ix_(used, used)]).sum() / spread) if spread > 0 else 0.0
            dof = n - 1 - len(used)
            fits[frozenset(chosen)] = len(used), r2, 1 - (1 - r2) * (n - 1) / dof if dof > 0 else float("nan")
    every = frozenset(groups)
    out = [(" + ".join(g for g in groups if g in s), "union", *fit) for s, fit in fits.items() if s]
    for size in range(1, len(groups) + 1):
        for shared in combinations(groups, size):
            rest, total = every - set(shared), 0.0
            for k in range(size + 1):
                total += sum((-1.0) ** (k + 1) * fits[rest | set(u)][2] for u in combinations(shared, k))
            out.append((" + ".join(shared), "fraction", None, None, total))
    out.append(("residual", "fraction", None, None, 1 - fits[every][2]))
    return cells.sparkSession.createDataFrame(out, "part string, kind string, n_terms int, r_squared double, adj_r_squared double")


# --- concordance -------------------------------------------------------------------


def _deviations(cells: DataFrame, objects: Sequence[str], judge: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Ranks that judges give to the objects they hold, less the rank of the objects they do not; and the judges' facts.

    Absent objects tie at the bottom, (z + 1) / 2 for z of them, so no zero cell is formed.
    """
    filled = cut(_filled(cells, objects, judge, value))
    n = filled.select(*objects).distinct().agg(F.count(F.lit(1))).scalar()
    ranks = cut(average_ranks(filled, by=["_column"], value="_x"))
    ties = ranks.groupBy("_column").agg(F.sum("n_ties").alias("_held"), F.sum(F.pow(F.col("n_ties").cast("double"), 3) - F.col("n_ties")).alias("_ties"))
    absent = (F.col("_n") - F.col("_held")).cast("double")
    judges = ties.withColumn("_n", n).select("_column", "_n", absent.alias("_z"), (F.col("_ties") + F.pow(absent, 3) - absent).alias("_ties"))
    judges = cut(judges)
    ranked = filled.join(ranks, ["_column", "_x"]).join(judges, "_column")
    return cut(ranked.select(*objects, "_column", "_n", (F.col("_z") + F.col("rank") - (F.col("_z") + 1) / 2).alias("_dev"))), judges


def concordance(cells: DataFrame, *, objects: Sequence[str], judge: str, value: str) -> DataFrame:
    """Kendall's W over tie-corrected ranks: `n_objects, n_judges, w, chi_squared, f_statistic`.

    Objects are the rows with filled cells; a judge ranks an object it does not hold lowest.
    """
    return _agreement(*_deviations(cells, objects, judge, value), objects).drop("_squares")


def _agreement(deviations: DataFrame, judges: DataFrame, objects: Sequence[str]) -> DataFrame:
    sums = deviations.groupBy(*objects).agg(F.sum("_dev").alias("_d"))
    facts = judges.agg(F.max("_n").alias("n_objects"), F.count(F.lit(1)).alias("n_judges"), F.sum((F.col("_z") + 1) / 2).alias("_base"), F.sum("_ties").alias("_ties"))
    n, m = F.col("n_objects").cast("double"), F.col("n_judges").cast("double")
    squares = sums.agg(F.sum(F.col("_d") * F.col("_d"))).scalar()
    total = sums.agg(F.sum("_d")).scalar()
    facts = facts.withColumns({"_squares": squares, "_total": total})
    spread = n * F.col("_base") * F.col("_base") + 2 * F.col("_base") * F.col("_total") + F.col("_squares") - n * F.pow(m * (n + 1) / 2, 2)
    w = F.try_divide(12 * spread, m * m * (F.pow(n, 3) - n) - m * F.col("_ties"))
    return facts.where("n_judges > 0").withColumn("w", w).select(
        "n_objects", "n_judges", "w", (m * (n - 1) * F.col("w")).alias("chi_squared"), F.try_divide((m - 1) * F.col("w"), 1 - F.col("w")).alias("f_statistic"), "_squares"
    )


def concordance_test(cells: DataFrame, *, objects: Sequence[str], judge: str, value: str, n_perm: int = 9999, seed: int = 0) -> DataFrame:
    """`concordance` with an F and a permutation p-value.

    A permutation moves each judge's ranks: objects are put in a random order, one per permutation, and every judge's ranks
    are rotated along it by an offset of its own. The squared rank sums decide, since nothing else changes; a cell is sent
    to its new place, and places are added up map-side.
    """
    deviations, judges = _deviations(cells, objects, judge, value)
    facts = cut(_agreement(deviations, judges, objects))
    members = deviations.select(*objects).distinct()
    drawn = members.withColumn("_perm", F.explode(F.sequence(F.lit(1), F.lit(n_perm)))).withColumn("_draw", F.xxhash64(F.lit(seed), "_perm", *objects))
    ordered = cut(with_position(drawn, "_k", by=["_perm"], order=["_draw", *objects]).drop("_draw"))
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), "_perm", "_column"), F.lit(1 << 40))
    moved = deviations.join(ordered, list(objects)).select("_perm", ((F.col("_k") + offset) % F.col("_n")).alias("_place"), "_dev")
    squares = moved.groupBy("_perm", "_place").agg(F.sum("_dev").alias("_d")).groupBy("_perm").agg(F.sum(F.col("_d") * F.col("_d")).alias("_squares"))
    seen = facts.select("_squares").scalar()
    hits = squares.withColumn("_seen", seen).agg(F.count(F.when(F.col("_squares") >= F.col("_seen") * (1 - 1e-12), 1))).scalar()
    n, m = F.col("n_objects").cast("double"), F.col("n_judges").cast("double")
    first = n - 1 - 2 / m
    return facts.drop("_squares").withColumns(
        {"p_value_f": special.f_p(F.col("f_statistic"), first, first * (m - 1)), "n_perm": F.lit(n_perm), "p_value_perm": (hits + 1) / F.lit(n_perm + 1)}
    )
