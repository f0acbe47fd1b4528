"""Best subsets of predictors by branch and bound over one swept moment matrix."""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.operators.lineage import cut
from fieldtally.operators.models import design_columns

TINY = 1e-9


@dataclass
class Moments:
    """Cross-products of the design and the response within random-effect groups or over all rows, and what they were taken from."""

    matrix: np.ndarray  # terms first, the response last
    blocks: list[list[int]]  # columns of each predictor
    names: list[str]
    n: int
    fixed: int  # parameters that every model has besides its predictors' columns


def predictor_columns(frame: DataFrame, predictors: Sequence[str]) -> dict[str, dict[str, Column]]:
    """Columns of each predictor: a number as it is, a text as treatment contrasts of its levels, which are read once for all."""
    kinds = dict(frame.dtypes)
    texts = [p for p in predictors if kinds[p] == "string"]
    levels = frame.agg(*[F.array_sort(F.collect_set(t)).alias(t) for t in texts]).first() if texts else {}
    out = {}
    for p in predictors:
        if p in texts:
            contrasts = design_columns({p: levels[p]}, [])
            out[p] = {k: c for k, c in contrasts.items() if k != "(Intercept)"}
        else:
            out[p] = {p: F.col(p).cast("double")}
    return out


def moments(frame: DataFrame, responses: Mapping[str, Column], design: Mapping[str, Mapping[str, Column]], *, within: str | None = None) -> dict[str, Moments]:
    """Centred cross-products for every response, from one pass over the rows that are complete in all predictors.

    `within` names groups whose means are taken out (a fixed intercept each). Rows missing a response do not count for it.
    """
    columns = [c for block in design.values() for c in block.values()]
    p = len(columns)
    x = [F.col(f"_x{i}") for i in range(p)]
    group = F.col(within) if within else F.lit(0)
    held = frame.select(group.alias("_g"), *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(columns)], *[c.cast("double").alias(f"_y_{name}") for name, c in responses.items()])
    held = cut(held.dropna(subset=["_g", *[f"_x{i}" for i in range(p)]]))
    places, at = [], 0
    for block in design.values():
        places.append(list(range(at, at + len(block))))
        at += len(block)
    out = {}
    for name in responses:
        z = [*x, F.col(f"_y_{name}")]
        cells = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
        rows = held.where(F.col(f"_y_{name}").isNotNull())
        # moments about the groups' means, which are joined back so that large means do not cancel
        means = rows.groupBy("_g").agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(z)])
        centred = rows.join(means, "_g").select(*[(c - F.col(f"_m{i}")).alias(f"_z{i}") for i, c in enumerate(z)])
        *sums, n = centred.agg(*[F.sum(F.col(f"_z{i}") * F.col(f"_z{j}")) for i, j in cells], F.count(F.lit(1))).first()
        matrix = np.zeros((p + 1, p + 1))
        for (i, j), v in zip(cells, sums):
            matrix[i, j] = matrix[j, i] = v or 0.0
        out[name] = Moments(matrix, places, list(design), n, means.count())
    return out


def _without(matrix: np.ndarray, block: Sequence[int], scale: np.ndarray) -> tuple[np.ndarray, int]:
    """The moments that remain when a block of columns is regressed out, and its rank."""
    left, rank = matrix, 0
    for k in block:
        d = left[k, k]
        if d > TINY * scale[k]:
            left = left - np.outer(left[k], left[k]) / d
            rank += 1
    return left, rank


def _score(rss: float, n: int, terms: int) -> float:
    """Corrected Akaike criterion of a Gaussian model with so many coefficients; infinite where it is not defined."""
    k = terms + 1  # the variance
    if n - k - 1 <= 0:
        return math.inf
    return n * math.log(max(rss, 1e-300) / n) + n * (1 + math.log(2 * math.pi)) + 2 * k + 2 * k * (k + 1) / (n - k - 1)


def best_subsets(held: Moments, *, most: int = 100) -> tuple[list[tuple[float, int, frozenset]], int]:
    """The `most` best subsets of predictors as (criterion, coefficients, predictors), best first, and the models looked at.

    A branch decides predictors one after another, by their strength: in or out. The best that a branch can reach is the
    residual with all its undecided predictors in, at the price of those decided in; a branch that
    cannot beat the last of the best so far is given up. Taking a predictor in regresses its block of columns out of the matrix; the
    residual of a branch that leaves one out comes from sweeping the undecided ones alone. Aliased columns cost nothing.
    """
    scale = np.abs(np.diag(held.matrix)).clip(TINY)
    last = len(held.matrix) - 1
    alone = [_without(held.matrix, b, scale)[0][last, last] for b in held.blocks]
    order = sorted(range(len(held.blocks)), key=lambda b: alone[b])
    best: list[tuple[float, int, frozenset]] = []  # a heap, the worst first
    looked = 0

    def offer(score: float, terms: int, chosen: frozenset) -> None:
        entry = (-score, -terms, chosen)
        if len(best) < most:
            heapq.heappush(best, entry)
        elif entry[:2] > best[0][:2]:
            heapq.heapreplace(best, entry)

    def floor(matrix: np.ndarray, undecided: Sequence[int]) -> float:
        left = matrix
        for b in undecided:
            left, _ = _without(left, held.blocks[b], scale)
        return left[last, last]

    root = held.matrix
    stack = [(0, root, held.fixed, frozenset(), floor(root, order))]
    offer(_score(root[last, last], held.n, held.fixed), held.fixed, frozenset())
    while stack:
        depth, matrix, terms, chosen, lowest = stack.pop()
        if depth == len(order):
            continue
        if len(best) == most and _score(lowest, held.n, terms) >= -best[0][0]:
            continue
        looked += 1
        b, rest = order[depth], order[depth + 1 :]
        stack.append((depth + 1, matrix, terms, chosen, floor(matrix, rest)))
        taken, rank = _without(matrix, held.blocks[b], scale)
        if rank:
            inside = chosen | {held.names[b]}
            offer(_score(taken[last, last], held.n, terms + rank), terms + rank, inside)
            stack.append((depth + 1, taken, terms + rank, inside, lowest))
    return [(-s, -t, c) for s, t, c in sorted(best, key=lambda e: (-e[0], -e[1], sorted(e[2])))], looked


def subset_search(
    frame: DataFrame, responses: Mapping[str, Column], predictors: Sequence[str], *, within: str | None = None, most: int = 100
) -> DataFrame:
    """The best models of every response: `response, model, n, n_terms, aicc, weight`, weights among those returned.

    All subsets of `predictors` compete, however many; factors enter and leave with all their contrasts. The rows
    are read once into moments; the search runs on those and proves that no subset left out is better. Rows that miss a
    predictor are left out.
    """
    design = predictor_columns(frame, predictors)
    out = []
    for name, held in moments(frame, responses, design, within=within).items():
        if not held.n:
            continue
        found, _ = best_subsets(held, most=most)
        found = [(s, t, c) for s, t, c in found if s < math.inf]
        relative = [math.exp(-0.5 * (s - found[0][0])) for s, *_ in found]
        for (score, terms, chosen), share in zip(found, relative):
            model = f"{name} ~ 1" + "".join(f" + {p}" for p in predictors if p in chosen)
            out.append((name, model, held.n, terms, score, share / sum(relative)))
    return frame.sparkSession.createDataFrame(out, "response string, model string, n long, n_terms int, aicc double, weight double")
