"""Alpha diversity."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import numbers
from fieldtally.operators import reshape
from fieldtally.operators.lineage import cut

SITE_VISIT = ("refuge", "occasion", "gear")


def alpha_diversity(
    totals: DataFrame,
    *,
    values_from: str = "no_fish",
    transform: str = "I",
    index: str = "shannon",
    base: float = math.e,
) -> DataFrame:
    """Diversity per site visit from long catch totals.

    One aggregation: Shannon is `ln T - sum(v ln v) / T`, Simpson `1 - sum(v^2) / T^2`.
    A single species has exactly 0, free of rounding, since later steps test for 0.
    A visit without catch has Shannon 0, Simpson 1 and an infinite inverse, as
    when proportions are taken over a row of zeros.
    """
    value = numbers.TRANSFORMS[transform](F.coalesce(F.col(values_from), F.lit(0.0)))
    has_effort = "n_samples" in totals.columns
    sums = (
        totals.withColumn("_v", value)
        .groupBy(*SITE_VISIT)
        .agg(
            F.sum("_v").alias("_total"),
            F.sum(F.when(F.col("_v") > 0, F.col("_v") * F.ln("_v")).otherwise(0.0)).alias("_vlogv"),
            F.sum(F.col("_v") * F.col("_v")).alias("_squares"),
            F.count(F.when(F.col("_v") > 0, 1)).alias("_present"),
            *([F.max("n_samples").alias("n_samples")] if has_effort else []),
        )
    )
    total, concentration = F.col("_total"), F.try_divide(F.col("_squares"), F.col("_total") * F.col("_total"))
    caught = total > 0
    if index == "shannon":
        entropy = (F.ln(F.when(caught, total)) - F.try_divide(F.col("_vlogv"), total)) / math.log(base)
        alpha = F.when(F.col("_present") > 1, F.greatest(entropy, F.lit(0.0))).otherwise(0.0)
    elif index == "simpson":
        alpha = F.when(caught, 1 - concentration).otherwise(1.0)
    elif index == "invsimpson":
        alpha = F.when(caught, F.try_divide(F.lit(1.0), concentration)).otherwise(F.lit(math.inf))
    else:
        raise ValueError(f"unknown diversity index: {index}")
    return sums.select(
        *SITE_VISIT,
        alpha.alias("diversity_alpha"),
        F.lit(index).alias("index"),
        F.lit(float(base)).alias("base"),
        F.lit(transform).alias("transform_fun"),
        *(["n_samples"] if has_effort else []),
    )


def diversity_frame(diversity: DataFrame, occasions: DataFrame, refuges: DataFrame) -> DataFrame:
    """Diversity with visit and site covariates."""
    return diversity.join(occasions, ["refuge", "occasion"], "left").join(refuges, "refuge", "left")


def diversity_by_month(
    frame: DataFrame, refuges: DataFrame | None = None, *, months: tuple[str, ...] = ("m_2", "m_5", "m_8", "m_11")
) -> DataFrame:
    """One column per visit month; visits with no diversity in May are left out."""
    wide = reshape.to_wide(
        frame, keys=["refuge", "year", "n_samples"], names="month_s", values="diversity_alpha",
        levels=months, fill=None,
    )
    if refuges is not None:
        wide = wide.join(refuges, "refuge", "left")
    return wide.where(F.col("m_5") != 0)


def evenness(totals: DataFrame, *, values_from: str = "no_fish") -> DataFrame:
    """Hill numbers of each site visit's catch and their ratios to richness and to each other.

    `hill_1` is the exponential of Shannon's index, `hill_2` the inverse of Simpson's concentration. Visits without catch are left out.
    """
    v = F.col(values_from).cast("double")
    sums = totals.where(v > 0).groupBy(*SITE_VISIT, "species").agg(F.sum(v).alias("_v")).groupBy(*SITE_VISIT).agg(
        F.count(F.lit(1)).alias("richness"), F.sum("_v").alias("_t"), F.sum(F.col("_v") * F.ln("_v")).alias("_vlogv"), F.sum(F.col("_v") * F.col("_v")).alias("_vv")
    )
    first = F.exp(F.ln("_t") - F.col("_vlogv") / F.col("_t"))
    second = F.col("_t") * F.col("_t") / F.col("_vv")
    return sums.select(*SITE_VISIT, "richness", first.alias("hill_1"), second.alias("hill_2")).withColumns(
        {
            "shannon_evenness": F.col("hill_1") / F.col("richness"),
            "simpson_evenness": F.col("hill_2") / F.col("richness"),
            "hill_ratio": F.col("hill_2") / F.col("hill_1"),
        }
    )


def relative_importance(totals: DataFrame, *, by: Sequence[str], visit: Sequence[str], column: str = "species") -> DataFrame:
    """Index of relative importance: (share of numbers + share of weight) x share of visits, in percent, and its share within `by`.

    A group without numbers or weight has NULL for that share and the index; a visit counts as soon as it has a row.
    """
    cells = totals.groupBy(*by, *visit, column).agg(F.sum("no_fish").cast("double").alias("_n"), F.sum("total_weight").cast("double").alias("_w"))
    cells = cut(cells)
    parts = cells.groupBy(*by, column).agg(F.sum("_n").alias("_n"), F.sum("_w").alias("_w"), F.count(F.when(F.col("_n") > 0, 1)).alias("_v"))
    whole = parts.groupBy(*by).agg(F.sum("_n").alias("_nn"), F.sum("_w").alias("_ww"))
    visits = cells.select(*by, *visit).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_vv"))
    share = lambda a, b: F.try_divide(F.lit(100.0) * F.col(a), F.col(b))
    scored = parts.join(whole, list(by)).join(visits, list(by)).select(
        *by, column, share("_n", "_nn").alias("number_pct"), share("_w", "_ww").alias("weight_pct"), share("_v", "_vv").alias("frequency_pct")
    )
    scored = cut(scored.withColumn("iri", (F.col("number_pct") + F.col("weight_pct")) * F.col("frequency_pct")))
    return scored.join(scored.groupBy(*by).agg(F.sum("iri").alias("_iri")), list(by)).withColumn("iri_pct", share("iri", "_iri")).drop("_iri")
