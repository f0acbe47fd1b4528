"""Catch totals corrected for uneven sampling effort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.config import SurveyConfig
from fieldtally.functions import numbers

CATCH_MEASURES = ("no_fish", "total_weight")


def max_replicates(catch: DataFrame, config: SurveyConfig = SurveyConfig()) -> DataFrame:
    """Largest number of replicates on any one visit, per site (primary gear)."""
    return (
        catch.where(F.col("gear") == config.primary_gear)
        .groupBy("refuge", "occasion")
        .agg(F.countDistinct("replicate").alias("n_samples"))
        .groupBy("refuge")
        .agg(F.max("n_samples").alias("n_samples"))
    )


def _raw_totals(catch: DataFrame, config: SurveyConfig) -> DataFrame:
    summed = (
        catch.where(F.col("gear") == config.primary_gear)
        .groupBy("refuge", "occasion", "gear", "species")
        .agg(*[F.coalesce(F.sum(m).cast("double"), F.lit(0.0)).alias(m) for m in CATCH_MEASURES])
    )
    return summed.join(max_replicates(catch, config), "refuge")


def _scaled(measure: str, config: SurveyConfig) -> Column:
    return numbers.half_even(F.col(measure) / F.col("n_samples") * config.standard_effort)


def effort_totals(catch: DataFrame, config: SurveyConfig = SurveyConfig(), *, standard: bool = True) -> DataFrame:
    """Catch per (site, visit, gear, species), summed over replicates.

    With `standard`, counts are scaled to the standard number of replicates.
    """
    totals = _raw_totals(catch, config)
    if not standard:
        return totals
    return totals.withColumns({m: _scaled(m, config) for m in CATCH_MEASURES})


def tagged_effort_totals(catch: DataFrame, config: SurveyConfig = SurveyConfig()) -> DataFrame:
    """Standardised and raw totals stacked, told apart by `standard` (one pass)."""
    versions = F.array(
        F.struct(F.lit("standard_totals").alias("standard"), *[_scaled(m, config).alias(m) for m in CATCH_MEASURES]),
        F.struct(F.lit("raw_totals").alias("standard"), *[F.col(m) for m in CATCH_MEASURES]),
    )
    return _raw_totals(catch, config).select(
        "refuge", "occasion", "gear", "species", "n_samples", F.inline(versions)
    )


def mean_scaled_totals(catch: DataFrame, config: SurveyConfig = SurveyConfig()) -> DataFrame:
    """The older standardisation: mean over records times the standard effort, all gears."""
    return catch.groupBy("refuge", "occasion", "gear", "species").agg(
        *[
            F.coalesce(numbers.half_even(F.avg(F.col(m)).cast("double") * config.standard_effort), F.lit(0.0)).alias(m)
            for m in CATCH_MEASURES
        ]
    )


def catch_by_season(catch: DataFrame, covariates: DataFrame, config: SurveyConfig = SurveyConfig()) -> DataFrame:
    """Standardised counts per (flood year, season, month, site, species), long and sparse.

    Species without a row count as zero. Only the calendar columns of the
    covariates are joined, so covariates that vary within a visit cannot
    multiply catches.
    """
    calendar = covariates.select("refuge", "occasion", "year_s", "season", "month").distinct()
    joined = effort_totals(catch, config).join(calendar, ["refuge", "occasion"], "left")
    kept = joined.where(F.col("year_s") < config.complete_years)
    for refuge, year in config.dropped_site_years:
        kept = kept.where(~((F.col("refuge") == refuge) & (F.col("year_s") == year)))
    return kept.groupBy("year_s", "season", "month", "refuge", "species").agg(F.sum("no_fish").alias("count"))
