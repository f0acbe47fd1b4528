"""Dimension tables, catch facts and covariate tables from the clean fact table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.config import SurveyConfig
from fieldtally.functions import calendar, labels, numbers, text

# Columns of each derived table.
REFUGE_COLUMNS = (
    "refuge", "cfr_name", "village", "commune", "district", "province", "agro_eco_zone", "fia_designated",
    "category", "category_name", "large_water_body", "channel_type", "type_inlet_outlet", "shape",
    "area_dry_ha", "area_wet_ha", "conservation_ha", "depth_dry_m", "depth_wet_m",
    "dist_channel_connect_cfr_rf_m", "dist_market", "dist_prov_capital", "dist_village",
    "lwb_area_dry_ha", "lwb_area_wet_ha", "lwb_depth_dry_m", "lwb_depth_wet_m",
    "no_channel", "no_inlet_outlet", "drought_freq", "flooding_freq",
    "rf_area_connected_in_wet_season_ha", "rf_area_connected_in_dry_season_ha",
)
OCCASION_COLUMNS = (
    "refuge", "occasion", "sampling", "date", "total_hours", "gauge_start", "gauge_finish", "rf_water_level",
    "water_temp", "secchi_depth", "phosphate", "nitrogen", "conductivity", "aquatic_plant_area",
    "aquatic_plant_density", "brush_park", "illegal_fishing", "water_bird", "other_animal", "weather",
)
SAMPLING_COLUMNS = (
    "refuge", "occasion", "replicate", "gear", "sampling", "gear_name", "net_length", "net_area",
    "depth_shore", "depth_end", "time_in", "duration",
)
SPECIES_COLUMNS = ("species_name", "species_code", "family", "genus", "group", "type", "species")
CATCH_COLUMNS = (
    "refuge", "occasion", "replicate", "gear", "sampling", "no_fish", "total_weight", "species",
    "min_length", "max_length", "min_weight", "max_weight", "mean_weight",
)
CATCH_SUM_COLUMNS = ("refuge", "occasion", "replicate", "gear", "species", "no_fish", "total_weight")
CASTING_COLUMNS = (
    "refuge", "occasion", "replicate", "gear_name", "gear", "net_length", "net_area", "depth_shore", "depth_end",
)
LOGGED_REFUGE_COLUMNS = (
    "area_dry_ha", "area_wet_ha", "conservation_ha", "depth_dry_m", "depth_wet_m",
    "dist_channel_connect_cfr_rf_m", "dist_market", "dist_prov_capital", "dist_village",
    "lwb_area_dry_ha", "lwb_area_wet_ha", "lwb_depth_dry_m", "lwb_depth_wet_m",
    "rf_area_connected_in_dry_season_ha", "rf_area_connected_in_wet_season_ha",
)
TURNOVER_REFUGE_COLUMNS = (
    "refuge", "cfr_name", "category_name", "large_water_body", "channel_type", "shape", "type_inlet_outlet",
    "no_inlet_outlet", "lwb_depth_dry_m", "lwb_area_wet_ha", "no_channel",
    "rf_area_connected_in_dry_season_ha", "rf_area_connected_in_wet_season_ha", "dist_village", "dist_market",
)
TURNOVER_OCCASION_MEASURES = (
    "occasion", "month", "season", "aquatic_plant_area", "gauge_start", "water_temp", "phosphate", "brush_park",
    "illegal_fishing", "other_animal", "water_bird",
)


def refuge_info(clean: DataFrame) -> DataFrame:
    sites = clean.select(*REFUGE_COLUMNS).distinct()
    return sites.withColumn("category_name", text.strip_parenthesis(F.col("category_name")))


def occasion_info(clean: DataFrame) -> DataFrame:
    capped = clean.select(*OCCASION_COLUMNS).withColumn(
        "aquatic_plant_density", numbers.cap(F.col("aquatic_plant_density"), 100)
    )
    return capped.distinct()


def sampling_info(clean: DataFrame) -> DataFrame:
    return clean.select(*SAMPLING_COLUMNS).distinct()


def lump_top(df: DataFrame, column: str, n: int, *, name: str, other: str = "Other") -> DataFrame:
    """Keep the `n` most frequent levels (ties at the last place too), call the rest `other`.

    The cut is the n-th largest level count, found by an ordered limit of `n`
    counts, so no window runs over the levels.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_count"))
    cut = counts.select("_count").orderBy(F.desc("_count")).limit(n).agg(F.min("_count")).scalar()
    kept = counts.where(F.col("_count") >= cut).select(column, F.lit(True).alias("_kept"))
    flagged = df.join(kept, column, "left")
    lumped = F.when(F.col("_kept"), F.col(column)).when(F.col(column).isNotNull(), other)
    return flagged.withColumn(name, lumped).drop("_kept").select(*df.columns, name)


def species_info(clean: DataFrame, config: SurveyConfig = SurveyConfig()) -> DataFrame:
    distinct = clean.select(*SPECIES_COLUMNS).distinct()
    return lump_top(distinct, "type", config.n_fish_types, name="species_type_simple")


def catch_info(clean: DataFrame) -> DataFrame:
    return clean.select(*CATCH_COLUMNS)


def catch_sums(clean: DataFrame) -> DataFrame:
    """What totals need of catches that were summed before."""
    return clean.select(*CATCH_SUM_COLUMNS)


def casting_info(clean: DataFrame) -> DataFrame:
    """Net settings per gear and replicate."""
    return clean.select(*CASTING_COLUMNS).distinct()


def _with_calendar(occasions: DataFrame, config: SurveyConfig) -> DataFrame:
    month = calendar.month_text(F.col("date"))
    return occasions.withColumns(
        {
            "year": calendar.year_text(F.col("date")),
            "month": month,
            "season": calendar.season(F.col("date"), config.dry_months),
            "year_s": calendar.flood_year(F.col("occasion")),
            "month_s": calendar.month_key(month),
        }
    )


def occasion_covariates(occasions: DataFrame, config: SurveyConfig = SurveyConfig()) -> DataFrame:
    return (
        _with_calendar(occasions, config)
        .withColumns(
            {
                "water_level": (F.col("gauge_start") + F.col("gauge_finish")) / 2,
                "visibility": F.col("secchi_depth"),
                "aquatic_plant_index": F.col("aquatic_plant_area") * F.col("aquatic_plant_density"),
            }
        )
        .select(
            "refuge", "occasion", "year", "season", "month", "water_level", "water_temp", "visibility",
            "aquatic_plant_area", "aquatic_plant_index", "brush_park", "year_s", "month_s",
        )
        .distinct()
    )


def refuge_covariates(refuges: DataFrame) -> DataFrame:
    return refuges.select(
        "refuge",
        F.col("category").cast("string").alias("category"),
        "cfr_name",
        "category_name",
        F.col("area_dry_ha").alias("dry_area"),
        F.col("depth_dry_m").alias("dry_depth"),
        "large_water_body",
    )


def occasion_covariates_turnover(
    occasions: DataFrame, config: SurveyConfig = SurveyConfig(), *, keys: Sequence[str] = ("refuge", "year_s")
) -> DataFrame:
    """Start and end of the dry season side by side, with their differences."""
    dry = (
        _with_calendar(occasions, config)
        .where(F.col("season") == "dry")
        .select(*keys, *TURNOVER_OCCASION_MEASURES)
        .distinct()
    )
    start_month, end_month = (str(m) for m in config.dry_months)

    def side(month: str) -> DataFrame:
        suffixed = [F.col(c).alias(f"{c}_m{month}") for c in TURNOVER_OCCASION_MEASURES]
        return dry.where(F.col("month") == month).select(*keys, *suffixed)

    both = side(start_month).join(side(end_month), list(keys), "full")
    return both.withColumns(
        {
            f"{c}_diff": F.col(f"{c}_m{end_month}") - F.col(f"{c}_m{start_month}")
            for c in ("water_temp", "gauge_start")
        }
    )


def refuge_covariates_turnover(refuges: DataFrame) -> DataFrame:
    return numbers.log1p_columns(refuges, LOGGED_REFUGE_COLUMNS).select(*TURNOVER_REFUGE_COLUMNS)


def turnover_model_frame(
    turnover: DataFrame, occasion_side: DataFrame, refuge_side: DataFrame, *, comparison: str = "2 5"
) -> DataFrame:
    """Turnover of one comparison with scaled numeric covariates and yes/no flags.

    The response columns and `year_s` keep their scale.
    """
    joined = (
        turnover.where(F.col("comparison") == comparison)
        .join(refuge_side, "refuge", "left")
        .join(occasion_side, ["refuge", "year_s"], "left")
    )
    fixed = set(turnover.columns)
    numeric = [c for c, kind in joined.dtypes if kind in ("double", "int", "bigint") and c not in fixed]
    flags = [c for c, kind in joined.dtypes if kind == "boolean"]
    scaled = numbers.standardise_columns(joined, numeric).drop("_scaling")
    return scaled.withColumns({c: labels.yes_no(F.col(c)) for c in flags})
