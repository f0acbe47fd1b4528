"""Registered queries: each runs one operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.adapters import draws_from_events, read_table, survey_from_tables
from fieldtally.functions import calendar, labels, numbers, text
from fieldtally.operators import (
    change, cleaning, composition, dims, diversity, draws, effort, explore, leastsquares, models, ordination, quality, reshape, spread, stats, subsets, turnover, twopart,
)
from fieldtally.operators.lineage import cut
from fieldtally.operators.ordered import group_quantiles
from fieldtally.plans.survey import TABLES_CONFIG, compiled_plans, survey_of_tables

CFG = TABLES_CONFIG
N_BOOT = 200

NUMERIC_COVARIATES = [
    "diversity_alpha", "water_level", "water_temp", "visibility", "aquatic_plant_area", "aquatic_plant_index",
    "brush_park", "dry_area", "dry_depth",
]
SEASON_MEASURES = [
    "gauge_start", "gauge_finish", "rf_water_level", "water_temp", "secchi_depth", "phosphate", "nitrogen",
    "conductivity", "aquatic_plant_area", "aquatic_plant_density", "brush_park",
]
TBI_PREDICTORS = [
    "aquatic_plant_area_m2", "gauge_start_m5", "gauge_start_diff", "dist_village",
    "rf_area_connected_in_wet_season_ha", "lwb_area_wet_ha",
]
SEARCHED_PREDICTORS = [
    "type_inlet_outlet", "large_water_body", "channel_type", "shape", "lwb_depth_dry_m", "lwb_area_wet_ha", "no_channel",
    "rf_area_connected_in_dry_season_ha", "dist_market", "aquatic_plant_area_m2", "gauge_start_m2", "water_temp_m2", "phosphate_m2",
    "brush_park_m2", "illegal_fishing_m5", "other_animal_m2", "water_bird_m2", "water_temp_diff", "gauge_start_diff",
]
EVENT_PARAMS = {
    "click": "b_bstnd_depth",
    "view": "b_bstnd_channelEarth",
    "purchase": "b_cstnd_channelWater Gate",
    "signup": "b_bstnd_Intercept",
    "error": "b_cstnd_depth",
}
EVENT_EFFECTS = {
    "click": "r_site[north_pond_a,Intercept]",
    "view": "r_site[south_pond_b,Intercept]",
    "purchase": "r_year[2013,Intercept]",
    "signup": "r_year[2014,Intercept]",
    "error": "r_year[2015,Intercept]",
}
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, whole ones as they are; adding zero removes the sign of a negative zero."""

    def short(value):
        return F.when(F.rint(value) == value, value).otherwise(F.round(value, digits)) + F.lit(0.0)

    return df.select(
        *[
            short(F.col(f"`{c}`")).alias(c) if kind in ("double", "float")
            else F.col(f"`{c}`").cast("double").alias(c) if kind.startswith("decimal")
            else F.col(f"`{c}`")
            for c, kind in df.dtypes
        ]
    )


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str, digits: int = 6) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), digits)
        return fn

    return add


# --- cleaning, dimensions, keys -------------------------------------------------


@register("clean_survey")
def _(spark, d):
    compiled_plans(spark)
    return cleaning.clean_survey(survey_from_tables(spark, d), CFG)


@register("dim_refuge")
def _(spark, d):
    return survey_of_tables(spark, d).refuge_info


@register("dim_occasion")
def _(spark, d):
    return survey_of_tables(spark, d).occasion_info


@register("dim_sampling")
def _(spark, d):
    return survey_of_tables(spark, d).sampling_info


@register("dim_species")
def _(spark, d):
    return survey_of_tables(spark, d).species_info


@register("dim_casting")
def _(spark, d):
    return survey_of_tables(spark, d).casting_info


@register("fact_catch")
def _(spark, d):
    return survey_of_tables(spark, d).catch_rows


@register("cov_occasion")
def _(spark, d):
    return survey_of_tables(spark, d).occasion_covariates


@register("cov_refuge")
def _(spark, d):
    return survey_of_tables(spark, d).refuge_covariates


@register("cov_occasion_beta")
def _(spark, d):
    return dims.occasion_covariates_turnover(survey_of_tables(spark, d).occasion_info, CFG)


@register("cov_refuge_beta")
def _(spark, d):
    return dims.refuge_covariates_turnover(survey_of_tables(spark, d).refuge_info)


@register("tbi_model_frame")
def _(spark, d):
    return survey_of_tables(spark, d).turnover_model_frame


@register("quality_duplicates")
def _(spark, d):
    s = survey_of_tables(spark, d)
    return quality.key_report(
        [
            ("refuge_info", s.refuge_info, ["refuge"]),
            ("occasion_info", s.occasion_info, ["sampling"]),
            ("sampling_info", s.sampling_info, ["sampling"]),
            ("species_info", s.species_info, ["species"]),
            ("catch_info", s.catch_info, ["sampling", "species"]),
            ("part", read_table(spark, d, "part"), ["p_name"]),
        ]
    )


# --- effort and diversity -------------------------------------------------------


@register("effort_max_replicates")
def _(spark, d):
    return effort.max_replicates(survey_of_tables(spark, d).catch_sums, CFG)


@register("effort_standardised")
def _(spark, d):
    return effort.effort_totals(survey_of_tables(spark, d).catch_sums, CFG)


@register("effort_totals_tagged")
def _(spark, d):
    return effort.tagged_effort_totals(survey_of_tables(spark, d).catch_sums, CFG)


@register("effort_mean_scaled")
def _(spark, d):
    return effort.mean_scaled_totals(survey_of_tables(spark, d).catch_info, CFG)


@register("catch_full")
def _(spark, d):
    return survey_of_tables(spark, d).catch_full


@register("catch_wide")
def _(spark, d):
    full = survey_of_tables(spark, d).catch_full
    months = [str(m) for m in (2, 5, 8, 11)]
    wide = reshape.to_wide(full, keys=["year_s", "refuge", "species"], names="month", values="count", levels=months)
    return wide.withColumnsRenamed({m: f"m_{m}" for m in months})


@register("change_table")
def _(spark, d):
    return reshape.monthly_change_table(survey_of_tables(spark, d).catch_full)


@register("alpha_shannon")
def _(spark, d):
    return survey_of_tables(spark, d).diversity


@register("alpha_shannon_base2")
def _(spark, d):
    totals = effort.effort_totals(survey_of_tables(spark, d).catch_sums, CFG)
    return diversity.alpha_diversity(totals, values_from="total_weight", base=2.0)


@register("alpha_simpson")
def _(spark, d):
    totals = effort.effort_totals(survey_of_tables(spark, d).catch_sums, CFG)
    return diversity.alpha_diversity(totals, index="simpson")


@register("alpha_inverse_simpson")
def _(spark, d):
    totals = effort.effort_totals(survey_of_tables(spark, d).catch_sums, CFG)
    return diversity.alpha_diversity(totals, index="invsimpson")


@register("alpha_all_gears")
def _(spark, d):
    totals = effort.mean_scaled_totals(survey_of_tables(spark, d).catch_info, CFG)
    return diversity.alpha_diversity(totals, transform="log1p")


@register("alpha_frame")
def _(spark, d):
    return survey_of_tables(spark, d).diversity_frame


@register("alpha_by_month_wide")
def _(spark, d):
    return survey_of_tables(spark, d).diversity_by_month


# --- turnover and species change ------------------------------------------------


@register("tbi_abundance")
def _(spark, d):
    return survey_of_tables(spark, d).turnover.where(~F.col("pa_tr"))


@register("tbi_presence")
def _(spark, d):
    return survey_of_tables(spark, d).turnover.where(F.col("pa_tr"))


@register("tbi_unpaired")
def _(spark, d):
    return turnover.unpaired_visits(survey_of_tables(spark, d).catch_full, CFG)


@register("tbi_net_change")
def _(spark, d):
    return turnover.net_change_by_panel(survey_of_tables(spark, d).turnover)


@register("tbi_gain_loss_test")
def _(spark, d):
    return turnover.gain_loss_test(survey_of_tables(spark, d).turnover, CFG)


@register("tbi_perm_p")
def _(spark, d):
    return turnover.turnover_p_values(survey_of_tables(spark, d).catch_full, CFG)


@register("species_change")
def _(spark, d):
    return survey_of_tables(spark, d).species_changes


@register("species_table")
def _(spark, d):
    s = survey_of_tables(spark, d)
    return change.species_report(s.catch_full, s.species_changes, CFG)


@register("species_occurrence")
def _(spark, d):
    return change.dry_season_occurrence(survey_of_tables(spark, d).catch_full)


@register("species_cumulative_share")
def _(spark, d):
    return change.cumulative_share(survey_of_tables(spark, d).catch_full)


@register("top_species")
def _(spark, d):
    s = survey_of_tables(spark, d)
    return change.top_species_text(s.catch_full, s.species_info)


# --- exploration ----------------------------------------------------------------


@register("gear_bias")
def _(spark, d):
    return explore.gear_bias(survey_of_tables(spark, d).catch_info)


@register("coverage_matrix")
def _(spark, d):
    return explore.coverage_matrix(survey_of_tables(spark, d).catch_info)


@register("catch_composition")
def _(spark, d):
    s = survey_of_tables(spark, d)
    return explore.catch_composition(s.catch_info, s.species_info, CFG)


@register("composition_by_type")
def _(spark, d):
    s = survey_of_tables(spark, d)
    return explore.composition_by_type(explore.catch_composition(s.catch_info, s.species_info, CFG))


@register("type_composition")
def _(spark, d):
    s = survey_of_tables(spark, d)
    totals = effort.mean_scaled_totals(s.catch_info, CFG).where(F.col("gear") == CFG.primary_gear)
    return explore.type_totals(totals, s.species_info)


@register("profile_na")
def _(spark, d):
    return explore.na_profile(survey_of_tables(spark, d).diversity_frame)


@register("profile_cat")
def _(spark, d):
    frame = survey_of_tables(spark, d).diversity_frame
    return explore.categorical_profile(frame, ["season", "month", "year", "category_name", "large_water_body"])


@register("profile_compare")
def _(spark, d):
    frame = survey_of_tables(spark, d).diversity_frame
    columns = ["season", "month", "year", "category_name"]
    return explore.compare_profiles(
        explore.categorical_profile(frame.where(F.col("water_temp").isNull()), columns),
        explore.categorical_profile(frame.where(F.col("water_temp").isNotNull()), columns),
    )


@register("profile_num", 9)
def _(spark, d):
    return explore.numeric_profile(survey_of_tables(spark, d).diversity_frame, NUMERIC_COVARIATES)


@register("profile_num_log")
def _(spark, d):
    logged = ["aquatic_plant_index", "dry_area", "dry_depth", "visibility", "water_level"]
    frame = numbers.log1p_columns(survey_of_tables(spark, d).diversity_frame, logged)
    return explore.equal_width_histogram(frame, logged)


@register("histogram")
def _(spark, d):
    totals = effort.mean_scaled_totals(survey_of_tables(spark, d).catch_info, CFG)
    alpha = diversity.alpha_diversity(totals, transform="log1p")
    return explore.histogram(alpha, "diversity_alpha", width=0.1, by=["gear"])


@register("boxplot")
def _(spark, d):
    totals = effort.mean_scaled_totals(survey_of_tables(spark, d).catch_info, CFG)
    alpha = diversity.alpha_diversity(totals, transform="log1p")
    return explore.boxplot_stats(alpha, "diversity_alpha", by=["gear", "occasion"])


@register("boxplot_covariates", 9)
def _(spark, d):
    visits = survey_of_tables(spark, d).occasion_info.drop("sampling").distinct()
    long = reshape.to_long(
        visits.select("refuge", "occasion", *SEASON_MEASURES), keys=["refuge", "occasion"],
        columns=SEASON_MEASURES, names="variable", values="value",
    )
    boxes = explore.boxplot_stats(long, "value", by=["variable", "occasion"])
    return boxes.withColumn("variable", text.sentence_case(F.col("variable"))).withColumnRenamed("variable", "title")


@register("diversity_quantiles")
def _(spark, d):
    return group_quantiles(
        survey_of_tables(spark, d).diversity_frame, by=["season"], value="diversity_alpha",
        quantiles={"q0": 0.0, "q2": 0.02, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q98": 0.98, "q100": 1.0},
    )


@register("count_quantiles")
def _(spark, d):
    return group_quantiles(
        read_table(spark, d, "lineitem"), by=["l_returnflag"], value="l_extendedprice",
        quantiles={"q5": 0.05, "q50": 0.5, "q95": 0.95},
    )


@register("level_orders")
def _(spark, d):
    frame = survey_of_tables(spark, d).diversity_frame
    parts = [
        explore.level_order(frame, "occasion", "diversity_alpha", summary=how, descending=down).select(
            F.lit(how).alias("summary"), F.col("occasion").alias("level"), "level_rank"
        )
        for how, down in (("mean", False), ("median", True), ("max", True))
    ]
    first = explore.first_appearance_order(frame, "month", "occasion").select(
        F.lit("first").alias("summary"), F.col("month").alias("level"), "level_rank"
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(first)


@register("occasion_years")
def _(spark, d):
    return explore.occasion_years(survey_of_tables(spark, d).occasion_info)


@register("water_level_series")
def _(spark, d):
    s = survey_of_tables(spark, d)
    visits = s.occasion_info.drop("sampling").distinct()
    return visits.join(s.refuge_info.select("refuge", "category_name"), "refuge", "left").select(
        "refuge", "occasion", "category_name",
        calendar.occasion_number(F.col("occasion")).alias("occasion_numeric"),
        calendar.is_dry_occasion(F.col("occasion")).alias("dry_season"),
        F.log1p("rf_water_level").alias("log_water_level"),
    )


# --- column functions over the tables -------------------------------------------


@register("text_formats")
def _(spark, d):
    part = read_table(spark, d, "part")
    return part.select(
        "p_partkey",
        text.sentence_case(F.concat_ws("_", "p_name", "p_type")).alias("sentence"),
        text.snake_case(F.concat(F.col("p_brand"), F.lit(" & "), F.col("p_type"))).alias("snake"),
        text.truncate(F.col("p_name"), 5).alias("short"),
        text.number_text(F.col("p_retailprice"), 1).alias("number"),
        text.percent_text(F.col("p_size") / 64).alias("percent"),
        text.p_value_text(F.col("p_size") / 65536.0).alias("p_text"),
        text.interval_text(F.col("p_size") / 4, F.col("p_size") / 8, F.col("p_size") / 2).alias("interval"),
        labels.map_codes(F.col("p_size") % 4, labels.CHANNEL_TYPES).alias("channel"),
        text.composite_key(F.col("p_brand"), F.nullif(F.col("p_type"), F.lit("PROMO"))).alias("key"),
        text.strip_parenthesis(F.concat(F.col("p_name"), F.lit(" ("), F.col("p_type"), F.lit(")"))).alias("stripped"),
    )


@register("number_transforms")
def _(spark, d):
    customer = read_table(spark, d, "customer").withColumn("share", F.col("c_acctbal") / 10000)
    low, high = customer.agg(F.min("c_acctbal")).scalar(), customer.agg(F.max("c_acctbal")).scalar()
    return customer.select(
        "c_custkey",
        numbers.half_even(F.col("c_custkey") / 2).alias("half_even"),
        numbers.cap(F.col("c_acctbal"), 100).alias("capped"),
        numbers.logit(F.col("share")).alias("logit"),
        numbers.zero_to(F.floor(F.col("share")).cast("double"), 0.001).alias("nonzero"),
        numbers.percent_change(F.col("share")).alias("pct_change"),
        numbers.null_if(F.floor(F.col("c_acctbal") / 1000) * 1.0, 3.0).alias("sentinel"),
        numbers.equal_width_bin(F.col("c_acctbal"), low, high, 7).alias("bin"),
    )


@register("z_scores")
def _(spark, d):
    scaled = numbers.standardise_columns(read_table(spark, d, "customer"), ["c_acctbal"])
    return scaled.select("c_custkey", "c_acctbal")


@register("z_score_parameters")
def _(spark, d):
    customer = read_table(spark, d, "customer")
    scaled = numbers.standardise_columns(customer, ["c_acctbal"], params="p").select("c_mktsegment", "c_acctbal", "p.*")
    back = numbers.unstandardise(F.col("c_acctbal"), F.col("c_acctbal_center"), F.col("c_acctbal_scale"))
    return scaled.groupBy("c_mktsegment").agg(F.max("c_acctbal").alias("c_acctbal"), *[F.first(f"c_acctbal_{p}").alias(f"c_acctbal_{p}") for p in ("center", "scale")]).select(
        "c_mktsegment", "c_acctbal_center", "c_acctbal_scale", back.alias("largest")
    )


@register("value_grid")
def _(spark, d):
    return numbers.even_grid(read_table(spark, d, "supplier"), "s_acctbal", 50)


@register("calendar_labels")
def _(spark, d):
    frame = survey_of_tables(spark, d).occasion_covariates
    return frame.select(
        "refuge", "occasion",
        calendar.month_name(F.col("month_s")).alias("month_name"),
        calendar.flood_year_label(F.col("year_s"), {0: "2013", 1: "2014", 2: "2015"}).alias("year_label"),
    )


# --- statistics -----------------------------------------------------------------


@register("corr_pearson")
def _(spark, d):
    return stats.correlation(survey_of_tables(spark, d).diversity_frame, NUMERIC_COVARIATES)


@register("corr_spearman")
def _(spark, d):
    # Equal communities listed in another order differ in the last bits: not a difference in rank.
    frame = survey_of_tables(spark, d).diversity_frame.withColumn("diversity_alpha", F.round("diversity_alpha", 9))
    return stats.correlation(frame, NUMERIC_COVARIATES, method="spearman")


@register("ols_simple")
def _(spark, d):
    wide = survey_of_tables(spark, d).diversity_by_month
    parts = [
        stats.simple_regression(wide, y, "m_5").withColumn("response", F.lit(y)) for y in ("m_8", "m_11")
    ]
    return parts[0].unionByName(parts[1])


@register("ols_categorical")
def _(spark, d):
    coefficients, _ = stats.ols(survey_of_tables(spark, d).diversity_frame, "diversity_alpha", ["month"])
    return coefficients


@register("ols_covariates", 5)
def _(spark, d):
    frame = survey_of_tables(spark, d).diversity_frame
    coefficients, _ = stats.ols(frame, "diversity_alpha", ["month", "year"])
    return coefficients


def _fit(spark, d, *terms):
    frame = survey_of_tables(spark, d).diversity_frame.withColumns({c: F.col(c).cast("string") for c in ("month", "year")})
    return leastsquares.least_squares(frame, "diversity_alpha", terms)


@register("ols_fit")
def _(spark, d):
    """Fit summaries of diversity by month, by year, and by every combination of both."""
    named = {"month": ["month"], "year": ["year"], "month * year": ["month", "year", "month:year"]}
    parts = [_fit(spark, d, *terms).summary.withColumn("model", F.lit(name)) for name, terms in named.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("ols_cell_means")
def _(spark, d):
    """Fitted diversity of each month and year where both and their interaction are in the model."""
    fitted = _fit(spark, d, "month", "year", "month:year").fitted
    return fitted.groupBy("month", "year").agg(F.count(F.lit(1)).alias("n"), F.max("fitted").alias("fitted"))


@register("ols_terms", 5)
def _(spark, d):
    """Coefficients of diversity on month, site category, their interaction and two measures, aliased ones marked."""
    return _fit(spark, d, "month", "category_name", "month:category_name", "water_level", "water_temp").coefficients


@register("ols_moments", 4)
def _(spark, d):
    frame = survey_of_tables(spark, d).diversity_frame
    return stats.regression_moments(frame, "diversity_alpha", ["water_level", "aquatic_plant_area", "brush_park", "water_temp"])


@register("group_means")
def _(spark, d):
    table = survey_of_tables(spark, d).turnover.withColumn("net", F.col("c_stnd") - F.col("b_stnd"))
    return stats.group_means(table, "net", by=["comparison", "pa_tr"])


@register("pca_corr_matrix")
def _(spark, d):
    visits = survey_of_tables(spark, d).occasion_info.select("occasion", "refuge", *SEASON_MEASURES).distinct()
    return ordination.correlation_matrix(visits, SEASON_MEASURES)


def _season_pca(spark, d):
    s = survey_of_tables(spark, d)
    visits = s.occasion_info.drop("sampling").distinct().withColumns(
        {"season": calendar.season(F.col("date")), "month": calendar.month_text(F.col("date")), "year": calendar.year_text(F.col("date"))}
    )
    return ordination.pca(visits, SEASON_MEASURES, keep=["refuge", "occasion", "season", "month", "year"])


@register("pca_axes")
def _(spark, d):
    return _season_pca(spark, d).axes


@register("pca_variables")
def _(spark, d):
    return _season_pca(spark, d).variables


@register("pca_scores")
def _(spark, d):
    return _season_pca(spark, d).scores


@register("pca_categories")
def _(spark, d):
    result = _season_pca(spark, d)
    return ordination.supplementary_categories(result.scores, ["season", "month", "year"], n_axes=result.n_axes)


@register("pca_water_level")
def _(spark, d):
    s = survey_of_tables(spark, d)
    visits = s.occasion_info.select("refuge", "occasion", F.log1p("rf_water_level").alias("level")).distinct()
    occasions = reshape.level_list(visits, "occasion", limit=500)
    wide = reshape.to_wide(visits, keys=["refuge"], names="occasion", values="level", levels=occasions)
    sites = s.refuge_info.select("refuge", "depth_wet_m", "depth_dry_m", "drought_freq", "flooding_freq")
    result = ordination.pca(wide.join(sites, "refuge", "left"), occasions, keep=["depth_wet_m", "depth_dry_m", "drought_freq", "flooding_freq"])
    return ordination.supplementary_numeric(
        result.scores, ["depth_wet_m", "depth_dry_m", "drought_freq", "flooding_freq"], n_axes=result.n_axes
    )


@register("pca_dry_pairs")
def _(spark, d):
    pairs = dims.occasion_covariates_turnover(survey_of_tables(spark, d).occasion_info, CFG)
    return ordination.pca(pairs, reshape.columns_like(pairs.drop("year_s", "water_temp_diff", "gauge_start_diff"), numeric=True)).variables


@register("pca_sites")
def _(spark, d):
    sites = numbers.log1p_columns(survey_of_tables(spark, d).refuge_info, dims.LOGGED_REFUGE_COLUMNS)
    columns = [c for c in reshape.columns_like(sites, numeric=True) if c != "category"]
    categories = ["category_name", "large_water_body", "channel_type", "shape", "type_inlet_outlet"]
    result = ordination.pca(sites, columns, keep=categories)
    return ordination.supplementary_categories(result.scores, categories, n_axes=result.n_axes)


@register("pca_ellipses")
def _(spark, d):
    return stats.group_ellipses(_season_pca(spark, d).scores, "dim_1", "dim_2", by=["season"])


def _gear_cells(spark, d):
    totals = effort.mean_scaled_totals(survey_of_tables(spark, d).catch_info, CFG)
    return totals.where(F.col("gear") == CFG.primary_gear).select(
        "refuge", "occasion", "species", F.log1p("no_fish").alias("n")
    )


@register("ca_inertia")
def _(spark, d):
    return ordination.total_inertia(_gear_cells(spark, d), rows=["refuge", "occasion"], column="species", value="n")


@register("ca_row_coords")
def _(spark, d):
    return ordination.correspondence(_gear_cells(spark, d), rows=["refuge", "occasion"], column="species", value="n").scores


@register("ca_col_coords")
def _(spark, d):
    return ordination.correspondence(_gear_cells(spark, d), rows=["refuge", "occasion"], column="species", value="n").variables


@register("ca_all_gears")
def _(spark, d):
    totals = effort.mean_scaled_totals(survey_of_tables(spark, d).catch_info, CFG).withColumn("n", F.log1p("no_fish"))
    result = ordination.correspondence(totals, rows=["refuge", "occasion", "gear"], column="species", value="n")
    return ordination.supplementary_categories(result.scores, ["gear", "occasion"], n_axes=result.n_axes, weight="mass")


@register("ca_type_axes")
def _(spark, d):
    s = survey_of_tables(spark, d)
    totals = effort.mean_scaled_totals(s.catch_info, CFG).where(F.col("gear") == CFG.primary_gear)
    types = explore.type_totals(totals, s.species_info)
    result = ordination.correspondence(types, rows=["refuge", "occasion"], column="type_group", value="n")
    scores = result.scores.join(s.refuge_covariates.select("refuge", "category"), "refuge", "left")
    return ordination.supplementary_categories(scores, ["category"], n_axes=result.n_axes, weight="mass")


@register("group_ellipse")
def _(spark, d):
    frame = survey_of_tables(spark, d).diversity_frame
    return stats.group_ellipses(frame, "diversity_alpha", "water_level", by=["season", "category_name"])


# --- composition ----------------------------------------------------------------


VISIT = ["refuge", "occasion"]


def _visit_covariates(spark, d):
    s = survey_of_tables(spark, d)
    return s.occasion_covariates.join(s.refuge_covariates, "refuge", "left")


def _numeric(*names):
    return {name: F.col(name).cast("double") for name in names}


def _both_groupings(spark, d, run):
    """One line for the grouping by season, one for the grouping by site category."""
    cells, covariates = _gear_cells(spark, d), _visit_covariates(spark, d)
    parts = [
        run(cells, covariates, rows=VISIT, column="species", value="n", group=group).withColumn("grouping", F.lit(group))
        for group in ("season", "category_name")
    ]
    return parts[0].unionByName(parts[1])


@register("composition_groups")
def _(spark, d):
    return _both_groupings(spark, d, composition.composition_groups)


@register("composition_test")
def _(spark, d):
    return _both_groupings(spark, d, composition.composition_test)


def _constrained(spark, d, *, full):
    covariates = _visit_covariates(spark, d)
    design = _numeric("water_level", "dry_area")
    if full:
        categories = reshape.level_list(covariates, "category_name", limit=50)
        dummies = models.design_columns({"category_name": categories}, [])
        design = {**_numeric("water_level", "water_temp", "visibility", "dry_area", "dry_depth"), **{k: v for k, v in dummies.items() if k != "(Intercept)"}}
    return composition.constrained_ordination(_gear_cells(spark, d), covariates, rows=VISIT, column="species", value="n", design=design)


@register("cca_inertia")
def _(spark, d):
    return _constrained(spark, d, full=False).inertia


@register("cca_axes")
def _(spark, d):
    return _constrained(spark, d, full=False).axes


@register("cca_species")
def _(spark, d):
    return _constrained(spark, d, full=True).variables


@register("cca_sites")
def _(spark, d):
    return _constrained(spark, d, full=True).scores


@register("cca_predictors")
def _(spark, d):
    return _constrained(spark, d, full=True).predictors


@register("variation_pair")
def _(spark, d):
    groups = {"visit": _numeric("water_level"), "site": _numeric("dry_area")}
    return composition.variation_partition(_gear_cells(spark, d), _visit_covariates(spark, d), rows=VISIT, column="species", value="n", groups=groups)


@register("variation_partition")
def _(spark, d):
    groups = {
        "site": _numeric("dry_area", "dry_depth"),
        "visit": _numeric("water_level", "water_temp", "visibility", "aquatic_plant_area", "brush_park"),
        "time": {**_numeric("year_s"), "wet": F.when(F.col("season") == "wet", 1.0).otherwise(0.0)},
    }
    return composition.variation_partition(_gear_cells(spark, d), _visit_covariates(spark, d), rows=VISIT, column="species", value="n", groups=groups)


def _site_cells(spark, d):
    return _gear_cells(spark, d).groupBy("refuge", "species").agg(F.round(F.sum("n"), 9).alias("n"))


@register("concordance")
def _(spark, d):
    return composition.concordance(_site_cells(spark, d), objects=["refuge"], judge="species", value="n")


@register("concordance_test")
def _(spark, d):
    return composition.concordance_test(_site_cells(spark, d), objects=["refuge"], judge="species", value="n")


@register("evenness")
def _(spark, d):
    return diversity.evenness(effort.effort_totals(survey_of_tables(spark, d).catch_sums, CFG))


@register("relative_importance")
def _(spark, d):
    s = survey_of_tables(spark, d)
    totals = effort.mean_scaled_totals(s.catch_info, CFG).where(F.col("gear") == CFG.primary_gear)
    seasons = s.occasion_covariates.select("refuge", "occasion", "season").distinct()
    return diversity.relative_importance(totals.join(seasons, VISIT), by=["season"], visit=VISIT)


# --- draws ----------------------------------------------------------------------


def _draws(spark, d):
    return cut(draws_from_events(spark, d))


def _named_draws(spark, d, names):
    table = _draws(spark, d)
    return table.select("draw", labels.map_codes(F.col("param"), names).alias("param"), (F.col("value") - 40).alias("value"))


@register("draw_table")
def _(spark, d):
    return draws.gather_draws(draws_from_events(spark, d), "^(click|view)$")


@register("draw_wide_long")
def _(spark, d):
    wide = draws.draws_to_wide(_draws(spark, d), EVENT_TYPES)
    return draws.draws_to_long(wide, pattern="^[cp]")


@register("draw_qi")
def _(spark, d):
    return draws.point_intervals(_draws(spark, d), widths=(0.66, 0.9, 0.95))


@register("draw_qi_median")
def _(spark, d):
    return draws.point_intervals(_draws(spark, d), widths=(0.66, 0.95), point="median")


@register("draw_hypothesis")
def _(spark, d):
    tests = [
        ("click > view", F.col("click") - F.col("view"), ">"),
        ("signup < error", F.col("signup") - F.col("error"), "<"),
        ("click + view - 2 * error > 0", F.col("click") + F.col("view") - 2 * F.col("error"), ">"),
        ("purchase = 0", F.col("purchase"), "="),
    ]
    return draws.hypotheses(_draws(spark, d), tests, params=EVENT_TYPES)


@register("draw_pd")
def _(spark, d):
    return draws.probability_of_direction(_named_draws(spark, d, EVENT_PARAMS))


@register("draw_ratio")
def _(spark, d):
    ratios = {"click_vs_view": ("click", "view"), "error_vs_signup": ("error", "signup")}
    return draws.ratio_draws(_draws(spark, d), ratios)


@register("draw_loss_share")
def _(spark, d):
    return draws.loss_share_draws(_draws(spark, d), losses="click", gains="view")


@register("draw_r2")
def _(spark, d):
    items = read_table(spark, d, "lineitem").select(
        F.col("l_linenumber").cast("long").alias("draw"),
        (F.col("l_quantity") * 1500).alias("fitted"), F.col("l_extendedprice").alias("observed"),
    )
    return draws.r2_draws(items)


@register("draw_predict", 11)
def _(spark, d):
    grid = numbers.even_grid(read_table(spark, d, "supplier"), "s_acctbal", 5).select(
        "point", (F.col("s_acctbal") / 10000).alias("x")
    )
    return draws.predict_draws(_draws(spark, d), grid, {"click": "x"}, intercept="view")


@register("draw_group_effect")
def _(spark, d):
    table = _draws(spark, d)
    grid = read_table(spark, d, "region").select(F.col("r_name").alias("category"), (F.col("r_regionkey") * 1.0).alias("x"))
    fitted = draws.predict_draws(table, grid, {"click": "x"}, intercept="view")
    effects = table.where(F.col("param").isin("error", "signup")).select(
        "draw", F.col("param").alias("level"), F.col("value").alias("effect")
    )
    shifted = draws.add_group_effect(fitted, effects)
    return draws.point_intervals(shifted, by=["category", "level"], widths=(0.66, 0.95))


@register("draw_broadcast_total")
def _(spark, d):
    table = _draws(spark, d)
    return draws.broadcast_category(table, by=["draw"], category="param", level="error", value="value", name="total_value")


@register("draw_sample")
def _(spark, d):
    return draws.sample_draws(_draws(spark, d), 0.1)


@register("draw_first")
def _(spark, d):
    return draws.first_draws(_draws(spark, d), 999)


@register("effect_sizes")
def _(spark, d):
    frame = survey_of_tables(spark, d).turnover_model_frame.select(
        F.col("channel_type").alias("channel"), F.col("shape").alias("depth")
    )
    bases = draws.base_levels(frame, ["channel"])
    return draws.effect_sizes(_named_draws(spark, d, EVENT_PARAMS), bases)


@register("group_effect_table")
def _(spark, d):
    return draws.group_effect_table(_named_draws(spark, d, EVENT_EFFECTS), share=0.5)


@register("widest_interval")
def _(spark, d):
    intervals = draws.point_intervals(_draws(spark, d), widths=(0.66, 0.9))
    return draws.widest_interval(intervals, by=["param"])


# --- models ---------------------------------------------------------------------


@register("glm_offset", 5)
def _(spark, d):
    coefficients, _ = models.offset_model(
        survey_of_tables(spark, d).diversity_frame, "diversity_alpha", ["month_s"], offset=F.ln("n_samples")
    )
    return coefficients


@register("glm_dry_wet", 5)
def _(spark, d):
    coefficients, _ = models.offset_model(
        survey_of_tables(spark, d).diversity_by_month, "m_8", ["m_5"], offset=F.ln("n_samples")
    )
    return coefficients


@register("model_variants", 5)
def _(spark, d):
    s = survey_of_tables(spark, d)

    def frame(standard, transform):
        totals = effort.effort_totals(s.catch_sums, CFG, standard=standard)
        alpha = diversity.alpha_diversity(totals, transform=transform)
        return cut(diversity.diversity_frame(alpha, s.occasion_covariates, s.refuge_covariates))

    raw_log = frame(False, "log1p")
    flood = raw_log.withColumn("year_f", F.col("year_s").cast("string"))
    log_effort = F.ln("n_samples")
    return models.compare_models(
        [
            ("raw counts", frame(True, "I"), "diversity_alpha", ["month_s"], None),
            ("log counts", frame(True, "log1p"), "diversity_alpha", ["month_s"], None),
            ("offset", raw_log, "diversity_alpha", ["month_s"], F.col("n_samples")),
            ("log offset", raw_log, "diversity_alpha", ["month_s"], log_effort),
            ("log offset, flood year", flood, "diversity_alpha", ["month_s", "year_f"], log_effort),
            ("log offset, calendar year", raw_log, "diversity_alpha", ["month_s", "year"], log_effort),
        ]
    )


def _bootstrap_inputs(spark, d):
    frame = survey_of_tables(spark, d).turnover_model_frame.where(F.col("pa_tr") == "no")
    return frame, models.design_columns({}, ["gauge_start_m5", "dist_village", "lwb_area_wet_ha"])


@register("bootstrap_moments")
def _(spark, d):
    frame, design = _bootstrap_inputs(spark, d)
    moments = models.cluster_moments(frame, "b_stnd", design, cluster="refuge")
    summed = models.bootstrap_moments(moments, design, n_draws=N_BOOT)
    return summed.select("draw", F.posexplode("xy").alias("term", "xy"), "yy", "n")


@register("bootstrap_draws")
def _(spark, d):
    frame, design = _bootstrap_inputs(spark, d)
    return models.bootstrap_draws(frame, "b_stnd", design, cluster="refuge", n_draws=N_BOOT, prefix="b_bstnd_")


def _turnover_draws(spark, d, response, prefix):
    """Coefficient draws of a turnover part on presence-absence, site category and their interaction."""
    s = survey_of_tables(spark, d)
    table = s.turnover.where(F.col("comparison") == "2 5").join(
        s.refuge_covariates.select("refuge", "category_name"), "refuge", "left"
    )
    category = models.design_columns({"category_name": reshape.level_list(table, "category_name", limit=50)}, [])
    presence = F.when(F.col("pa_tr"), 1.0).otherwise(0.0)
    crossed = {f"pa_tr:{name}": presence * column for name, column in category.items() if name != "(Intercept)"}
    design = {**category, "pa_tr": presence, **crossed}
    held = table.withColumn(response, numbers.zero_to(F.col(response), 0.0001))
    return models.bootstrap_draws(held, response, design, cluster="refuge", n_draws=N_BOOT, prefix=prefix)


@register("bootstrap_turnover")
def _(spark, d):
    losses = cut(_turnover_draws(spark, d, "b_stnd", "b_bstnd_"))
    gains = cut(_turnover_draws(spark, d, "c_stnd", "b_cstnd_"))
    tests = [("losses > gains", F.col("b_bstnd_Intercept") - F.col("b_cstnd_Intercept"), ">")]
    return draws.hypotheses(losses.unionByName(gains), tests, params=["b_bstnd_Intercept", "b_cstnd_Intercept"])


@register("bootstrap_species_types")
def _(spark, d):
    changes = cut(survey_of_tables(spark, d).species_changes)
    types = reshape.level_list(changes, "species_type_simple", limit=50)
    scaled = numbers.standardise_columns(changes, ["mean_diff"]).drop("_scaling")
    design = models.design_columns({"species_type_simple": types}, [])
    table = models.bootstrap_draws(scaled, "mean_diff", design, cluster="species", n_draws=N_BOOT)
    return draws.point_intervals(table, widths=(0.66, 0.95))


@register("variance_components")
def _(spark, d):
    frame = survey_of_tables(spark, d).diversity_frame
    parts = [models.variance_components(frame, "diversity_alpha", g) for g in ("refuge", "category_name", "year_s")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("spread_draws")
def _(spark, d):
    return models.spread_draws(survey_of_tables(spark, d).diversity_frame, "diversity_alpha", "refuge", n_draws=N_BOOT)


SPREAD_FACTORS = ["refuge", "category_name", "year_s"]


@register("crossed_spread")
def _(spark, d):
    """Spread of diversity between sites, categories and flood years, estimated together."""
    return spread.crossed_components(survey_of_tables(spark, d).diversity_frame, "diversity_alpha", SPREAD_FACTORS)


@register("crossed_spread_draws")
def _(spark, d):
    frame = survey_of_tables(spark, d).diversity_frame
    return spread.crossed_spread_draws(frame, "diversity_alpha", SPREAD_FACTORS, cluster="refuge", n_draws=N_BOOT)


def _subset_frame(spark, d):
    table = survey_of_tables(spark, d).turnover_model_frame.where(F.col("pa_tr") == "no")
    response = numbers.logit(numbers.zero_to(F.col("d"), 0.001))
    return table.withColumn("logit_d", response)


@register("model_weights")
def _(spark, d):
    return models.subset_models(_subset_frame(spark, d), "logit_d", TBI_PREDICTORS, most_terms=2)


@register("variable_importance")
def _(spark, d):
    return models.variable_importance(models.subset_models(_subset_frame(spark, d), "logit_d", TBI_PREDICTORS))


TWO_PART_TERMS = ["aquatic_plant_area_m2", "gauge_start_m5", "gauge_start_diff", "dist_village", "rf_area_connected_in_wet_season_ha", "lwb_area_wet_ha"]


@register("two_part_shares")
def _(spark, d):
    """Expected losses and gains, and the share of zeros among them, of each type: mean over site-years and draws."""
    frame = survey_of_tables(spark, d).turnover_model_frame
    contrasts = models.design_columns({"type_inlet_outlet": reshape.level_list(frame, "type_inlet_outlet", limit=50)}, [])
    design = {**contrasts, **_numeric(*TWO_PART_TERMS)}
    parts = []
    for response in ("b_stnd", "c_stnd"):
        for kind in ("yes", "no"):
            rows = frame.where(F.col("pa_tr") == kind)
            drawn = cut(twopart.two_part_draws(rows, response, design, cluster="refuge", n_draws=N_BOOT))
            found = twopart.expected_shares(drawn, rows.where(F.col(response).isNotNull()), design, keep=["refuge", "year_s"])
            per_draw = found.groupBy("draw").agg(*[F.avg(c).alias(c) for c in ("zero_share", "share", "expected")])
            observed = rows.agg(F.avg((F.col(response) == 0).cast("double"))).scalar()
            summed = per_draw.agg(*[F.avg(c).alias(c) for c in ("zero_share", "share", "expected")], F.stddev_samp("expected").alias("expected_se"))
            parts.append(cut(summed.withColumns({"response": F.lit(response), "pa_tr": F.lit(kind), "observed_zero_share": observed})))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _search(spark, d):
    """Losses, gains and dissimilarity on 19 site and visit predictors, with an intercept for each flood year."""
    table = survey_of_tables(spark, d).turnover_model_frame.where(F.col("pa_tr") == "no")
    responses = {name: numbers.logit(numbers.zero_to(F.col(name), 0.001)) for name in ("b_stnd", "c_stnd", "d")}
    return subsets.subset_search(table, responses, SEARCHED_PREDICTORS, within="year_s")


@register("subset_search")
def _(spark, d):
    return _search(spark, d)


@register("subset_importance")
def _(spark, d):
    found = _search(spark, d)
    return models.formula_terms(found).groupBy("response", "variable").agg(F.sum("weight").alias("weight"))
