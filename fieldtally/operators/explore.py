"""Exploratory tables: coverage, composition, profiles, histograms and boxplots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.config import SurveyConfig
from fieldtally.functions import numbers, text
from fieldtally.operators import dims, reshape
from fieldtally.operators.ordered import add_rank, group_quantiles, with_position

# Ways to summarise a value per level when ordering the levels.
ORDER_SUMMARIES = {
    "sum": F.sum,
    "mean": F.avg,
    "max": F.max,
    "min": F.min,
    "n_zeros": lambda c: F.count(F.when(F.col(c) == 0, 1)),
}


def level_order(
    df: DataFrame, column: str, value: str, *, summary: str = "sum", descending: bool = False, name: str = "level_rank"
) -> DataFrame:
    """Rank of each level by a summary of `value`; equal levels in name order."""
    if summary == "median":
        summarised = group_quantiles(df, by=[column], value=value, quantiles={"_key": 0.5})
    else:
        summarised = df.groupBy(column).agg(ORDER_SUMMARIES[summary](value).alias("_key"))
    signed = summarised.withColumn("_key", -F.col("_key") if descending else F.col("_key"))
    return add_rank(signed, name, order=["_key", column]).select(column, name)


def first_appearance_order(df: DataFrame, column: str, order: str, *, name: str = "level_rank") -> DataFrame:
    """Rank of each level by where it first appears."""
    firsts = df.groupBy(column).agg(F.min(order).alias("_first"))
    return add_rank(firsts, name, order=["_first", column]).select(column, name)


def gear_bias(catch: DataFrame, *, bins: int = 7) -> DataFrame:
    """Records per species and gear with zeros filled, species ranked by records and cut into bins."""
    counts = reshape.complete_counts(catch.select("species", "gear"), ["species", "gear"])
    ranks = level_order(catch.select("species", F.lit(1).alias("n")), "species", "n", descending=True, name="species_rank")
    most = ranks.agg(F.max("species_rank")).scalar()
    binned = numbers.equal_width_bin(F.col("species_rank"), F.lit(1), most, bins)
    return counts.join(ranks, "species").select(
        "species", "gear", "n", F.ln(F.when(F.col("n") > 0, F.col("n"))).alias("log_n"), "species_rank",
        binned.alias("species_bin"),
    )


def coverage_matrix(catch: DataFrame) -> DataFrame:
    """Species records per site, visit, replicate and gear; sites with the fewest gaps first."""
    dimensions = ["refuge", "occasion", "replicate", "gear"]
    counts = reshape.complete_counts(catch.select(*dimensions), dimensions)
    ranks = level_order(counts, "refuge", "n", summary="n_zeros", name="refuge_rank")
    return counts.join(ranks, "refuge").select(*dimensions, "n", "refuge_rank")


def catch_composition(catch: DataFrame, species: DataFrame, config: SurveyConfig = SurveyConfig()) -> DataFrame:
    """Sums of every numeric catch column per visit and species, with the species type."""
    gear = catch.where(F.col("gear") == config.primary_gear)
    numeric = reshape.columns_like(gear, numeric=True)
    sums = gear.groupBy("occasion", "gear", "species").agg(
        *[F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias(c) for c in numeric]
    )
    return sums.join(species.select("species", "species_name", "species_type_simple"), "species")


def composition_by_type(composition: DataFrame) -> DataFrame:
    """Species, individuals and weight per visit and species type; biggest type first."""
    summed = composition.groupBy("occasion", "species_type_simple").agg(
        F.count(F.lit(1)).alias("n_species"),
        F.sum("no_fish").alias("no_fish"),
        F.sum("total_weight").alias("total_weight"),
    )
    ranks = level_order(summed, "species_type_simple", "no_fish", descending=True, name="type_rank")
    return summed.join(ranks, "species_type_simple")


def type_totals(totals: DataFrame, species: DataFrame, *, n_types: int = 3, transform: str = "log1p") -> DataFrame:
    """Transformed catch per site visit summed within species type, rare types lumped."""
    typed = species.select("species", text.snake_case(F.col("type")).alias("type")).distinct()
    lumped = dims.lump_top(typed, "type", n_types, name="type_group", other="other")
    value = numbers.TRANSFORMS[transform](F.col("no_fish"))
    return (
        totals.join(lumped.select("species", "type_group"), "species", "left")
        .groupBy("refuge", "occasion", "type_group")
        .agg(F.sum(value).alias("n"))
    )


def na_profile(df: DataFrame) -> DataFrame:
    """Missing values per column: `variable, n_missing, pct_missing`."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns],
    )
    long = counted.unpivot(["_rows"], df.columns, "variable", "n_missing")
    return long.select(
        "variable", "n_missing", (F.try_divide(F.col("n_missing") * 100.0, F.col("_rows"))).alias("pct_missing")
    )


def categorical_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of each level of each column, missing included."""
    long = df.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "variable", "level")
    counts = long.groupBy("variable", "level").agg(F.count(F.lit(1)).alias("n"))
    rows = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("share", F.col("n") / rows)


def compare_profiles(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two categorical profiles side by side; a level absent on one side has share 0."""
    a = left.select("variable", F.coalesce("level", F.lit("NA")).alias("level"), F.col("share").alias("share_1"))
    b = right.select("variable", F.coalesce("level", F.lit("NA")).alias("level"), F.col("share").alias("share_2"))
    return a.join(b, ["variable", "level"], "full").fillna(0.0, subset=["share_1", "share_2"])


def _values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    doubles = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot(list(by), list(columns), "variable", "value")


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Range, mean, spread, quartiles and missing share of each numeric column."""
    long = _values(df, columns)
    moments = long.groupBy("variable").agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.count(F.when(F.col("value").isNull(), 1)).alias("n_missing"),
        F.count(F.lit(1)).alias("n"),
    )
    quartiles = group_quantiles(
        long, by=["variable"], value="value", quantiles={"q1": 0.25, "median": 0.5, "q3": 0.75}
    )
    return moments.join(quartiles, "variable", "left")


def histogram(df: DataFrame, column: str, *, width: float, center: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """Counts in bins of a fixed width, one of them centred at `center`."""
    bin_number = F.floor((F.col(column) - center) / width + 0.5)
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(*by, bin_number.cast("long").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bin_center", F.col("bin") * width + center)
    )


def equal_width_histogram(df: DataFrame, columns: Sequence[str], *, bins: int = 10) -> DataFrame:
    """Counts in `bins` equal-width bins between each column's minimum and maximum."""
    long = _values(df, columns).where(F.col("value").isNotNull())
    ends = long.groupBy("variable").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    binned = numbers.equal_width_bin(F.col("value"), F.col("low"), F.col("high"), bins)
    return (
        long.join(ends, "variable")
        .groupBy("variable", binned.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def boxplot_stats(df: DataFrame, column: str, *, by: Sequence[str]) -> DataFrame:
    """Quartiles, whisker ends (1.5 interquartile ranges) and outlier count per group."""
    counts = (
        df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    )
    quartiles = group_quantiles(
        df, by=by, value=column, quantiles={"q1": 0.25, "median": 0.5, "q3": 0.75}
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(column) >= F.col("q1") - reach) & (F.col(column) <= F.col("q3") + reach)
    return (
        counts.join(quartiles, list(by))
        .groupBy(*by, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(column))).alias("whisker_low"),
            F.max(F.when(inside, F.col(column))).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("_n"))), F.lit(0)).cast("long").alias("n_outliers"),
            F.sum("_n").alias("n"),
        )
    )


def occasion_years(occasions: DataFrame) -> DataFrame:
    """Year index from the position of each visit in the visit order, four to a year."""
    visits = occasions.select("occasion").distinct()
    placed = with_position(visits, "_position", order=["occasion"])
    return placed.select("occasion", F.floor(F.col("_position") / 4).cast("int").alias("year"))
