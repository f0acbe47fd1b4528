"""Per-species change between two visit months, species reports and dominant species."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.config import SurveyConfig
from fieldtally.functions import numbers, text
from fieldtally.operators.ordered import add_rank, add_running
from fieldtally.operators.permutation import add_holm, sign_flip_test


def species_differences(catch_full: DataFrame, *, start: str = "2", end: str = "5") -> tuple[DataFrame, DataFrame]:
    """Non-zero log differences (end minus start) per site-year and species, and the paired site-years."""
    used = catch_full.where(F.col("month").isin(start, end))
    pairs = (
        used.groupBy("refuge", "year_s")
        .agg(F.max(F.col("month") == start).alias("_start"), F.max(F.col("month") == end).alias("_end"))
        .where("_start AND _end")
        .select("refuge", "year_s")
    )

    def log_count(month: str):
        return F.log1p(F.coalesce(F.sum(F.when(F.col("month") == month, F.col("count"))), F.lit(0.0)))

    differences = (
        used.groupBy("refuge", "year_s", "species")
        .agg((log_count(end) - log_count(start)).alias("diff"))
        .where(F.col("diff") != 0)
        .join(pairs, ["refuge", "year_s"], "left_semi")
    )
    return differences, pairs


def species_tests(
    catch_full: DataFrame, config: SurveyConfig = SurveyConfig(), *, start: str = "2", end: str = "5"
) -> DataFrame:
    """Paired test per species over all site-years; absence from both visits is a zero difference."""
    differences, pairs = species_differences(catch_full, start=start, end=end)
    return sign_flip_test(
        differences, by=["species"], units=["refuge", "year_s"], value="diff",
        n_units=pairs.agg(F.count(F.lit(1))).scalar(), n_perm=config.n_perm, seed=config.seed,
    )


def species_changes(catch_full: DataFrame, species: DataFrame, config: SurveyConfig = SurveyConfig()) -> DataFrame:
    """Species tests with species attributes and Holm-adjusted parametric p-values."""
    joined = species_tests(catch_full, config).join(species, "species", "left")
    return add_holm(joined, "p_value_param", "p_value_param_adjust")


def dry_season_occurrence(catch_full: DataFrame, *, top: int = 10) -> DataFrame:
    """Mean count, mean where present and share of samplings per species in the dry season.

    Long data has no zero rows, so the denominator is the number of dry samplings.
    """
    dry = catch_full.where(F.col("season") == "dry")
    samplings = dry.select("year_s", "season", "month", "refuge").distinct().agg(F.count(F.lit(1))).scalar()
    stats = (
        dry.groupBy("species")
        .agg(
            F.sum("count").alias("_sum"),
            F.avg(F.when(F.col("count") > 0, F.col("count"))).alias("mean_count_pres"),
            F.count(F.when(F.col("count") > 0, 1)).alias("_present"),
        )
        .select(
            "species",
            (F.col("_sum") / samplings).alias("mean_count"),
            "mean_count_pres",
            (F.col("_present") / samplings).alias("perc_samplings"),
        )
    )
    leaders = (
        stats.select("species", "mean_count").orderBy(F.desc("mean_count"), "species").limit(top)
        .select("species", F.lit(True).alias("top"))
    )
    return stats.join(leaders, "species", "left").withColumn("top", F.coalesce("top", F.lit(False)))


def species_report(
    catch_full: DataFrame, changes: DataFrame, config: SurveyConfig = SurveyConfig(), *, alpha: float = 0.05
) -> DataFrame:
    """Species with a notable change or a high abundance, formatted for print; `place` is their order by p-value."""
    joined = changes.join(dry_season_occurrence(catch_full), "species", "full")
    adjusted = add_holm(joined, "p_value_perm", "p_value_perm_adjust")
    notable = adjusted.where((F.col("p_value_perm") <= alpha) | F.col("top"))
    last = F.lit(2.0)  # beyond any p-value: species without a test come last
    keyed = notable.withColumns({"_p": F.coalesce("p_value_perm", last), "_q": F.coalesce("p_value_perm_adjust", last)})
    return add_rank(keyed, "place", order=["_p", "_q", "species"]).select(
        "species",
        "species_name",
        "species_type_simple",
        text.percent_text(numbers.percent_change(F.col("mean_diff"))).alias("perc_change"),
        text.p_value_text(F.col("p_value_perm")).alias("p_value_perm"),
        text.p_value_text(F.col("p_value_perm_adjust")).alias("p_value_perm_adjust"),
        text.number_text(F.col("mean_count"), 1).alias("mean_count"),
        text.percent_text(F.col("perc_samplings")).alias("perc_samplings"),
        "top",
        "place",
    )


def cumulative_share(catch_full: DataFrame) -> DataFrame:
    """Species of the dry season from most to least abundant with the share of the total before each."""
    totals = (
        catch_full.where(F.col("season") == "dry")
        .groupBy("species")
        .agg(F.sum("count").alias("total_count"))
        .withColumn("_rank_key", -F.col("total_count"))
    )
    running = add_running(
        totals, order=["_rank_key", "species"], sums={"_before": "total_count"}, totals={"_all": "total_count"}
    )
    return running.select(
        "species",
        "total_count",
        F.try_divide("total_count", "_all").alias("perc_count"),
        F.try_divide("_before", "_all").alias("share_before"),
    )


def top_species(catch_full: DataFrame, species: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """Most abundant species until their cumulative share reaches the threshold."""
    leading = cumulative_share(catch_full).where(F.col("share_before") < threshold)
    return leading.join(species.select("species", "species_name"), "species", "left")


def top_species_text(catch_full: DataFrame, species: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """The dominant species as one sentence fragment."""
    leading = top_species(catch_full, species, threshold=threshold)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("total_count")).alias("k"), "species", "species_name")))
    names = F.transform(ordered, lambda s: s["species_name"])
    return leading.agg(
        text.enumerate_text(names).alias("species_list"), F.count(F.lit(1)).alias("n_species")
    )
