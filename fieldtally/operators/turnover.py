"""Temporal beta diversity: dissimilarity between two visits, split into losses and gains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.config import SurveyConfig
from fieldtally.operators.lineage import cut
from fieldtally.operators.ordered import with_position
from fieldtally.operators.permutation import TOLERANCE, hash_uint32, sign_flip_test

SITE_YEAR = ("year_s", "refuge")
SITES_PER_BIN = 100


def _by_month(catch_full: DataFrame, months: Sequence[str]) -> DataFrame:
    """Counts of each visit month side by side: one row per site, flood year and species."""
    in_month = [F.col("month") == m for m in months]
    return catch_full.groupBy(*SITE_YEAR, "species").agg(
        *[F.sum(F.when(c, F.col("count"))).alias(f"y_{m}") for c, m in zip(in_month, months)],
        *[F.max(c).alias(f"seen_{m}") for c, m in zip(in_month, months)],
    )


def _parts(first: Column, second: Column) -> tuple[Column, Column, Column]:
    """Shared amount, loss and gain between two amounts."""
    lost = F.greatest(first - second, F.lit(0.0))
    gained = F.greatest(second - first, F.lit(0.0))
    return F.least(first, second), lost, gained


def _amounts(month: str, presence: bool) -> Column:
    count = F.coalesce(F.col(f"y_{month}"), F.lit(0.0))
    return F.when(count > 0, 1.0).otherwise(0.0) if presence else F.log1p(count)


def turnover(catch_full: DataFrame, config: SurveyConfig = SurveyConfig()) -> DataFrame:
    """Losses, gains and dissimilarity per site-year for every comparison, for
    presence-absence (`pa_tr`) and for log abundance.

    All comparisons come from one conditional aggregation. A site-year enters a
    comparison when both months were visited. Two empty visits give NULL.
    """
    months = sorted({m for pair in config.comparisons for m in pair}, key=int)
    wide = _by_month(catch_full, months)
    sums, rows = [F.max(f"seen_{m}").alias(f"seen_{m}") for m in months], []
    for first, second in config.comparisons:
        for presence in (True, False):
            tag = f"{first}_{second}_{'p' if presence else 'a'}"
            shared, lost, gained = _parts(_amounts(first, presence), _amounts(second, presence))
            sums += [F.sum(shared).alias(f"A_{tag}"), F.sum(lost).alias(f"B_{tag}"), F.sum(gained).alias(f"C_{tag}")]
            rows.append(
                F.struct(
                    F.lit(f"{first} {second}").alias("comparison"),
                    F.lit(presence).alias("pa_tr"),
                    (F.col(f"seen_{first}") & F.col(f"seen_{second}")).alias("_paired"),
                    F.col(f"A_{tag}").alias("_a"),
                    F.col(f"B_{tag}").alias("b"),
                    F.col(f"C_{tag}").alias("c"),
                )
            )
    stacked = wide.groupBy(*SITE_YEAR).agg(*sums).select(*SITE_YEAR, F.inline(F.array(*rows)))
    whole = 2 * F.col("_a") + F.col("b") + F.col("c")
    return stacked.where("_paired").select(
        "comparison", "pa_tr", *SITE_YEAR,
        F.try_divide("b", whole).alias("b_stnd"),
        F.try_divide("c", whole).alias("c_stnd"),
        F.try_divide(F.col("b") + F.col("c"), whole).alias("d"),
        "b", "c",
    )


def unpaired_visits(catch_full: DataFrame, config: SurveyConfig = SurveyConfig()) -> DataFrame:
    """Site-years that a comparison leaves out because one month was not visited."""
    months = sorted({m for pair in config.comparisons for m in pair}, key=int)
    seen = catch_full.groupBy(*SITE_YEAR).agg(*[F.max(F.col("month") == m).alias(f"seen_{m}") for m in months])
    rows = [
        F.struct(
            F.lit(f"{a} {b}").alias("comparison"),
            F.when(F.col(f"seen_{a}"), F.lit(b)).when(F.col(f"seen_{b}"), F.lit(a)).alias("missing_month"),
            (F.col(f"seen_{a}") == F.col(f"seen_{b}")).alias("_same"),
        )
        for a, b in config.comparisons
    ]
    return seen.select(*SITE_YEAR, F.inline(F.array(*rows))).where(~F.col("_same")).drop("_same")


def gain_loss_test(turnover_table: DataFrame, config: SurveyConfig = SurveyConfig()) -> DataFrame:
    """Paired test of gains against losses over the site-years of each comparison."""
    differences = turnover_table.where(F.col("d").isNotNull()).withColumn(
        "_change", F.col("c_stnd") - F.col("b_stnd")
    )
    return sign_flip_test(
        differences, by=["comparison", "pa_tr"], units=["refuge", "year_s"], value="_change",
        n_perm=config.n_perm, seed=config.seed,
    )


def turnover_p_values(
    catch_full: DataFrame, config: SurveyConfig = SurveyConfig(), *, n_perm: int | None = None
) -> DataFrame:
    """Permutation p-value of every site-year's dissimilarity, from `n_perm` permutations or a few more.

    Site-years are reordered independently for each species, with the same order
    in both months. A site's test looks only at where that site's species come
    from, so any family of reorderings that gives each site a uniform, per
    species independent source has the same null distribution. Rotating the
    site-years by a random offset per (rotation, species) is one, and needs
    neither a sort nor a shuffle: every non-empty entry is sent straight to its
    new site-year.

    One rotation serves many permutations. Site-years fall into bins of
    `SITES_PER_BIN` to twice as many (all in one, if fewer), and a rotation is followed by every
    cyclic shift within the bins, alike for all species, which leaves sources
    uniform and independent between species. A site thus meets the values of
    its whole bin, drawn from entries that no two of them share, and its hits
    are a running count over the bin's sorted values.
    """
    n_perm = config.n_perm if n_perm is None else n_perm
    months = sorted({m for pair in config.comparisons for m in pair}, key=int)
    wide = _by_month(catch_full, months)
    rows = []
    for first, second in config.comparisons:
        fields = [
            F.lit(f"{first} {second}").alias("comparison"),
            F.col(f"seen_{first}").alias("_first"),
            F.col(f"seen_{second}").alias("_second"),
        ]
        for kind, presence in (("p", True), ("a", False)):
            for name, part in zip("ABC", _parts(_amounts(first, presence), _amounts(second, presence))):
                fields.append(part.alias(f"{name}_{kind}"))
        rows.append(F.struct(*fields))
    entries = wide.select(*SITE_YEAR, "species", F.inline(F.array(*rows)))
    measures = [f"{name}_{kind}" for kind in "pa" for name in "ABC"]

    sites = (
        entries.groupBy("comparison", *SITE_YEAR)
        .agg(F.max("_first").alias("_f"), F.max("_second").alias("_s"), *[F.sum(m).alias(m) for m in measures])
        .where("_f AND _s")
        .drop("_f", "_s")
    )
    placed = cut(with_position(sites, "_site", by=["comparison"], order=list(SITE_YEAR)))
    counts = placed.groupBy("comparison").agg(F.count(F.lit(1)).alias("_size"))
    counts = counts.withColumn("_bins", F.greatest(F.lit(1), F.floor(F.col("_size") / SITES_PER_BIN)))
    sizes = cut(counts.withColumn("_rotations", F.ceil(F.lit(n_perm) / F.floor(F.col("_size") / F.col("_bins")))))

    def dissimilarity(kind: str) -> Column:
        change = F.col(f"B_{kind}") + F.col(f"C_{kind}")
        return F.try_divide(change, 2 * F.col(f"A_{kind}") + change)

    def both(*columns: Column | str) -> list[Column | str]:
        kinds = [F.struct(F.lit(k == "p").alias("pa_tr"), dissimilarity(k).alias("d")) for k in "pa"]
        return [*columns, F.inline(F.array(*kinds))]

    bin_of = (F.col("_site") % F.col("_bins")).alias("_bin")
    filled = entries.where(" + ".join(measures) + " > 0").select("comparison", *SITE_YEAR, "species", *measures)
    spread = int(catch_full.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Entries are spread evenly before each is multiplied by the rotations.
    moved = (
        filled.join(placed.select("comparison", *SITE_YEAR, "_site"), ["comparison", *SITE_YEAR])
        .join(sizes, "comparison")
        .repartition(spread, "comparison", *SITE_YEAR, "species")
        .withColumn("_rotation", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rotations").cast("long"))))
        .withColumn(
            "_site",
            (F.col("_site") + hash_uint32(F.lit(config.seed), F.col("species"), F.col("_rotation"))) % F.col("_size"),
        )
    )
    rotated = moved.groupBy("comparison", "_site", "_rotation", "_bins").agg(*[F.sum(m).alias(m) for m in measures])
    draws = rotated.select(*both("comparison", bin_of)).where(F.col("d").isNotNull())
    observed = placed.join(sizes, "comparison").select(*both("comparison", *SITE_YEAR, bin_of, "_size", "_bins", "_rotations"))

    # Draws stand before observed values they reach within the tolerance; a bin has some n_perm rows.
    in_bin = Window.partitionBy("comparison", "_bin", "pa_tr").orderBy(F.desc_nulls_last("_value"), F.desc("_drawn"))
    stacked = draws.select("comparison", "_bin", "pa_tr", F.col("d").alias("_value"), F.lit(1).alias("_drawn")).unionByName(
        observed.withColumns({"_value": F.col("d") - TOLERANCE, "_drawn": F.lit(0)}), allowMissingColumns=True
    )
    in_this_bin = F.floor(F.col("_size") / F.col("_bins")) + F.when(F.col("_bin") < F.col("_size") % F.col("_bins"), 1).otherwise(0)
    counted = stacked.withColumn("_hits", F.sum("_drawn").over(in_bin.rowsBetween(Window.unboundedPreceding, 0))).where("_drawn = 0")
    return counted.select(
        "comparison", "pa_tr", *SITE_YEAR, "d",
        F.when(F.col("d").isNotNull(), (F.col("_hits") + 1) / (F.col("_rotations") * in_this_bin + 1)).alias("p_value"),
    )


def net_change_by_panel(turnover_table: DataFrame) -> DataFrame:
    """Mean net change, its standard error and the share of losses per comparison and type."""
    return turnover_table.groupBy("comparison", "pa_tr").agg(
        F.count("d").alias("n_pairs"),
        F.avg(F.col("c_stnd") - F.col("b_stnd")).alias("net_change"),
        (F.stddev_samp(F.col("c_stnd") - F.col("b_stnd")) / F.sqrt(F.count("d"))).alias("net_change_se"),
        F.avg(F.try_divide("b_stnd", "d")).alias("loss_share"),
    )
