"""The survey analysis as named, lazily composed tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from fieldtally.adapters import raw_records, stored_tables, summed_records
from fieldtally.config import SESSION_CONF, SurveyConfig
from fieldtally.operators import change, cleaning, dims, diversity, effort, quality, turnover
from fieldtally.operators.lineage import cut


class Survey:
    """Every table of the analysis, from raw records on; each is built when first asked for.

    The clean fact table is written once, so whatever makes the raw records and all
    cleaning run once; whoever reads it pays only for the columns used. Where the raw
    records are `stored` already, the wide fact table is not written a second time:
    each table cleans the columns it uses. The dimension tables, the catches and the
    derived tables that feed several analyses are written in either case.

    `summed` gives the raw rows summed over equal visits, replicates, gears and names.
    Dimension tables and catch totals then come from these instead of from all records.
    """

    def __init__(
        self, raw: DataFrame, config: SurveyConfig = SurveyConfig(), *, stored: bool = False, summed: Callable[[], DataFrame] | None = None
    ):
        self.raw, self.config, self.stored, self.summed = raw, config, stored, summed

    @cached_property
    def names(self) -> DataFrame:
        """Species names, from the summed rows where these are written already."""
        return cleaning.survey_names(self.raw_sums if "raw_sums" in vars(self) else self.raw, self.config)

    @cached_property
    def clean(self) -> DataFrame:
        cleaned = cleaning.clean_survey(self.raw, self.config, names=self.names)
        return cleaned if self.stored else cut(cleaned)

    @cached_property
    def raw_sums(self) -> DataFrame:
        return self.summed()

    @cached_property
    def clean_sums(self) -> DataFrame:
        """Clean rows summed over equal samplings and species names; the clean records themselves where nobody sums them."""
        return self.clean if self.summed is None else cleaning.clean_survey(self.raw_sums, self.config, names=self.names)

    @cached_property
    def refuge_info(self) -> DataFrame:
        return cut(dims.refuge_info(self.clean_sums))

    @cached_property
    def occasion_info(self) -> DataFrame:
        return cut(dims.occasion_info(self.clean_sums))

    @cached_property
    def sampling_info(self) -> DataFrame:
        return dims.sampling_info(self.clean_sums)

    @cached_property
    def casting_info(self) -> DataFrame:
        return dims.casting_info(self.clean_sums)

    @cached_property
    def species_info(self) -> DataFrame:
        return cut(dims.species_info(self.clean_sums, self.config))

    @cached_property
    def catch_info(self) -> DataFrame:
        return cut(dims.catch_info(self.clean))

    @property
    def catch_rows(self) -> DataFrame:
        """The catches for one reading: cleaned on the way where stored records stand behind them and no catches are written yet."""
        return dims.catch_info(self.clean) if self.stored and "catch_info" not in vars(self) else self.catch_info

    @cached_property
    def catch_sums(self) -> DataFrame:
        """Catches for totals: one row or more per sampling and species, with the same sums as the catches."""
        return self.catch_info if self.summed is None else cut(dims.catch_sums(self.clean_sums))

    @cached_property
    def occasion_covariates(self) -> DataFrame:
        return dims.occasion_covariates(self.occasion_info, self.config)

    @cached_property
    def refuge_covariates(self) -> DataFrame:
        return dims.refuge_covariates(self.refuge_info)

    @cached_property
    def diversity(self) -> DataFrame:
        """Diversity of log counts, uncorrected for effort (effort enters models as an offset)."""
        raw_totals = effort.effort_totals(self.catch_sums, self.config, standard=False)
        return cut(diversity.alpha_diversity(raw_totals, transform="log1p"))

    @cached_property
    def diversity_frame(self) -> DataFrame:
        return cut(diversity.diversity_frame(self.diversity, self.occasion_covariates, self.refuge_covariates))

    @cached_property
    def diversity_by_month(self) -> DataFrame:
        return cut(diversity.diversity_by_month(self.diversity_frame, self.refuge_covariates))

    @cached_property
    def catch_full(self) -> DataFrame:
        return cut(effort.catch_by_season(self.catch_sums, self.occasion_covariates, self.config))

    @cached_property
    def turnover(self) -> DataFrame:
        return cut(turnover.turnover(self.catch_full, self.config))

    @cached_property
    def turnover_model_frame(self) -> DataFrame:
        return cut(
            dims.turnover_model_frame(
                self.turnover,
                dims.occasion_covariates_turnover(self.occasion_info, self.config),
                dims.refuge_covariates_turnover(self.refuge_info),
            )
        )

    @cached_property
    def species_changes(self) -> DataFrame:
        return change.species_changes(self.catch_full, self.species_info, self.config)

    def check(self) -> None:
        """Raise unless the dimension tables have one row per key."""
        quality.require_unique(self.refuge_info, ["refuge"], table="refuge_info")
        quality.require_unique(self.occasion_info, ["sampling"], table="occasion_info")
        quality.require_unique(self.sampling_info, ["sampling"], table="sampling_info")
        quality.require_unique(self.species_info, ["species"], table="species_info")
        quality.require_unique(self.species_info, ["species_name"], table="species_info")


# The test tables have six complete flood years.
TABLES_CONFIG = SurveyConfig(complete_years=6)
_STORED: dict[tuple, Survey] = {}


def compiled_plans(spark: SparkSession) -> None:
    """The session's limit for generated methods as in SESSION_CONF, unless the caller chose one: wide rows run compiled, not interpreted."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key) == "65535":  # Spark's default
        spark.conf.set(key, SESSION_CONF[key])


def _file_state(spark: SparkSession, folder: str) -> tuple:
    """Names, lengths and change times of a folder's entries, as the file system gives them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found)


def survey_of_tables(spark: SparkSession, sf_dir: str, *, fresh: bool = False) -> Survey:
    """The survey read from the order-and-parts tables; stored tables are shared within a session while the files stay as they are."""
    key = (spark.sparkContext.applicationId, sf_dir, _file_state(spark, sf_dir))
    if fresh or key not in _STORED:
        records, visits, attributes = stored_tables(spark, sf_dir)
        _STORED[key] = Survey(
            raw_records(records, visits), TABLES_CONFIG, stored=True, summed=lambda: summed_records(records, visits, attributes)
        )
    return _STORED[key]
