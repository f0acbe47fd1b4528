"""Raw survey records to the clean fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.config import SurveyConfig
from fieldtally.functions import calendar, labels, text
from fieldtally.operators.lineage import cut

# Raw header (after normalisation) -> clean column name.
RENAMED = {
    "category_1": "category",
    "fi_a_designated": "fia_designated",
    "large_wb_yes_1_no_2": "large_water_body",
    "channel_1_earth_2_concrete_3_both": "channel_type",
    "no": "sampling",
    "cfr_id": "refuge",
    "water_tem": "water_temp",
    "illegal_fishing_seen": "illegal_fishing",
    "net_l": "net_length",
    "replicate_no": "replicate",
    "gear": "gear_name",
    "gear_code": "gear",
    "speciescode": "species_code",
}


def rename_raw(raw: DataFrame) -> DataFrame:
    """Drop the unreliable category column and give the others their clean names."""
    named = raw.toDF(*text.normalise_headers(raw.columns))
    return named.drop("category").withColumnsRenamed({k: v for k, v in RENAMED.items() if k in named.columns})


def repair_strings(df: DataFrame, *, encoding: str = "latin1") -> DataFrame:
    strings = [name for name, kind in df.dtypes if kind == "string"]
    return df.withColumns({c: text.repair_text(F.col(c), encoding=encoding) for c in strings})


def species_names(records: DataFrame, config: SurveyConfig = SurveyConfig()) -> DataFrame:
    """Per recorded name: the readable name, the smallest code under it and the largest id numbers.

    Records are first reduced to one row per recorded name, so names are edited
    once each and a name that holds a large share of the records is combined
    map-side; no window over records is needed. Excluded and missing names are
    left out. The reduced rows are written before both sides of the join read them.
    The result is written: joins broadcast it only if its size on disk allows that,
    otherwise they are shuffle joins whose hot names AQE splits.
    """
    numbers = ("refuge", "occasion", "replicate")
    recorded = cut(
        records.groupBy("species_name").agg(
            F.min("species_code").alias("_code"), *[F.max(c).alias(f"_most_{c}") for c in numbers]
        )
    )
    named = recorded.withColumn("_name", text.sentence_case(F.col("species_name"))).where(F.col("_name").isNotNull())
    for pattern in config.excluded_species:
        named = named.where(~F.col("_name").rlike(pattern))
    smallest = named.groupBy("_name").agg(F.min("_code").alias("_canonical"))
    return cut(named.drop("_code").join(smallest, "_name"))


def survey_names(raw: DataFrame, config: SurveyConfig = SurveyConfig(), *, encoding: str = "latin1") -> DataFrame:
    """The species names of raw rows, for `clean_survey` of these rows or of others with the same names, codes and ids."""
    return species_names(repair_strings(rename_raw(raw), encoding=encoding), config)


def clean_survey(
    raw: DataFrame, config: SurveyConfig = SurveyConfig(), *, encoding: str = "latin1", names: DataFrame | None = None
) -> DataFrame:
    """Clean fact table: one row per recorded catch, ids padded and labels readable.

    `names` are the species names where they are known already.
    """
    renamed = repair_strings(rename_raw(raw), encoding=encoding)
    labelled = renamed.withColumns(
        {
            "date": calendar.spreadsheet_date(F.col("date")),
            "channel_type": labels.map_codes(F.col("channel_type"), labels.CHANNEL_TYPES),
            "type_inlet_outlet": F.coalesce("type_inlet_outlet", F.lit("None")),
            "large_water_body": labels.is_true_code(F.col("large_water_body")),
            "illegal_fishing": labels.not_no(F.col("illegal_fishing")),
            "water_bird": labels.not_no(F.col("water_bird")),
            "other_animal": labels.not_no(F.col("other_animal")),
            "weather": F.lower("weather"),
        }
    )
    names = species_names(labelled, config) if names is None else names
    largest = names.agg(
        F.struct(
            F.max("_canonical").alias("species_code"),
            *[F.max(f"_most_{c}").alias(c) for c in ("refuge", "occasion", "replicate")],
        )
    ).scalar()
    coded = (
        labelled.join(names.select("species_name", "_name", "_canonical"), "species_name")
        .withColumns({"species_name": F.col("_name"), "species_code": F.col("_canonical")})
        .drop("_name", "_canonical")
    )
    ids = {
        name: text.padded_id(F.col(source), prefix, largest[source])
        for name, source, prefix in (
            ("refuge", "refuge", "fr"),
            ("occasion", "occasion", "oc"),
            ("replicate", "replicate", "re"),
            ("species", "species_code", "sp"),
        )
    }
    # One projection of the wide rows: keys are built from the padded ids themselves.
    return coded.withColumns(
        {
            **ids,
            "refuge_occasion": text.composite_key(ids["refuge"], ids["occasion"]),
            "sampling": text.composite_key(ids["refuge"], ids["occasion"], ids["replicate"], F.col("gear")),
        }
    )
