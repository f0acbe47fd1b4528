"""Code-to-label maps and model coefficient names."""

from __future__ import annotations

from collections.abc import Mapping

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Channel codes. Code 2 has no label.
CHANNEL_TYPES = {0: "None", 1: "Earth", 3: "Earth & Concrete"}

# Short labels of the four site categories.
SITE_CATEGORIES = {
    "Reservoir for irrigation in upland area": "(1) Irrigation reservoir",
    "Community pond within agricultural land not prone to flood": "(2) Not-flooding pond",
    "Community pond within agricultural land prone to flood": "(3) Flooding pond",
    "Demarcated area in larger water body": "(4) Large water body",
}

# Wording for the parts of a dissimilarity.
DISSIMILARITY_PARTS = {
    "bstnd": "Dissimilarity due to losses",
    "cstnd": "Dissimilarity due to gains",
}
DISSIMILARITY_TOTAL = "Total dissimilarity"


def map_codes(col: Column, mapping: Mapping[object, str], default: str | None = None) -> Column:
    """Label per code; anything else becomes `default`."""
    out = F.lit(default).cast("string")
    for code, label in mapping.items():
        out = F.when(col == F.lit(code), F.lit(label)).otherwise(out)
    return out


def short_category(col: Column, mapping: Mapping[str, str] = SITE_CATEGORIES, *, digit_only: bool = False) -> Column:
    short = map_codes(col, mapping)
    return F.regexp_extract(short, "[1-4]", 0) if digit_only else short


def dissimilarity_part(col: Column) -> Column:
    return map_codes(col, DISSIMILARITY_PARTS, DISSIMILARITY_TOTAL)


def is_true_code(col: Column, code: int = 1) -> Column:
    return col == code


def not_no(col: Column) -> Column:
    """True unless the answer is `no`; a missing answer stays missing."""
    return F.lower(col) != "no"


def yes_no(col: Column) -> Column:
    return F.when(col, "yes").when(~col, "no")


def coefficient_response(name: Column) -> Column:
    """`bstnd` from `b_bstnd_depth`."""
    return F.nullif(F.regexp_extract(name, "^b_([a-z]+)_", 1), F.lit(""))


def coefficient_level(name: Column) -> Column:
    """Category level: the tail that starts with a capital letter, if any."""
    return F.nullif(F.regexp_extract(name, "[A-Z].+$", 0), F.lit(""))


def coefficient_variable(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "^b_[a-z]+_", ""), "[A-Z].+$", "")


def level_versus_base(variable: Column, level: Column, base: Column) -> Column:
    compared = F.concat(variable, F.lit(" ("), level, F.lit(" vs. "), base, F.lit(")"))
    return F.when(level.isNull(), variable).otherwise(compared)


def widest_same_side(value: Column, low: Column, high: Column) -> Column:
    """Interval end on the same side of zero as `value`, the farther one."""
    side = F.signum(value)
    low_fits, high_fits = F.signum(low) == side, F.signum(high) == side
    farther = F.when(F.abs(low) >= F.abs(high), low).otherwise(high)
    return F.when(low_fits & high_fits, farther).when(low_fits, low).when(high_fits, high)


def ordered_levels(levels: Iterable[str]) -> list[str]:
    """Levels of a category in order, "None" first: the first one is the base of contrasts."""
    return sorted(levels, key=lambda level: (level != "None", level))


def base_level(col: Column) -> Column:
    """Aggregate: the first of a column's levels in that order."""
    name = col.cast("string")
    return F.min(F.when(name.isNotNull(), F.struct((name != "None").alias("other"), name.alias("level"))))["level"]
