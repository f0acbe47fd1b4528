"""Settings shared by the survey operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SurveyConfig:
    """Parameters of one survey programme.

    `dropped_site_years` lists (site, flood year) pairs that could not be
    sampled; `complete_years` is the number of flood years with all four
    visits, counted from the first.
    """

    excluded_species: tuple[str, ...] = ("Unname",)
    n_fish_types: int = 3
    primary_gear: str = "GN"
    standard_effort: int = 8
    dropped_site_years: tuple[tuple[str, int], ...] = (("fr15", 0),)
    complete_years: int = 3
    comparisons: tuple[tuple[str, str], ...] = (("2", "5"), ("5", "8"), ("5", "11"))
    dry_months: tuple[int, ...] = (2, 5)
    n_perm: int = 9999
    seed: int = 0


# Session settings the operators are meant to run with. Survey tables are wide:
# generated methods above 8000 bytecodes are not compiled by the JVM, so Spark
# should fall back to smaller ones there.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}
