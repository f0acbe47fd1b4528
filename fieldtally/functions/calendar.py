"""Dates, seasons and flood years."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: day zero of the spreadsheet serial date.
SPREADSHEET_EPOCH = "1899-12-30"


def spreadsheet_date(serial: Column) -> Column:
    return F.date_add(F.lit(SPREADSHEET_EPOCH).cast("date"), serial.cast("int"))


def year_text(date: Column) -> Column:
    return F.year(date).cast("string")


def month_text(date: Column) -> Column:
    return F.month(date).cast("string")


def season(date: Column, dry_months: Sequence[int] = (2, 5)) -> Column:
    return F.when(F.month(date).isin(*dry_months), "dry").otherwise("wet")


def occasion_number(occasion: Column) -> Column:
    return F.regexp_extract(occasion, "[0-9]+", 0).cast("int")


def flood_year(occasion: Column) -> Column:
    """Index of the November-to-August cycle an occasion belongs to (from 0)."""
    return F.floor((occasion_number(occasion) - 1) / 4).cast("int")


def month_key(month: Column) -> Column:
    return F.concat(F.lit("m_"), month)


def is_dry_occasion(occasion: Column) -> Column:
    return (occasion_number(occasion) % 4).isin(2, 3)


def month_name(key: Column) -> Column:
    """English month name from any text holding the month number."""
    number = F.regexp_extract(key, "[0-9]+", 0).cast("int")
    return F.date_format(F.make_date(F.lit(2000), number, F.lit(1)), "MMMM")


def flood_year_label(year: Column, labels: Mapping[int, str]) -> Column:
    out = year.cast("string")
    for index, label in labels.items():
        out = F.when(year == index, F.lit(label)).otherwise(out)
    return out
