"""Text columns: names, ids, labels and number formatting."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fieldtally.functions import ship_by_value

ship_by_value(__name__)

SOFT_HYPHEN = "\u00ad"

# Code points that Unicode marks as default-ignorable.
IGNORABLE_CODE_POINTS = (
    "[\\u00AD\\u034F\\u061C\\u115F\\u1160\\u17B4\\u17B5\\u180B-\\u180F\\u200B-\\u200F"
    "\\u202A-\\u202E\\u2060-\\u206F\\u3164\\uFE00-\\uFE0F\\uFEFF\\uFFA0\\uFFF0-\\uFFF8]"
)


def normalise_headers(names: Sequence[str]) -> list[str]:
    """Snake-case column headers; a repeated header gets `_1`, `_2`, ..."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        text = name.replace("%", " percent ").replace("#", " number ")
        text = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", text)
        text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
        text = re.sub(r"[^A-Za-z0-9]+", "_", text).strip("_").lower() or "x"
        if text[0].isdigit():
            text = f"x{text}"
        repeat = seen.get(text, 0)
        seen[text] = repeat + 1
        out.append(f"{text}_{repeat}" if repeat else text)
    return out


def sentence_case(col: Column) -> Column:
    words = F.trim(F.regexp_replace(col, r"[._\s]+", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substr(words, F.lit(2))))


def snake_case(col: Column) -> Column:
    words = F.regexp_replace(F.trim(col), "[^A-Za-z0-9]+", "_")
    return F.lower(F.regexp_replace(words, "^_+|_+$", ""))


def padded_id(number: Column, prefix: str, largest: Column) -> Column:
    """`prefix` + number, zero-padded to the width of the largest number."""
    width = F.length(largest.cast("string"))
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, F.lit("0")))


def composite_key(*cols: Column, sep: str = "_") -> Column:
    """Join key parts; a missing part is written as `NA`, not skipped."""
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("NA")) for c in cols])


def strip_parenthesis(col: Column) -> Column:
    return F.regexp_replace(col, r"\s\(.+\)", "")


def truncate(col: Column, length: int) -> Column:
    return F.substring(col, 1, length)


@F.pandas_udf(StringType())
def _compose_unicode(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFC")


def repair_text(col: Column, *, encoding: str = "latin1") -> Column:
    """Normalise text and drop ignorable code points.

    Text read as latin-1 holds no combining marks, so it is already in composed
    form, and its only ignorable code point is the soft hyphen: one byte search
    per value. Any other encoding needs the Arrow UDF and the full pattern.
    """
    if encoding == "latin1":
        return F.replace(col, F.lit(SOFT_HYPHEN), F.lit(""))
    return F.regexp_replace(_compose_unicode(col), IGNORABLE_CODE_POINTS, "")


def number_text(col: Column, decimals: int) -> Column:
    """Fixed-decimal text without digit grouping; halves of the decimal value go to the even digit."""
    return F.regexp_replace(F.format_number(F.bround(col.cast("double"), decimals), decimals), ",", "")


def percent_text(col: Column, decimals: int = 1) -> Column:
    return F.concat(number_text(col * 100, decimals), F.lit("%"))


def p_value_text(col: Column, decimals: int = 3) -> Column:
    smallest = 10.0**-decimals
    shown = number_text(col, decimals)
    zero = f"{0:.{decimals}f}"
    return F.when(shown == zero, F.lit(f"<{smallest:.{decimals}f}")).otherwise(shown)


def interval_text(value: Column, low: Column, high: Column, decimals: int = 2) -> Column:
    """`estimate [low, high]`."""
    return F.concat(
        number_text(value, decimals), F.lit(" ["),
        number_text(low, decimals), F.lit(", "),
        number_text(high, decimals), F.lit("]"),
    )


def enumerate_text(items: Column, *, sep: str = ", ", last: str = ", and ") -> Column:
    """One sentence fragment from an array of names: `A, B, and C`."""
    n = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), sep)
    tail = F.element_at(items, -1)
    return F.when(n == 0, "").when(n == 1, F.get(items, F.lit(0))).otherwise(F.concat(head, F.lit(last), tail))
