"""Numeric columns: rounding, transforms, scaling, bins and grids."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Transforms that operators accept by name.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {"I": lambda c: c, "log1p": F.log1p}


def half_even(col: Column) -> Column:
    """Round to a whole number, ties to even (`round` would send them away from zero)."""
    return F.rint(col)


def cap(col: Column, limit: float) -> Column:
    """Largest allowed value; NULL stays NULL (`least` would return the limit)."""
    return F.when(col > limit, F.lit(float(limit))).otherwise(col)


def null_if(col: Column, sentinel: float) -> Column:
    return F.nullif(col, F.lit(sentinel))


def zero_to(col: Column, epsilon: float) -> Column:
    return F.when(col == 0, F.lit(epsilon)).otherwise(col)


def logit(col: Column) -> Column:
    """NULL outside the open interval (0, 1)."""
    inside = (col > 0) & (col < 1)
    return F.when(inside, F.ln(F.try_divide(col, 1 - col)))


def correlation_of(a: Column, b: Column) -> Column:
    """Pearson aggregate over rows with both values; NULL when either does not vary."""
    both = a.isNotNull() & b.isNotNull()
    spread = F.sqrt(F.var_pop(F.when(both, a)) * F.var_pop(F.when(both, b)))
    return F.try_divide(F.covar_pop(a, b), spread)


def percent_change(log_difference: Column) -> Column:
    return F.expm1(log_difference)


def log1p_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.log1p(F.col(c)) for c in columns})


def standardise_columns(df: DataFrame, columns: Sequence[str], *, params: str = "_scaling") -> DataFrame:
    """Z-scores with the sample standard deviation; the struct column `params` holds `<column>_center` and `_scale`."""
    both = df.agg(
        F.struct(
            *[F.avg(c).alias(f"{c}_center") for c in columns],
            *[F.stddev_samp(c).alias(f"{c}_scale") for c in columns],
        ).alias("p")
    ).scalar()
    held = df.withColumn(params, both)
    return held.withColumns(
        {
            c: F.try_divide(F.col(c) - F.col(f"{params}.{c}_center"), F.col(f"{params}.{c}_scale"))
            for c in columns
        }
    )


def unstandardise(col: Column, center: Column, scale: Column) -> Column:
    return col * scale + center


def equal_width_bin(col: Column, low: Column, high: Column, bins: int) -> Column:
    """Right-closed equal-width bin number from 1 to `bins`."""
    width = (high - low) / F.lit(float(bins))
    raw = F.ceil(F.try_divide(col - low, width))
    bounded = F.least(F.lit(bins), F.greatest(F.lit(1), raw.cast("int")))
    return F.when(width == 0, F.lit(1)).otherwise(bounded)


def even_grid(df: DataFrame, column: str, points: int = 50, *, by: Sequence[str] = ()) -> DataFrame:
    """Evenly spaced values between the observed minimum and maximum."""
    ends = df.groupBy(*by).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    step = F.col("point").cast("double") / F.lit(float(points - 1))
    return ends.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select(
        *by, "point", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * step).alias(column)
    )
