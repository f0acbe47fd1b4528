"""Summaries of draws tables: `draw, param, value`, from any resampling or simulation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import labels, text
from fieldtally.operators.ordered import group_quantiles
from fieldtally.operators.permutation import hash_uint32
from fieldtally.operators.reshape import only_value

LINKS = {
    "identity": lambda c: c,
    "logit": lambda c: F.lit(1.0) / (1 + F.exp(-c)),
    "log": F.exp,
}


def gather_draws(draws: DataFrame, pattern: str) -> DataFrame:
    """Draws of the parameters whose name matches a regular expression."""
    return draws.where(F.col("param").rlike(pattern))


def draws_to_long(wide: DataFrame, *, draw: str = "draw", pattern: str = ".*") -> DataFrame:
    """One column per parameter to one row per draw and parameter."""
    columns = [c for c in wide.columns if c != draw]
    return gather_draws(wide.unpivot([draw], columns, "param", "value"), pattern)


def draws_to_wide(draws: DataFrame, params: Sequence[str]) -> DataFrame:
    """One row per draw with the named parameters as columns."""
    return draws.groupBy("draw").pivot("param", list(params)).agg(only_value("value"))


def first_draws(draws: DataFrame, n: int) -> DataFrame:
    return draws.where(F.col("draw") <= n)


def sample_draws(draws: DataFrame, share: float, *, seed: int = 0) -> DataFrame:
    """Whole draws kept with probability `share`, decided by the draw number alone."""
    return draws.where(hash_uint32(F.lit(seed), F.col("draw")) < F.lit(int(share * 2**32)))


def _edge(width: float, upper: bool) -> float:
    return round(0.5 + width / 2 if upper else 0.5 - width / 2, 12)


def point_intervals(
    draws: DataFrame, *, by: Sequence[str] = ("param",), value: str = "value",
    widths: Sequence[float] = (0.95,), point: str = "mean",
) -> DataFrame:
    """Mean or median with equal-tailed intervals, one row per group and width."""
    quantiles = {f"lo_{i}": _edge(w, False) for i, w in enumerate(widths)}
    quantiles |= {f"hi_{i}": _edge(w, True) for i, w in enumerate(widths)}
    if point == "median":
        quantiles["_point"] = 0.5
    summary = group_quantiles(draws, by=by, value=value, quantiles=quantiles)
    if point == "mean":
        summary = summary.join(draws.groupBy(*by).agg(F.avg(value).alias("_point")), list(by))
    rows = F.array(
        *[
            F.struct(
                F.lit(float(w)).alias("width"), F.col("_point").alias("value"),
                F.col(f"lo_{i}").alias("lower"), F.col(f"hi_{i}").alias("upper"),
            )
            for i, w in enumerate(widths)
        ]
    )
    return summary.select(*by, F.inline(rows))


def hypotheses(draws: DataFrame, tests: Sequence[tuple[str, Column, str]], *, params: Sequence[str]) -> DataFrame:
    """Linear hypotheses about parameters.

    Each test is (name, expression of parameter columns, one of `>`, `<`, `=`):
    the expression is compared with zero. Directional tests carry a 90 % interval
    and the share of draws that agree; point tests a 95 % interval and no share.
    """
    wide = draws_to_wide(draws, params)
    rows = F.array(
        *[F.struct(F.lit(n).alias("hypothesis"), F.lit(op).alias("op"), e.alias("value")) for n, e, op in tests]
    )
    long = wide.select(F.inline(rows)).where(F.col("value").isNotNull())
    agrees = F.when(F.col("op") == ">", F.col("value") > 0).when(F.col("op") == "<", F.col("value") < 0)
    summary = long.groupBy("hypothesis", "op").agg(
        F.avg("value").alias("estimate"),
        F.stddev_samp("value").alias("std_error"),
        F.avg(agrees.cast("double")).alias("probability"),
        F.count(F.lit(1)).alias("n_draws"),
    )
    edges = group_quantiles(
        long, by=["hypothesis"], value="value",
        quantiles={"q025": 0.025, "q05": 0.05, "q95": 0.95, "q975": 0.975},
    )
    directional = F.col("op") != "="
    return summary.join(edges, "hypothesis").select(
        "hypothesis", "estimate", "std_error",
        F.when(directional, F.col("q05")).otherwise(F.col("q025")).alias("lower"),
        F.when(directional, F.col("q95")).otherwise(F.col("q975")).alias("upper"),
        "probability",
        F.try_divide(F.col("probability"), 1 - F.col("probability")).alias("evidence_ratio"),
        "n_draws",
    )


def probability_of_direction(draws: DataFrame, *, by: Sequence[str] = ("param",), value: str = "value") -> DataFrame:
    """Share of draws on the median's side of zero."""
    medians = group_quantiles(draws, by=by, value=value, quantiles={"median": 0.5})
    sides = draws.groupBy(*by).agg(
        F.count(F.when(F.col(value) > 0, 1)).alias("_above"),
        F.count(F.when(F.col(value) < 0, 1)).alias("_below"),
        F.count(value).alias("_n"),
    )
    agreeing = F.when(F.col("median") > 0, F.col("_above")).when(F.col("median") < 0, F.col("_below")).otherwise(0)
    return sides.join(medians, list(by)).select(*by, "median", F.try_divide(agreeing, F.col("_n")).alias("pd"))


def predict_draws(
    draws: DataFrame, grid: DataFrame, terms: Mapping[str, str], *, intercept: str | None = None, link: str = "identity"
) -> DataFrame:
    """Prediction of every draw at every grid row.

    `terms` maps a parameter to the grid column it multiplies. The grid holds a
    chosen covariate settings. Draws are dealt evenly over parts and every part
    joins a copy of the grid, so neither side is gathered.
    """
    params = [*([intercept] if intercept else []), *terms]
    wide = draws_to_wide(draws, params).dropna(subset=params)
    linear = F.col(intercept) if intercept else F.lit(0.0)
    for param, column in terms.items():
        linear = linear + F.col(param) * F.col(f"_grid.{column}")
    parts = int(draws.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = grid.select(F.struct(*grid.columns).alias("_grid"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    dealt = wide.withColumn("_part", F.pmod(F.xxhash64("draw"), F.lit(parts)).cast("int"))
    return dealt.join(copies, "_part").select(
        "draw", "_grid.*", LINKS[link](linear).alias("value")
    )


def add_group_effect(predictions: DataFrame, effects: DataFrame, *, levels: DataFrame | None = None) -> DataFrame:
    """Shift linear predictions by each group's effect in the same draw.

    `effects` is `draw, level, effect`; `levels` can restrict which levels belong
    to a grid row (its other columns are the keys).
    """
    joined = predictions.join(effects, "draw")
    if levels is not None:
        keys = [c for c in levels.columns if c in joined.columns]
        joined = joined.join(levels, keys)
    return joined.withColumn("value", F.col("value") + F.col("effect")).drop("effect")


def broadcast_category(df: DataFrame, *, by: Sequence[str], category: str, level: str, value: str, name: str) -> DataFrame:
    """Give every row of a group the value its `level` row has.

    An aggregation joined back, so a group may be large.
    """
    picked = df.where(F.col(category) == level).groupBy(*by).agg(F.max(value).alias(name))
    return df.join(picked, list(by), "left")


def ratio_draws(draws: DataFrame, ratios: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Per-draw ratios of two parameters, e.g. of two standard deviations."""
    params = sorted({p for pair in ratios.values() for p in pair})
    rows = F.array(
        *[F.struct(F.lit(n).alias("param"), F.try_divide(a, b).alias("value")) for n, (a, b) in ratios.items()]
    )
    return draws_to_wide(draws, params).select("draw", F.inline(rows)).where(F.col("value").isNotNull())


def loss_share_draws(draws: DataFrame, *, losses: str = "bstnd", gains: str = "cstnd") -> DataFrame:
    """Per draw: losses as a share of losses plus gains, and their sum."""
    wide = draws_to_wide(draws, [losses, gains]).dropna()
    both = F.col(losses) + F.col(gains)
    return wide.select("draw", F.try_divide(F.col(losses), both).alias("loss_share"), both.alias("total"))


def r2_draws(fitted: DataFrame, *, fit: str = "fitted", observed: str = "observed") -> DataFrame:
    """Per draw: variance of the fit over variance of the fit plus of the residuals."""
    variances = fitted.groupBy("draw").agg(
        F.var_samp(fit).alias("_fit"), F.var_samp(F.col(observed) - F.col(fit)).alias("_residual")
    )
    return variances.select("draw", F.try_divide("_fit", F.col("_fit") + F.col("_residual")).alias("value"))


def group_effect_table(draws: DataFrame, *, share: float = 0.1, seed: int = 0) -> DataFrame:
    """Readable group effects from names like `r_group[level,Intercept]`, by size of effect."""
    sampled = sample_draws(gather_draws(draws, r"^r_.*\["), share, seed=seed)
    inner = F.regexp_extract("param", r"\[([^,\]]+)", 1)
    level = F.when(inner.contains("_"), F.regexp_extract(inner, "_(.+)$", 1)).otherwise(inner)
    named = sampled.select(
        "draw", "value",
        F.regexp_extract("param", r"^(.+)\[", 1).alias("random_effect"),
        text.sentence_case(level).alias("name"),
    )
    sizes = group_quantiles(
        named.withColumn("_abs", F.abs("value")), by=["random_effect"], value="_abs", quantiles={"effect_size": 0.5}
    )
    medians = group_quantiles(named, by=["random_effect", "name"], value="value", quantiles={"median": 0.5})
    return medians.join(sizes, "random_effect")


def base_levels(frame: DataFrame, variables: Sequence[str]) -> DataFrame:
    """First level of each categorical variable, "None" before all others."""
    first = frame.agg(*[labels.base_level(F.col(v)).alias(v) for v in variables])
    return first.unpivot([], list(variables), "variable", "base_level")


def effect_sizes(
    draws: DataFrame, bases: DataFrame, *, widths: Sequence[float] = (0.66, 0.95), point: str = "mean"
) -> DataFrame:
    """Coefficient intervals with response, variable, level and a `level vs. base` label."""
    name = F.col("param")
    slopes = gather_draws(draws, "^b_").where(~name.contains("Intercept"))
    intervals = point_intervals(slopes, by=["param"], widths=widths, point=point)
    parsed = intervals.withColumns(
        {
            "response": labels.coefficient_response(name),
            "variable": labels.coefficient_variable(name),
            "level": labels.coefficient_level(name),
        }
    )
    joined = parsed.join(bases, "variable", "left")
    base = F.when(F.col("level").isNotNull(), F.col("base_level"))
    return joined.select(
        "param", "response", "variable", "level",
        base.alias("base_level"),
        labels.level_versus_base(F.col("variable"), F.col("level"), base).alias("var_level"),
        labels.dissimilarity_part(F.col("response")).alias("response_label"),
        base.isNotNull().alias("categorical"),
        "width", "value", "lower", "upper",
        labels.widest_same_side(F.col("value"), F.col("lower"), F.col("upper")).alias("label_position"),
    )


def widest_interval(intervals: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """Estimate and ends of the widest interval per group."""
    last = F.max_by(F.struct("value", "lower", "upper"), F.col("width")).alias("_last")
    return intervals.groupBy(*by).agg(last).select(*by, "_last.*")
