import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.functions import calendar, labels, numbers, special, text


def test_headers():
    assert text.normalise_headers(["CfrID", "Category", "Category", "Water Tem.", "RFWaterLevel", "Large WB (yes=1, no=2)"]) == [
        "cfr_id", "category", "category_1", "water_tem", "rf_water_level", "large_wb_yes_1_no_2",
    ]


def test_half_even_rounding(one):
    assert one(*[numbers.half_even(F.lit(v)) for v in (0.5, 1.5, 2.5, -2.5)]) == (0.0, 2.0, 2.0, -2.0)


def test_cap_keeps_null(one):
    null = F.lit(None).cast("double")
    assert one(numbers.cap(F.lit(120.0), 100), numbers.cap(F.lit(80.0), 100), numbers.cap(null, 100)) == (100.0, 80.0, None)


def test_spreadsheet_date_and_flood_year(one):
    day, *years = one(calendar.spreadsheet_date(F.lit(41226)), *[calendar.flood_year(F.lit(o)) for o in ("oc01", "oc04", "oc05", "oc13")])
    assert str(day) == "2012-11-13" and years == [0, 0, 1, 3]


def test_channel_code_two_has_no_label(one):
    got = one(*[labels.map_codes(F.lit(c), labels.CHANNEL_TYPES) for c in (0, 1, 2, 3)])
    assert got == ("None", "Earth", None, "Earth & Concrete")


def test_text_pieces(one):
    null = F.lit(None).cast("string")
    assert one(
        text.padded_id(F.lit(3), "fr", F.lit(40)),
        text.strip_parenthesis(F.lit("Pond (natural)")),
        text.composite_key(F.lit("a"), null, F.lit("c")),
        text.sentence_case(F.lit("channa_striata.X")),
        text.snake_case(F.lit(" Black fish!")),
        text.repair_text(F.lit("soft­hyphen")),
        text.p_value_text(F.lit(0.0002)),
        text.percent_text(F.lit(-0.5)),
        text.interval_text(F.lit(1.0), F.lit(0.5), F.lit(2.25)),
    ) == ("fr03", "Pond", "a_NA_c", "Channa striata x", "black_fish", "softhyphen", "<0.001", "-50.0%", "1.00 [0.50, 2.25]")


def test_unicode_repair_composes(spark):
    row = spark.createDataFrame([("é​au",)], "t string").select(text.repair_text(F.col("t"), encoding="utf-8"))
    assert row.first()[0] == "éau"


def test_enumerate_text(one):
    def named(*items):
        return text.enumerate_text(F.array(*[F.lit(i) for i in items]))

    assert one(named("A"), named("A", "B"), named("A", "B", "C")) == ("A", "A, and B", "A, B, and C")


def test_equal_width_bins(spark):
    df = spark.range(1, 15).select(numbers.equal_width_bin(F.col("id"), F.lit(1), F.lit(14), 7).alias("b"))
    assert [r.b for r in df.collect()] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7]


def test_logit_and_percent_change(one):
    got = one(numbers.logit(F.lit(0.0)), numbers.logit(F.lit(0.5)), numbers.logit(F.lit(1.0)), numbers.percent_change(F.lit(math.log(0.5))))
    assert got[:3] == (None, 0.0, None) and got[3] == pytest.approx(-0.5)


def test_scaling_round_trip(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    scaled = numbers.standardise_columns(df, ["x"], params="p")
    p = scaled.first().p
    z = [r.x for r in scaled.collect()]
    assert np.std(z, ddof=1) == pytest.approx(1.0)
    back = scaled.select(numbers.unstandardise(F.col("x"), F.lit(p.x_center), F.lit(p.x_scale))).collect()
    assert sorted(r[0] for r in back) == pytest.approx([1.0, 2.0, 4.0])


def test_not_no_keeps_missing(one):
    null = F.lit(None).cast("string")
    assert one(labels.not_no(F.lit("NO")), labels.not_no(F.lit("rats")), labels.not_no(null)) == (False, True, None)


def test_coefficient_names(one):
    name = F.lit("b_bstnd_type_inlet_outletWaterGate")
    response, variable, level = labels.coefficient_response(name), labels.coefficient_variable(name), labels.coefficient_level(name)
    assert one(response, variable, level, labels.level_versus_base(variable, level, F.lit("None"))) == (
        "bstnd", "type_inlet_outlet", "WaterGate", "type_inlet_outlet (WaterGate vs. None)",
    )


def test_widest_same_side(one):
    def pick(v, lo, hi):
        return labels.widest_same_side(F.lit(v), F.lit(lo), F.lit(hi))

    assert one(pick(1.0, -3.0, 2.0), pick(-1.0, -3.0, -0.5), pick(1.0, 0.5, 2.0)) == (2.0, -3.0, 2.0)


def test_tail_probabilities():
    # Published table points of the t and F distributions.
    t = lambda v, df: float(special.regularised_beta(df / 2, 0.5, df / (df + v * v)))
    assert t(12.706204736, 1) == pytest.approx(0.05, abs=1e-9)
    assert t(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert t(1.959963985, 1e7) == pytest.approx(0.05, abs=1e-6)
    assert float(special.regularised_beta(5, 1.5, 10 / (10 + 3 * 3.708264819))) == pytest.approx(0.05, abs=1e-8)


def test_site_category_labels(one):
    full = "Community pond within agricultural land prone to flood"
    assert one(labels.short_category(F.lit(full)), labels.short_category(F.lit(full), digit_only=True)) == ("(3) Flooding pond", "3")


def test_none_is_the_base_level(spark):
    from fieldtally.functions import labels
    from fieldtally.operators import draws, models

    levels = ["Water Gate", "Earth", "None"]
    assert labels.ordered_levels(levels) == ["None", "Earth", "Water Gate"]
    df = spark.createDataFrame([(v, "b") for v in [*levels, None]], "channel string, shape string")
    bases = {r.variable: r.base_level for r in draws.base_levels(df, ["channel", "shape"]).collect()}
    assert bases == {"channel": "None", "shape": "b"}
    assert list(models.design_columns({"channel": levels}, [])) == ["(Intercept)", "channelEarth", "channelWater Gate"]
    table = spark.createDataFrame([(k, "b_bstnd_channelEarth", float(k)) for k in range(20)], "draw long, param string, value double")
    shown = {r.var_level for r in draws.effect_sizes(table, draws.base_levels(df, ["channel"])).collect()}
    assert shown == {"channel (Earth vs. None)"}
