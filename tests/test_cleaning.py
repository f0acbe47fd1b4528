import pytest
from pyspark.sql import functions as F

from fieldtally.config import SurveyConfig
from fieldtally.operators import cleaning, dims, quality, reshape
from fieldtally.sources import files

HEADER = [
    "No", "CfrID", "Occasion", "Replicate no", "Gear", "Gear code", "Speciescode", "Species name", "Family", "Genus", "Group", "Type",
    "Date", "Category", "Category", "Category name", "FiA designated", "Large WB (yes=1, no=2)",
    "Channel (1-earth, 2-concrete, 3-both)", "Type inlet outlet", "Illegal fishing seen", "Water bird", "Other animal", "Weather",
    "Water tem", "Net L", "No fish", "Total weight",
]
TYPES = {
    "cfr_id": "int", "occasion": "int", "replicate_no": "int", "speciescode": "int", "date": "int", "water_tem": "double",
    "large_wb_yes_1_no_2": "int", "channel_1_earth_2_concrete_3_both": "int", "no_fish": "double", "total_weight": "double",
}


def record(site, occasion, replicate, code, name, fish="2", temp="28.5", channel="1", illegal="No"):
    return [
        "1", site, occasion, replicate, "Gill net", "GN", code, name, "Fam", "Gen", "G", "Black", "41226", "9", "4",
        "Pond (natural)", "x", "1", channel, "NA", illegal, "no", "", "SUNNY", temp, "30", fish, "1.5",
    ]


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "raw.csv"
    rows = [
        record("3", "1", "1", "12", "channa striata"),
        record("40", "13", "2", "7", "channa striata", fish="#VALUE!", temp="NA"),
        record("3", "1", "2", "15", "Unname 1"),
        record("3", "1", "2", "5", "café fish", channel="2", illegal="Yes"),
        record("3", "1", "2", "6", ""),
    ]
    text = "\n".join(",".join(f'"{c}"' for c in line) for line in [HEADER, *rows])
    path.write_bytes(text.encode("latin-1"))
    return files.read_survey_csv(spark, str(path), types=TYPES)


def test_csv_scan(raw):
    assert raw.columns[:5] == ["no", "cfr_id", "occasion", "replicate_no", "gear"]
    assert {"category", "category_1"} <= set(raw.columns)
    bad = raw.where("cfr_id = 40").first()
    assert bad.no_fish is None and bad.water_tem is None and bad.type_inlet_outlet is None
    assert raw.where("speciescode = 5").first().species_name == "café fish"


def test_clean_rules(raw):
    rows = {r.species_name: r for r in cleaning.clean_survey(raw, SurveyConfig()).where("refuge = 'fr03'").collect()}
    assert set(rows) == {"Channa striata", "Café fish"}  # excluded and missing names dropped
    striata, cafe = rows["Channa striata"], rows["Café fish"]
    assert (striata.species_code, striata.species) == (7, "sp7")  # smallest code of the name, width of the largest
    assert (striata.occasion, striata.replicate, striata.sampling) == ("oc01", "re1", "fr03_oc01_re1_GN")
    assert (striata.channel_type, cafe.channel_type) == ("Earth", None)
    assert (striata.illegal_fishing, cafe.illegal_fishing, striata.other_animal) == (False, True, None)
    assert str(striata.date) == "2012-11-13" and striata.type_inlet_outlet == "None" and striata.weather == "sunny"
    assert striata.category == "4" and striata.large_water_body is True


def test_lump_keeps_ties(spark):
    df = spark.createDataFrame([(t,) for t in "aaabbcc"], "type string")
    assert sorted(r.s for r in dims.lump_top(df, "type", 1, name="s").collect()) == ["Other"] * 4 + ["a"] * 3
    assert {r.s for r in dims.lump_top(df, "type", 2, name="s").collect()} == {"a", "b", "c"}


def test_key_checks(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "k string, v int")
    assert [tuple(r) for r in quality.duplicate_keys(df, ["k"]).collect()] == [("x", 2)]
    with pytest.raises(quality.DuplicateKeyError, match="several rows per k"):
        quality.require_unique(df, ["k"], table="t")
    quality.require_unique(df, ["v"], table="t")
    assert [r.k for r in quality.unpaired_keys(df, df.where("v < 3"), ["k"]).collect()] == ["y"]


def test_report_and_dataset_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    files.write_report_csv(df, str(tmp_path / "out"), single_file=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1
    assert files.save_dataset(df, str(tmp_path), "t").count() == files.load_dataset(spark, str(tmp_path), "t").count() == 1


def test_grid_and_wide(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "s string, g string")
    got = {(r.s, r.g): r.n for r in reshape.complete_counts(df, ["s", "g"]).collect()}
    assert got == {("a", "x"): 2, ("a", "y"): 0, ("b", "x"): 0, ("b", "y"): 1}
    counts = df.groupBy("s", "g").agg(F.count("*").alias("n"))
    wide = reshape.to_wide(counts, keys=["s"], names="g", values="n", levels=["x", "y"], fill=0)
    assert sorted(map(tuple, wide.collect())) == [("a", 2, 0), ("b", 0, 1)]
    with pytest.raises(Exception, match="several rows for one cell"):
        reshape.to_wide(df.withColumn("n", F.lit(1)), keys=["s"], names="g", values="n", levels=["x"], fill=0).collect()


def test_grid_keeps_missing_levels(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, "y")], "s string, g string")
    got = {(r.s, r.g): r.n for r in reshape.complete_counts(df, ["s", "g"]).collect()}
    assert got == {("a", None): 2, ("a", "y"): 0, (None, None): 0, (None, "y"): 1}


def test_column_selection(spark):
    df = spark.createDataFrame([(1, "a", 2.0, 3.0)], "sp1 int, name string, sp2 double, z double")
    assert reshape.columns_like(df, prefix="sp") == ["sp1", "sp2"]
    assert reshape.columns_like(df, numeric=True) == ["sp1", "sp2", "z"]
    assert reshape.columns_between(df, "name", "z") == ["name", "sp2", "z"]
    assert reshape.prefix_last(df, "sp").columns == ["name", "z", "sp1", "sp2"]
