"""Plan shape, and a sample of registered queries against their SQL."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from fieldtally.config import SurveyConfig
from fieldtally.operators import diversity, effort, turnover
from fieldtally.plans.survey import survey_of_tables
from tools.check_oracles import as_rows

SAMPLE = [
    "dim_species", "quality_duplicates", "effort_totals_tagged", "alpha_shannon", "alpha_by_month_wide", "tbi_abundance",
    "tbi_perm_p", "species_table", "top_species", "coverage_matrix", "boxplot", "corr_spearman", "ca_inertia", "draw_qi",
    "effect_sizes", "glm_offset", "bootstrap_moments", "model_weights", "crossed_spread",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contract(spark):
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries)
    assert contract.entry(spark).count() > 0


def test_core_operators_stay_in_the_engine(spark, sf_dir):
    s = survey_of_tables(spark, sf_dir)
    config = SurveyConfig(complete_years=6)
    catch = s.catch_info
    for df in (
        effort.effort_totals(catch, config),
        diversity.alpha_diversity(effort.effort_totals(catch, config, standard=False), transform="log1p"),
        effort.catch_by_season(catch, s.occasion_covariates, config),
        turnover.turnover(s.catch_full, config),
    ):
        text = plan(df)
        assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_scan_reads_only_needed_columns(spark, sf_dir):
    text = plan(effort.max_replicates(survey_of_tables(spark, sf_dir).catch_info))
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert scans and all("total_weight" not in line and "species" not in line.split("ReadSchema")[1] for line in scans)
    assert all("EqualTo(gear,GN)" in line for line in scans)


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, sf_dir, db, name):
    df = contract.queries()[name](spark, sf_dir)
    cursor = db.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert as_rows(df.columns, df.collect()) == as_rows(columns, cursor.fetchall())


def test_unshared_folder_is_refused_off_local(spark, monkeypatch):
    """Without a named folder, a cluster must not fall back to one machine's disk."""
    import pytest

    from fieldtally.operators import lineage

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.shared_folder(Session())


def test_records_are_joined_once_and_kept_narrow(spark, sf_dir, monkeypatch):
    """Tables of the analysis scan stored narrow records: no join of large tables again, no wide fact table written."""
    from fieldtally import adapters
    from fieldtally.operators import cleaning, lineage
    from fieldtally.plans import survey as plans

    written = []

    def noted(df):
        written.append(df.columns)
        return lineage.cut(df)

    for module in (adapters, cleaning, plans):
        monkeypatch.setattr(module, "cut", noted)
    s = survey_of_tables(spark, sf_dir, fresh=True)
    assert not any("lineitem.parquet" in f or "orders.parquet" in f for f in s.raw.inputFiles())
    assert s.catch_info.count() == s.clean.count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    records = [c for c in written if "l_orderkey" in c or "sampling" in c]
    assert records and max(map(len, records)) < 20


def test_wide_rows_run_compiled_unless_the_caller_chose(spark, sf_dir):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        contract.queries()["clean_survey"](spark, sf_dir)
        assert spark.conf.get(key) == "8000"
        spark.conf.set(key, "20000")
        contract.queries()["clean_survey"](spark, sf_dir)
        assert spark.conf.get(key) == "20000"
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("stored", [True, False])
def test_clean_table_is_the_same_stored_or_not(spark, sf_dir, stored):
    from fieldtally.plans.survey import TABLES_CONFIG, Survey

    held = survey_of_tables(spark, sf_dir)
    other = Survey(held.raw, TABLES_CONFIG, stored=stored)
    for table in ("catch_info", "occasion_info", "refuge_info"):
        want, got = getattr(held, table), getattr(other, table)
        assert want.columns == got.columns
        assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()


def test_dimensions_and_totals_read_summed_records(spark, sf_dir):
    """One pass over the records, not one for each table; the same tables as from the records themselves."""
    from fieldtally.plans.survey import TABLES_CONFIG, Survey

    summed = survey_of_tables(spark, sf_dir, fresh=True)
    plain = Survey(summed.raw, TABLES_CONFIG, stored=True)
    for table in ("refuge_info", "occasion_info", "sampling_info", "casting_info", "species_info", "catch_full", "diversity"):
        want, got = getattr(plain, table), getattr(summed, table)
        assert want.dtypes == got.dtypes
        if table == "diversity":
            want, got = (t.withColumn("diversity_alpha", F.round("diversity_alpha", 9)) for t in (want, got))
        assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty(), table
    assert not {"catch_info", "clean"} & set(vars(summed))
    keys = ["refuge", "occasion", "replicate", "gear"]
    records, sums = plain.catch_info, summed.catch_sums
    assert sums.agg(F.sum("total_weight")).first() == records.agg(F.sum("total_weight")).first()
    assert sums.select(*keys).distinct().count() == records.select(*keys).distinct().count()


def test_diversity_is_worked_out_once_for_all_models(spark, sf_dir):
    """Fits read their frame several times: neither the catches nor the totals are aggregated again each time."""
    s = survey_of_tables(spark, sf_dir)
    for table in (s.diversity, s.diversity_by_month):
        text = plan(table)
        assert "Exchange" not in text and "Aggregate" not in text


def test_catches_read_once_are_not_written_first(spark, sf_dir, monkeypatch):
    from fieldtally.plans import queries

    s = survey_of_tables(spark, sf_dir, fresh=True)
    monkeypatch.setattr(queries, "survey_of_tables", lambda *_: s)
    once = queries.QUERIES["fact_catch"](spark, sf_dir)
    assert "catch_info" not in vars(s)
    again = queries.rounded(s.catch_info)
    assert once.dtypes == again.dtypes
    assert once.exceptAll(again).isEmpty() and again.exceptAll(once).isEmpty()
    assert s.catch_rows is s.catch_info
