"""Headline timings: one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores. Each
query's time is the median of three runs; `clean_and_store` is the one-off step
from raw tables to the stored catches and dimension tables that the other queries read.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from fieldtally.config import SESSION_CONF  # noqa: E402
from fieldtally.plans import queries  # noqa: E402
from fieldtally.plans.survey import survey_of_tables  # noqa: E402

HEADLINE = [
    "effort_standardised", "alpha_shannon", "catch_full", "tbi_abundance", "tbi_perm_p", "species_change", "species_table",
    "coverage_matrix", "corr_pearson", "corr_spearman", "ols_categorical", "pca_scores", "ca_row_coords", "boxplot",
    "count_quantiles", "draw_qi", "draw_hypothesis", "bootstrap_draws", "model_weights",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]")
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = (
        builder
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    start = time.time()
    stored = survey_of_tables(spark, folder)
    for table in (stored.catch_info, stored.refuge_info, stored.occasion_info, stored.species_info):
        run(table)
    times["clean_and_store"] = round(time.time() - start, 3)

    for name in HEADLINE:
        taken = []
        for _ in range(3):
            # the fact table stays stored; tables derived from it are built anew
            shared = survey_of_tables(spark, folder)
            for derived in ("catch_full", "turnover", "diversity_frame", "turnover_model_frame", "species_changes"):
                shared.__dict__.pop(derived, None)
            start = time.time()
            run(queries.QUERIES[name](spark, folder))
            taken.append(time.time() - start)
        times[name] = round(sorted(taken)[1], 3)
    print(
        json.dumps(
            {
                "metric": "survey_headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
