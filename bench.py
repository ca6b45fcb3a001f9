"""Time the headline queries end to end and print one JSON line.

Every query starts from the raw tables, so the star derivation is part of its time.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from geoaffinity.catalog.queries import QUERIES
from geoaffinity.settings import SESSION_SETTINGS

HEADLINE = (
    "order_cells_region",
    "view_cells_region",
    "align_region",
    "align_country",
    "feature_summary",
    "compare_region_vs_all_rev",
    "compare_dma_vs_region_cr",
    "compare_sku_labels",
    "welch_all_regions_rev",
    "rank_regions_rev",
    "rank_dmas_cr",
    "country_fact_rev",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("geoaffinity-bench")
    settings = {
        **SESSION_SETTINGS,
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/nation.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
