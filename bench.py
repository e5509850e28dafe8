"""Times the headline queries: one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from tidewright.plans import catalog

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "pricing_summary", "mutate_by", "grouped_mutate", "grouped_filter", "summarize_statistics", "summarize_positions", "ranks", "shifts", "running_values", "runs", "fill_down", "distinct_keep_all",
    "slice_min_grouped", "join_inner", "join_left", "join_full", "join_semi", "join_rolling", "join_inequality", "longer", "wider", "rollup_counts", "table_margins", "box_plot", "histogram", "lm_simple",
    "glm_poisson", "kruskal", "spearman",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checkpoint-")).config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF_DIR}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    names = sys.argv[1:] or HEADLINE
    took = {}
    for name in names:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
