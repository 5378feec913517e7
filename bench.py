"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from haulspark.plans.registry import QUERIES  # noqa: E402

HEADLINE = [
    "cockpit_kpis", "punctuality", "cost_model", "asof_tariff", "asof_with_class", "bracket_rate", "zone_pip", "tpo_pricing", "report_totals", "distinct_runs", "left_join_dims",
    "lateral_latest", "schedule_walk", "run_lengths", "trail_length", "exceptions_batch", "field_extract", "validate_route", "fuzzy_best_margin", "driving_rules", "packer",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{folder}/shared").config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {name: QUERIES[name] for name in HEADLINE}
    try:
        from haulspark.llm.queries import QUERIES as LLM
    except ImportError:
        LLM = {}
    queries |= LLM
    run = lambda f: f(spark, sf_dir).write.format("noop").mode("overwrite").save()
    run(queries["cockpit_kpis"])  # starts the session's code
    seconds = {}
    for name, f in queries.items():
        began = time.perf_counter()
        run(f)
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir}))


if __name__ == "__main__":
    main()
