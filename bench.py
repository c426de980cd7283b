"""Times the headline queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS set the input and cores."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
NAMES = ["deals", "reference_price", "reference_price_v9", "latest_per_store", "daily_series", "price_patterns", "opportunity_score", "match_cascade", "duplicate_groups", "nn_join", "state_sync", "normalize_text"]


def main() -> None:
    from pyspark.sql import SparkSession

    from dealforge.plans.registry import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    home = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.local.dir", home).config("spark.sql.warehouse.dir", f"{home}/warehouse").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in NAMES:
        runs = []
        for _ in range(2):
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        times[name] = round(min(runs), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
