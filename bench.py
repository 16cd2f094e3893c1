"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores.  Every query runs
once to warm the JVM on the smallest tables, then once, from the parquet files
to its last row, with nothing shared between queries.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from workload import queries as Q
from workload.session import ensure_folder

HEADLINES = [
    "gate_report", "corpus_distinct_kmers", "minhash_sketch", "admission_final", "candidate_pairs",
    "novelty_promoted", "novelty_undivided", "emit_promoted",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_folder(spark)
    warm = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        Q.QUERIES["novelty_promoted"](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINES:
        Q.forget()
        start = time.time()
        Q.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    Q.forget()
    size = Q.quality(spark, sf).selectExpr("count(*) AS n", "sum(len) AS bases").first()
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf.rstrip("/")),
        "records": size["n"],
        "bases": size["bases"],
        "records_per_sec": round(size["n"] / times["novelty_promoted"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
