"""Prints one JSON line with the seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: the second run of each, and the first."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tessella.operators import knn
    from tessella.plans import catalog, workflows
    from tessella.sources import tables

    raw, sig = catalog.raw, tables.block_signatures
    queries = {
        "filter_transcripts": catalog.QUERIES["filter_transcripts"],
        "hilbert_order": catalog.QUERIES["hilbert_order"],
        "bcc_design": catalog.QUERIES["bcc_design"],
        "bcc_edges": catalog.QUERIES["bcc_edges"],
        "knn_radius_1": lambda s, d: knn.knn_edges(catalog.points(s, d), 10, 1.0),
        "crf_radius_1": lambda s, d: workflows.run_crf(raw(s, d), sig(s), dist_threshold=1.0, tol=0.0, max_iter=3).labels,
        "field_predict_bcc": catalog.QUERIES["field_predict_bcc"],
        "signature_update": catalog.QUERIES["signature_update"],
    }
    queries["filter_transcripts"](spark, sf_dir).count()  # starts the workers
    first, seconds = {}, {}
    for name, f in queries.items():
        for found in (first, seconds):  # the first run also compiles and starts things
            began = time.time()
            f(spark, sf_dir).write.format("noop").mode("overwrite").save()
            found[name] = round(time.time() - began, 3)
        print(name, first[name], seconds[name], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "first_runs": first, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
