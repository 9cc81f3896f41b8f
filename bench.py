"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from folioframe.plans import registry

HEADLINE = [
    "parish_rollup", "page_table_stats", "layout_labels", "opening_type", "ditto_resolve", "grid_densify", "overlap_dedup", "iou_match",
    "merge_pairs", "similarity_neighbors", "cer_by_class", "html_scan", "row_batches", "semi_anti_files",
]
#: Newer queries; they are timed beside the others, whose total can so be compared from round to round.
MORE = ["book_statistics", "standardized_rows", "extraction_evaluation", "merge_table_cells", "page_expectations"]
RUNS = 3


def timed(run) -> list[float]:
    """Seconds of each run, sorted; the first one compiles."""
    took = []
    for _ in range(RUNS):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    return sorted(took)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # the same work in every round, of no query of ours: what it takes is the machine's
    machine = timed(lambda: spark.range(40_000_000).selectExpr("sum(hash(id, id + 1))").collect())
    runs = {name: timed(lambda name=name: registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()) for name in HEADLINE + MORE}
    spark.stop()
    took = {name: round(median(r), 3) for name, r in runs.items()}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(took[n] for n in HEADLINE), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "calibration": round(median(machine), 3), "spread": {name: [round(r[0], 3), round(r[-1], 3)] for name, r in runs.items()},
    }))


if __name__ == "__main__":
    main()
