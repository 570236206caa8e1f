"""Times the headline queries, the median of three warm runs each, beside a control query, and prints one JSON line."""

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from lanewise import catalog

HEADLINE = [
    "ranking_best_times", "current_club", "historical_clubs", "club_attendance_matrix", "competition_stats", "competition_detail_flat", "club_participation",
    "club_medal_table", "personal_bests", "best_match_window", "asof_team_line", "idempotent_insert_antijoin", "validation_unmatched_counts", "band_birth_year_pairs",
    "club_cooccurrence", "html_links", "line_context_fold",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    scratch = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", scratch)
        .config("spark.checkpoint.dir", f"file://{scratch}/checkpoint").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(query) -> float:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        return round(statistics.median(runs[1:]), 3)

    # a query that never changes, before and after the others, tells the machine's share of a difference between rounds
    control = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_partkey", "l_suppkey").count()
    controls = [timed(control)]
    took = {name: timed(catalog.QUERIES[name]) for name in HEADLINE}
    controls.append(timed(control))
    print(json.dumps({"metric": "headline queries, median of 3 warm runs, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "control": controls, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
