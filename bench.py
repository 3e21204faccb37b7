"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import importlib
import json
import os
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
# workers import the package too, wherever the bench is started
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)
from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    "flagship_directory ag05_quality_metrics ag08_coverage ag10_positive_rank ag11_claim_rollup ag21_inverted_index j10_undirected_edges j16_shared_identifiers j23_fuzzy f04_fingerprints f07_canonical_url w03_keeper_by_url w05_duplicate_components gr01_pointer_chase "
    "r04_reputation r06_category_tags so06_positive_order so10_page dq10_report sk09_upsert str2_task_states ag21_search_index r18_search_batch op1_dart_near_dedup op2_html_main_text op3_media_columns op4_attention_lm op5_licence_notices op6_warc_archives op7_mixture op8_byte_cnn_quality op9_prefix_bpe op10_exact_top_k pipeline"
).split()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = importlib.import_module("__spark_entry__").queries()
    run = lambda name: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("flagship_directory")  # the JVM's first query compiles and loads classes
    took: dict[str, float] = {}
    for name in HEADLINE:
        if name in queries:
            begin = time.perf_counter()
            run(name)
            took[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(Path(sf_dir).name.removeprefix("sf") or 0) if Path(sf_dir).name.startswith("sf") else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
