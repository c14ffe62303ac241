"""Time the headline queries and print one JSON line."""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "redaction_by_language", "tokens_per_document", "pattern_spans_pages", "rare_term_labels", "cross_split_dedup",
    "stratified_split", "split_stats", "redacted_text", "token_metrics", "exact_span_scores", "pair_summary",
    "threshold_sweep", "operating_points", "temporal_eval", "absolute_ci",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("maskwright-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "20g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from workloads import QUERIES

    only = sys.argv[1:] or HEADLINE
    QUERIES["redaction_by_language"](spark, folder.replace("sf0.1", "sf0.001")).collect()  # warm the JVM
    times = {}
    for name in only:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    documents = spark.read.parquet(f"{folder}/documents.parquet").count()
    notes = spark.read.parquet(f"{folder}/orders.parquet").count()
    out = {
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
        "rule_labelled_documents_per_second": round(documents / times["redaction_by_language"], 1) if "redaction_by_language" in times else None,
        "rule_labelled_sentences_per_second": round(notes / times["redacted_text"], 1) if "redacted_text" in times else None,
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
