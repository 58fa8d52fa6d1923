"""Time the registered queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# What the line's value sums up: one query per job and operator family.
HEADLINE = (
    "doc_assemble", "chunk_fixed", "request_payload", "reply_clean_json", "record_validate", "reply_parse",
    "token_usage", "extract_records", "valid_split", "corrections_overlay", "merge_candidates", "changed_keys",
    "vector_refresh", "table_delete", "load_records", "index_documents", "embed_hash", "knn_top2", "knn_tiles",
    "knn_per_candidate", "knn_lsh", "answer_concat", "answer_questions", "doc_link", "doc_put", "chat_replay",
    "stream_intake",
)


def session(cpus: str):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vitaeflow-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from vitaeflow.plans.registered import REGISTERED

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus)
    # start the JVM's code paths and the Python workers before timing
    REGISTERED["doc_nonblank"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    REGISTERED["knn_top2"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        REGISTERED[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {"metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
            "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
