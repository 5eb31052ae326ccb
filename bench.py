"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local cores.
Every query is run to its last row into Spark's noop sink. ``index_build`` is
the splitting and indexing of all documents, which the searches then share.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from workload.data import found, prepared
from workload.queries import registered

HEADLINE = (
    "normalize_text", "tokenize_stem", "passages_lines", "passages_sentences", "passage_windows",
    "index_build", "passage_windows_gaps", "bm25_postings", "bm25_topk", "hash_embed",
    "dense_topk_hash", "dense_topk_vectors", "retrieval", "hybrid_fusion", "rerank_pairs",
    "evidence_bundle", "retrieval_metrics", "failure_types", "sweep_summary", "run_summary",
    "final_response", "gold_references", "json_validate", "json_resolve",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    steps = {"index_build": prepared, "retrieval": lambda s, f: found(s, f, with_pairs=True)}
    queries = registered()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        if name in steps:
            steps[name](spark, folder)
        else:
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
