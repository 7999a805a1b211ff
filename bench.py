"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Every query runs twice, its result going to a sink that reads all rows; the
second run counts, as the first also compiles code and starts Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

HEADLINE = (
    "cosine_score_all", "knn_top5", "knn_filter_label", "knn_int8", "knn_batch_100", "knn_autocut", "autocut_scores", "filter_and_or_exclude", "filter_ts_range_list", "presence_index",
    "delete_anti", "compact_row_numbers", "shard_first_fit_refill", "store_search", "rerank_combine", "text_hash_scores", "fuzzy_ratio", "hybrid_search", "embed_documents",
)


def batch_of_100(spark, sf_dir):
    """The five nearest rows of each of 100 query vectors, as in the rounds before."""
    from vexel.operators.search import batch_top_k

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return batch_top_k(rows, rows.where("vec_id < 100").withColumnRenamed("vec_id", "qid"), 5)


def main() -> None:
    root = str(Path(__file__).resolve().parent)
    sys.path.insert(0, root)
    os.environ["PYTHONPATH"] = f"{root}:{os.environ.get('PYTHONPATH', '')}"
    from vexel.plans import catalog
    from vexel.session import session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus), spark_driver_memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalog.queries() | {"knn_batch_100": batch_of_100}, {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    scale = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale}))


if __name__ == "__main__":
    main()
