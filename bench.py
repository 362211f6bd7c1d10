"""Run the headline queries and print one JSON line with their times.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores). Every query
computes its whole result into a sink that discards it, BENCH_RUNS times (2);
the shorter time counts, as the first run also compiles the plan.
"""

from __future__ import annotations

import json
import os
import time

from loomset.catalog.queries import QUERIES
from loomset.session import build_session

HEADLINE = (
    "prepared_documents",
    "prepared_turns",
    "prepared_files",
    "dialogue_expand",
    "dialogue_expand_nested",
    "chatml_pair",
    "detect_format",
    "to_pair",
    "quality_report",
    "dedup_prefix",
    "split_exact",
    "read_jsonl",
    "read_csv",
    "read_txt",
    "loss_summary",
    "early_stop",
    "poly_fit",
    "rouge_n",
    "rouge_l",
    "bertscore",
    "eval_loss",
    "token_columns",
    "padded_batches",
    "speeds",
    "resource_summary",
    "memory_analysis",
    "sessions",
    "stream_resources",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "2"))):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
