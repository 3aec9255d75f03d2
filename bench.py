"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table directory, BENCH_CPUS the number of local threads.  Every query is
written to the no-op sink, so all of its rows and columns are computed; the reported time of a
query is the better of two runs, after one warm-up of the session.
"""

from __future__ import annotations

import json
import os
import time

from posttrain_spark.plans import load_all
from posttrain_spark.plans.registry import QUERIES
from posttrain_spark.session import build_session

HEADLINES = (
    "score_multi", "score_unified", "advantages", "constraint_rates", "verifier_diff",
    "check_length_constraints_number_words", "check_keywords_frequency",
    "check_language_response_language", "render_chat", "loss_mask", "turn_stats",
    "filter_long_prompts", "shuffle", "split_train", "pack_wrapped", "pack_bfd", "batch_plan",
    "sft_dataset", "gsm8k", "math", "code_block", "comparison", "loose", "stream_score",
)


def timed(build, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            # Each given table is one row group, which Spark cannot split.
            "posttrain.input.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    timed(QUERIES["token_count"], spark, sf_dir)
    seconds = {}
    for name in HEADLINES:
        seconds[name] = round(min(timed(QUERIES[name], spark, sf_dir) for _ in range(2)), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
