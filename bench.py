"""Headline queries at one scale; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores,
``BENCH_QUERIES`` a comma-separated subset. A query is timed from plan
construction to the last row, the better of two runs after the session is warm.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from guardlake.plans.registered import QUERIES  # noqa: E402
from guardlake.session import build_session  # noqa: E402

HEADLINE = [
    "ablation_leak_rate", "ablation_wide", "leak_reversed", "redact_email", "extract_entities", "policy_hits",
    "exemplar_similarity", "prf1", "metrics_text", "corpus_attack", "corpus_split", "diverse_exact", "diverse_coreset",
    "turn_guard", "guard_status", "history_last10", "progression", "sql_guarded", "sql_audit", "inventory_columns",
    "text_profile", "log_parse", "stream_guard",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["redact_email"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
