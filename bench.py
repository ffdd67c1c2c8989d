"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line of seconds.

Each query is run once to compile and read, then timed writing its whole result to a sink that
keeps nothing.
"""

from __future__ import annotations

import json
import os
import time

from jobscope.plans import registered
from jobscope.session import build_session

HEADLINE = [
    "list_default",
    "list_keyword",
    "list_total",
    "detail_sources",
    "orders_ranked_topk",
    "normalize_pages",
    "content_hash_docs",
    "classify_postings",
    "skills_extract",
    "sponsorship_postings",
    "registry_flags_rollup",
    "lca_employers",
    "simhash_docs",
    "neardup_pairs",
    "canonical_map",
    "upsert_merge",
    "closed_sweep",
    "misses_streak",
    "health_fold",
    "budget_admission",
    "fit_scores",
    "rationale_lines",
    "saved_search_matches",
    "digest_lines",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            registered.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
