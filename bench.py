"""Wall time of the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from newsmart.plans import load_all
from newsmart.plans.registry import forget_shared
from newsmart.session import local_session

HEADLINES = [
    "balanced_feed", "category_summaries", "country_counts_today", "queue_status", "queue_priorities", "source_health", "title_fingerprints",
    "canonical_urls", "archive_append", "reading_list", "pair_similarity", "candidate_partner_counts", "article_components", "event_clusters",
    "edition_decisions", "article_editions", "search_plain", "retrieval_metrics", "entity_resolution", "event_entities", "observed_signals",
    "market_affinity", "year_statistics", "duplicate_candidates",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, memory=os.environ.get("BENCH_MEMORY", "16g"), partitions=int(cpus))
    registry = load_all()
    registry["balanced_feed"](spark, folder).count()  # start the executors before the clock
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINES:
        forget_shared()  # every query pays for its own intermediates
        start = time.perf_counter()
        registry[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
