"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from speechmill.plans.catalog import all_queries
from speechmill.session import local_session

HEADLINE = [
    "party_topic_scores",
    "topic_rollup",
    "sentiment_by_party",
    "policy_reasons",
    "area_terms",
    "speaking_patterns",
    "tfidf_keywords",
    "tfidf_by_party",
    "distinctive_terms",
    "qa_pairs",
    "session_sample",
    "page_speeches",
    "text_chunks",
    "session_digests",
    "document_positions",
    "nearest_to_labels",
]


def timed(spark, query, sf):
    start = time.perf_counter()
    query(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main(names):
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries = all_queries()
    names = names or HEADLINE
    seconds = {name: float("inf") for name in names}
    # The first round pays for class loading, code generation and just-in-time compilation.
    for _ in range(3):
        for name in names:
            seconds[name] = min(seconds[name], round(timed(spark, queries[name], sf), 3))
    spark.stop()
    print(json.dumps({"metric": "total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main(sys.argv[1:])
