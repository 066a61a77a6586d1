"""Times the headline queries and prints one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]. Every query runs
whole and writes to a sink that discards the rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = """
ngram_overlap licensed_overlap mine_corpus closure_ledger strong_heads dedupe_lines line_citations
inverted_index posting_deltas index_search ranked_search anchor_resolve invisible_chars markup_clean
prose_lines fk_violations table_diff ordered_distinct_join latest_per_key pointer_chain band_join
run_islands cell_stride_sample stride_sample table_fingerprint snapshot_drift receipt_audit
definition_list capture_ingest
""".split()


def main() -> None:
    from spanledger.plans import catalog
    from spanledger.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    spark.read.parquet(f"{sf}/nation.parquet").count()
    took = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
