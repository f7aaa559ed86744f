"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

The derived corpus is written once before the clock starts (its time is reported
as ``corpus_sec``); every query then runs twice into a no-op sink and the faster
run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sourceassay.plans import demo_corpus  # noqa: E402
from sourceassay.plans.queries import QUERIES  # noqa: E402
from sourceassay.session import local_session  # noqa: E402

HEADLINE = (
    "audit_index_by_language", "agg_1_scan_summary", "win_1_cap_files", "str_1_strip_comments",
    "ext_1_line_calls", "ext_7_arithmetic_ops", "ext_8_functions", "ext_13_nested_record",
    "joi_2_reentrancy", "rul_05_web2_double_spend_race", "rul_all", "sig_2_broken_auth",
    "sig_16_web3_broken_access_control", "agg_8_violation_counts", "win_2_finding_numbers",
    "joi_3_report", "joi_5_diff_snapshots", "joi_11_splice", "agg_12_owner_rollup", "snk_1_report_json",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    started = time.perf_counter()
    demo_corpus.source_files(spark, sf_dir)
    corpus_sec = time.perf_counter() - started
    seconds = {}
    for name in wanted:
        runs = []
        for _ in range(2):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        seconds[name] = round(min(runs), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus),
        "corpus_sec": round(corpus_sec, 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
