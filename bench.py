"""Benchmark: headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS].

The inputs are first written as many-file tables (the supplied tables have one row
group, which one task would read), with the derived postings and answers written
once, so that a job's time is its operator's time.  Each job runs to completion
through a ``noop`` sink (every row is produced, nothing is collected to the
driver): one warm-up pass, then the median of $BENCH_REPEAT timed passes.  Prints
ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "p6_scrape_batch",          # page facts on the supplied pages (flagship)
    "p6_scrape_batch_ext",      # page facts on derived pages (all link / image / type branches)
    "l8_classify_links",        # link classification, one row per link
    "e1_e2_documents",          # education + tags over whole documents
    "e1_detect_education",      # education over posting content
    "v3_prepare_publish",       # publish preparation over all postings
    "v4_enrich_batch",          # response parsing + enrichment + link merge
    "r4_quick_info_rows",       # unpivoted display table
    "s3_read_responses",        # parse + repair of model answers
]
FILES = 64


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    names = sys.argv[1:] or ["b2_postings_raw", *HEADLINE]
    from gazette.plans.fixtures import prepare
    from gazette.plans.registry import load_all
    from gazette.session import TABLES, get_spark
    spark = get_spark(f"local[{cpus}]", int(cpus) * 2, app="gazette-bench")
    spark.sparkContext.setLogLevel("ERROR")
    qs = {name: fn for name, (fn, _) in load_all().items()}
    work = tempfile.mkdtemp(prefix="gazette-bench-")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").repartition(FILES).write.parquet(f"{work}/{t}.parquet")

    def run(name: str) -> float:
        t0 = time.perf_counter()
        qs[name](spark, work).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    times = {}
    for name in sorted(names, key=lambda n: n != "b2_postings_raw"):
        if name != "b2_postings_raw" and not os.path.exists(f"{work}/derived"):
            prepare(spark, work, f"{work}/derived", FILES)
        run(name)  # warm-up
        times[name] = round(statistics.median(run(name) for _ in range(repeat)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
