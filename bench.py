"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR: folder of the tables; BENCH_CPUS: cores; BENCH_QUERIES: names, comma-separated.
BENCH_WARM_DIR: tables on which every query runs once before the clock, so that its code is compiled
(the smallest ones next to BENCH_SF_DIR). Every query runs whole and its rows go to a sink that drops
them. DuckDB's time for the SQL of the same query is given next to it.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from contactline.plans.oracles import ORACLES  # noqa: E402
from contactline.plans.queries import REGISTERED  # noqa: E402
from contactline.runtime import local_session  # noqa: E402

HEADLINE = (
    "url_parts,pick_website,page_emails_raw,deobfuscate,judge_emails,page_report,site_contacts,"
    "complete_pages,page_links,page_addresses,candidates,replay_crawl,replay_contacts,enriched,"
    "enriched_from_pages,incremental_enrich"
)


def seconds(fn) -> float:
    start = time.perf_counter()
    fn()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", HEADLINE).split(",")
    spark = local_session(cpus, 8)
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor before the clock

    def run(name, folder=sf_dir):
        REGISTERED[name](spark, folder).write.format("noop").mode("overwrite").save()

    beside = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm_dir = os.environ.get("BENCH_WARM_DIR", beside)
    times = {}
    for name in names:
        if os.path.isdir(warm_dir):
            run(name, warm_dir)
        times[name] = seconds(lambda: run(name))
    line = {
        "metric": "total seconds of headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus,
    }
    try:
        from compare import connect

        con = connect(sf_dir)
        line["duckdb"] = {
            n: seconds(lambda: con.execute(ORACLES[n]).fetchall()) for n in names if n in ORACLES
        }
    except ImportError:
        pass
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
