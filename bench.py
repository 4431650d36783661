"""Headline queries, timed: one JSON line with the seconds per query (median of the timed runs) and their sum."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from acceptance import load_all
from acceptance.catalog import CATALOG
from hawkspan.session import local_session

HEADLINE = (
    "det_101_beaconing_no_allowlist", "det_102_long_connections", "det_103_rare_tls_fingerprint", "det_104_suspicious_certificate", "det_105_dns_tunneling",
    "det_106_nxdomain_spike", "det_107_exfiltration", "det_108_nonstandard_port", "det_109_scanning", "rep_q09_top_inbound_sources", "rep_q23_alert_sources",
    "rep_q28_most_regular_pairs", "rep_q38_top_domains", "rep_q48_false_positive_rates", "rep_q57_sources_with_sensor_visits", "rep_q66_attack_paths",
    "geo_enrich", "norm_zeek", "trigger_honeypot",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in (sys.argv[1:] or HEADLINE)]
    load_all()
    spark = local_session(cpus)
    seconds = {}
    for name in names:
        if name not in CATALOG:
            continue
        timings = []
        for attempt in range(runs + 1):  # the first run warms up and is not counted
            began = time.perf_counter()
            CATALOG[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:
                timings.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(timings), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
