"""Traffic overview: volume, direction, ports, services and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hawkspan.functions.times import instant, newest_day, unit_boundaries
from hawkspan.operators.samples import any_text, share, smallest_distinct
from hawkspan.plans.common import distinct_total, excluding, lab, per_step, production_alerts, top, total, within


def direction() -> Column:
    return F.when(F.col("local_orig") & F.col("local_resp"), "internal").when(F.col("local_orig"), "outbound").otherwise("inbound")


def _inbound(t, span) -> DataFrame:
    rows = within(t["conn"], span).where(~F.col("local_orig") & F.col("local_resp"))
    return excluding(rows, "id_orig_h", lab(t, "sensor"))


def connection_count(t, span):
    return total(within(t["conn"], span), "connections")


def inbound_sources(t, span):
    return distinct_total(_inbound(t, span), "id_orig_h", "sources")


def alert_count(t, span):
    return total(production_alerts(t, span), "alerts")


def drop_rate(t, span):
    newest = within(t["stats"], span, "timestamp").agg(F.max_by(F.struct("stats_capture_kernel_drops", "stats_capture_kernel_packets"), "timestamp").alias("s"))
    return newest.select(share(F.col("s.stats_capture_kernel_drops"), F.col("s.stats_capture_kernel_packets")).alias("drop_rate"))


def ingestion_lag(t, as_of):
    return newest_day(t["conn"]).agg(unit_boundaries("second", F.max("ts"), instant(as_of)).alias("lag"))


def connections_by_direction(t, span, step):
    return per_step(within(t["conn"], span), "ts", step, direction().alias("direction")).agg(F.count("*").alias("connections")).orderBy("time", "direction")


def bytes_by_direction(t, span, step):
    moved = F.sum(F.col("orig_ip_bytes") + F.col("resp_ip_bytes")).alias("bytes")
    return per_step(within(t["conn"], span), "ts", step, direction().alias("direction")).agg(moved).orderBy("time", "direction")


def top_inbound_ports(t, span, k=10):
    groups = _inbound(t, span).groupBy(F.col("id_resp_p").alias("port"), F.col("proto").alias("protocol")).agg(
        any_text(F.col("service")).alias("detected_service"), F.count("*").alias("connections"), F.countDistinct("id_orig_h").alias("sources")
    )
    return top(groups, k, F.desc("connections"), "port", "protocol")


def top_inbound_sources(t, span, k=10, sample=5):
    rows = _inbound(t, span).select(F.col("id_orig_h").alias("source"), F.col("id_resp_p").alias("port"))
    busiest = top(rows.groupBy("source").agg(F.count("*").alias("connections"), F.countDistinct("port").alias("ports")), k, F.desc("connections"), "source")
    # k rows at most: safe to broadcast.
    ports = smallest_distinct(rows.join(F.broadcast(busiest.select("source")), "source", "left_semi"), ["source"], F.col("port"), sample, "sample_ports")
    return busiest.join(ports, "source").withColumn("sample_ports", F.array_join("sample_ports", ",")).orderBy(F.desc("connections"), "source")


def services_seen(t, span, k=12):
    detected = F.when(F.col("service") == "", "(not identified)").otherwise(F.col("service")).alias("detected")
    return top(within(t["conn"], span).groupBy(detected).agg(F.count("*").alias("connections")), k, F.desc("connections"), "detected")


def alerts_by_severity(t, span, step):
    level = F.concat(F.lit("severity "), F.col("alert_severity").cast("string")).alias("level")
    return per_step(production_alerts(t, span), "timestamp", step, level).agg(F.count("*").alias("alerts")).orderBy("time", "level")


def freshness(t, as_of, iface="ens4"):
    """Newest row per source and how far it lies behind."""
    newest = [
        ("zeek_conn", t["conn"], "ts"), ("suricata_alert", t["alert"].where(F.col("in_iface") == iface), "timestamp"), ("suricata_stats", t["stats"], "timestamp"),
        ("cowrie_events (honeypot)", t["cowrie"], "timestamp"), ("detection_runs", t["runs"].where(~F.col("backfill")), "run_at"),
        ("vector_internal_metrics", t["metrics"], "timestamp"),
    ]
    out = None
    for name, rows, ts in newest:
        row = newest_day(rows).agg(F.max(ts).alias("latest")).select(F.lit(name).alias("source"), "latest")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("lag_s", unit_boundaries("second", F.col("latest"), instant(as_of))).orderBy(F.desc("lag_s"), "source")


def top_dns_queries(t, span, k=10):
    groups = within(t["dns"], span).groupBy(F.col("query").alias("name")).agg(F.count("*").alias("queries"), F.countDistinct("id_orig_h").alias("clients"))
    return top(groups, k, F.desc("queries"), "name")


def top_server_names(t, span, k=10):
    groups = within(t["ssl"], span).where(F.col("server_name") != "").groupBy(F.col("server_name").alias("sni")).agg(
        F.count("*").alias("sessions"), F.countDistinct("id_resp_h").alias("servers")
    )
    return top(groups, k, F.desc("sessions"), "sni")


def sensor_addresses(t):
    """Own addresses offered as the value to exclude."""
    return lab(t, "sensor")
