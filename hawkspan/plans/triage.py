"""Alert and finding triage: what is new, what nobody has judged, and what was done about it."""

from __future__ import annotations

from pyspark.sql import functions as F

from hawkspan.operators.counters import counter_steps
from hawkspan.operators.samples import any_text
from hawkspan.plans.common import excluding, latest_run, latest_verdicts, pair_of_alert, per_step, production_alerts, top, total, within

C2_DETECTIONS = ("DET-101", "DET-102", "DET-103", "DET-104", "DET-107", "DET-108")
DNS_DETECTIONS = ("DET-105", "DET-106")


def _reviewed(t, source):
    return t["verdicts"].where(F.col("source") == source).select(F.col("subject").alias("address")).distinct()


def severe_count(t, span):
    return production_alerts(t, span).agg(F.count_if(F.col("alert_severity") == 1).alias("severe"))


def unreviewed_pairs(t, span):
    pairs = production_alerts(t, span).where(F.col("alert_severity") == 1).select(pair_of_alert().alias("pair")).distinct()
    return total(excluding(pairs, "pair", _reviewed(t, "suricata")), "unreviewed")


def findings_now(t, detections=()):
    """Findings of the newest scheduled run, optionally of some detections only."""
    rows = t["hits"].where(F.col("run_at") == latest_run(t))
    return total(rows.where(F.col("detection_id").isin(*detections)) if detections else rows, "findings")


def automatic_blocks(t, span):
    rows = within(t["actions"], span, "created_at").where((F.col("mode") == "enforce") & (F.col("action") == "block") & (F.col("trigger") != "manual"))
    return total(rows, "blocks")


def suppressed_by_tuning(t, span):
    rows = within(t["stats"], span, "timestamp")
    counter = F.col("stats_detect_alerts_suppressed")
    return rows.agg((F.max_by(counter, "timestamp") - F.min_by(counter, "timestamp")).alias("suppressed"))


def suppressed_per_day(t, span):
    """The same counter day by day, right across engine restarts."""
    steps = counter_steps(within(t["stats"], span, "timestamp"), [], "timestamp", "stats_detect_alerts_suppressed", "stats_uptime")
    return steps.groupBy(F.to_date("timestamp").cast("string").alias("day")).agg(F.coalesce(F.sum("increase"), F.lit(0)).alias("suppressed")).orderBy("day")


def new_findings(t, span, step):
    """Findings by the run that reported them first."""
    first = t["hits"].groupBy("hit_key").agg(F.min("detection_id").alias("detection"), F.min("run_at").alias("first_reported"))
    return per_step(within(first, span, "first_reported"), "first_reported", step, "detection").agg(F.count("*").alias("findings")).orderBy("time", "detection")


def triage_queue(t, span, k=50):
    groups = production_alerts(t, span).where(F.col("alert_severity") == 1).groupBy(pair_of_alert().alias("signature_source")).agg(
        F.min("alert_signature").alias("signature"), F.count("*").alias("alerts"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        any_text(F.col("http_url")).alias("sample_url"),
    )
    return top(excluding(groups, "signature_source", _reviewed(t, "suricata")), k, F.desc("last_seen"), "signature_source")


def top_signatures(t, span, k=20):
    groups = production_alerts(t, span).groupBy(F.col("alert_signature_id").alias("sid")).agg(
        F.min("alert_signature").alias("signature"), F.min("alert_severity").alias("level"), F.count("*").alias("alerts"), F.countDistinct("src_ip").alias("sources")
    )
    return top(groups, k, F.desc("alerts"), "sid")


def alert_sources(t, span, k=25):
    """Busiest sources with the verdicts on their signatures and the latest response."""
    groups = production_alerts(t, span).groupBy(F.col("src_ip").alias("source")).agg(
        F.count("*").alias("alerts"), F.count_if(F.col("alert_severity") == 1).alias("severity_1"), F.countDistinct("alert_signature_id").alias("signatures")
    )
    first = top(groups, k, F.desc("severity_1"), F.desc("alerts"), "source")
    # Two possible verdicts, so the set per source has at most two members.
    judged = latest_verdicts(t, "suricata").groupBy(F.split_part("subject", F.lit("|"), F.lit(2)).alias("source")).agg(
        F.array_join(F.array_sort(F.collect_set("verdict")), ", ").alias("verdicts")
    )
    newest = F.max_by(F.concat("action", F.lit(" ("), "mode", F.lit(")")), F.struct("created_at", "action", "mode"))
    acted = t["actions"].groupBy(F.col("ip").alias("source")).agg(newest.alias("response"))
    joined = first.join(judged, "source", "left").join(acted, "source", "left")
    return joined.fillna("", ["verdicts", "response"]).orderBy(F.desc("severity_1"), F.desc("alerts"), "source")


def current_findings(t, detections=()):
    rows = t["hits"].where(F.col("run_at") == latest_run(t))
    rows = rows.where(F.col("detection_id").isin(*detections)) if detections else rows
    judged = rows.join(latest_verdicts(t, "detection").withColumnRenamed("subject", "hit_key"), "hit_key", "left")
    return judged.select(
        F.col("detection_id").alias("detection"), F.col("severity").alias("level"), F.col("src").alias("source"), F.col("dst").alias("destination"),
        F.col("dst_port").alias("port"), F.col("score").alias("finding_score"), F.col("summary").alias("what"), F.coalesce("verdict", F.lit("unreviewed")).alias("verdict"),
    ).orderBy(F.desc("finding_score"), "what")


def recent_alerts(t, span, k=100):
    rows = production_alerts(t, span).select(
        F.col("timestamp").alias("time"), F.col("alert_severity").alias("level"), F.col("alert_signature_id").alias("sid"), F.col("alert_signature").alias("signature"),
        "src_ip", "dest_port", "app_proto", F.col("http_url").alias("url"), "community_id",
    )
    return top(rows, k, F.desc("time"), "community_id")


def flow_of_alert(t, span):
    """Alerts with the connection record of the same flow; a missing identifier is '' and matches nothing."""
    known = F.col("community_id") != ""
    alerts = within(t["alert"], span, "timestamp").where(known).select("community_id", "alert_signature_id", "src_ip", F.col("timestamp").alias("alerted_at"))
    return alerts.join(within(t["conn"], span).where(known).select("community_id", "uid", "conn_state", "ts"), "community_id")
