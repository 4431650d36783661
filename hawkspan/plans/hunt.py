"""Outbound hunting views: regularity, uploads, TLS clients and certificates."""

from __future__ import annotations

from pyspark.sql import functions as F

from hawkspan.functions.net import in_networks
from hawkspan.operators.medians import attach, by_kind, frequent, grouped_median, measure_table
from hawkspan.operators.samples import any_text, share, smallest_distinct
from hawkspan.plans.common import distinct_total, outbound, per_step, top, total, within
from hawkspan.session import stored

SENSOR_NETWORKS = ("10.128.0.0/9",)  # fixed value: the sensor's own network

# The one usual port per service this view leaves out.
USUAL_PORT = {"ssl": 443, "http": 80, "dns": 53, "ntp": 123, "ssh": 22}


def _outgoing(t, span):
    return within(t["conn"], span).where(outbound())


def _with_tls(t, span):
    """Outbound connections with their TLS log lines, counted: ``lines`` is how often a plain join would repeat the row."""
    per_uid = within(t["ssl"], span).groupBy("uid").agg(F.count("*").alias("lines"), F.min(F.when(F.col("server_name") != "", F.col("server_name"))).alias("name"))
    rows = _outgoing(t, span).join(per_uid, "uid", "left")
    return rows.withColumn("lines", F.coalesce("lines", F.lit(1)))


def outbound_connections(t, span):
    return total(_outgoing(t, span), "connections")


def external_destinations(t, span):
    return distinct_total(_outgoing(t, span), "id_resp_h", "destinations")


def uploaded(t, span):
    return _outgoing(t, span).agg(F.coalesce(F.sum("orig_bytes"), F.lit(0)).alias("uploaded"))


def most_regular_pairs(t, span, k=20, min_conns=10, min_gap_s=5):
    """Destinations contacted most like clockwork: deviation of the gaps relative to their interpolated median."""
    keys = ["destination", "port"]
    events = stored(_with_tls(t, span).select(F.col("id_resp_h").alias("destination"), F.col("id_resp_p").alias("port"), F.unix_micros("ts").alias("at"), "lines", "name"), "contacts")
    # Counting comes first: destinations that are rarely met never reach the gaps. A connection weighs as much as its TLS log lines.
    often = events.groupBy(*keys).agg(F.sum("lines").alias("lines")).where(F.col("lines") >= min_conns)
    events = frequent(events, often, keys)
    measures = measure_table(events, keys, "at", "lines")
    gaps = measures.where(F.col("kind") == "gap").select(*keys, "value", "n")
    middles = grouped_median(gaps, keys, "value", kind="midpoint", min_count=max(min_conns - 1, 1), alias="mid").where(F.col("mid") >= min_gap_s * 1e6).drop("total")
    # Twice the deviation is a whole number even when the median lies between two gaps.
    around = attach(gaps, middles, keys, spread="value").withColumn("off", F.abs(2 * F.col("value") - 2 * F.col("mid")).cast("long"))
    mads = grouped_median(around.select(*keys, "off", "n"), keys, "off", kind="midpoint", alias="mad2").select(*keys, "mad2")
    counts = by_kind(measures.where(F.col("kind") == "first"), keys, connections=("first", "n")).where(F.col("connections") >= min_conns)
    names = events.groupBy(*keys).agg(F.coalesce(F.min("name"), F.lit("")).alias("sni"))
    mid_s, mad_s = F.col("mid") / 1e6, F.col("mad2") / 2e6
    found = middles.join(mads, keys).join(counts, keys).join(names, keys).select(
        *keys, "sni", "connections", F.bround(mid_s).alias("median_interval_s"), F.bround(mad_s, 1).alias("mad_s"), F.bround(share(mad_s, mid_s), 3).alias("irregularity")
    )
    return top(found, k, "irregularity", *keys)


def top_upload_destinations(t, span, k=20):
    rows = _with_tls(t, span)
    up, down = F.sum(F.col("orig_bytes") * F.col("lines")), F.sum(F.col("resp_bytes") * F.col("lines"))
    groups = rows.groupBy(F.col("id_resp_h").alias("destination")).agg(
        F.coalesce(F.min("name"), F.lit("")).alias("sni"), F.sum("lines").alias("connections"), up.alias("bytes_up"), down.alias("bytes_down")
    ).withColumn("upload_ratio", F.bround(share(F.col("bytes_up"), F.col("bytes_up") + F.col("bytes_down")), 2))
    return top(groups, k, F.desc("bytes_up"), "destination")


def rarest_clients(t, span, k=20, networks=SENSOR_NETWORKS):
    rows = within(t["ssl"], span).where((F.col("ja4") != "") & in_networks("id_orig_h", networks))
    rare = top(rows.groupBy("ja4").agg(F.count("*").alias("sessions"), F.countDistinct("server_name").alias("server_names"), F.min("ts").alias("first_seen")), k, "sessions", "ja4")
    names = smallest_distinct(rows.join(F.broadcast(rare.select("ja4")), "ja4", "left_semi"), ["ja4"], F.col("server_name"), 3, "sample_sni")
    return rare.join(names, "ja4").withColumn("sample_sni", F.array_join("sample_sni", ", ")).orderBy("sessions", "ja4")


def tls_without_name(t, span, k=20, networks=SENSOR_NETWORKS):
    rows = within(t["ssl"], span).where((F.col("server_name") == "") & in_networks("id_orig_h", networks))
    groups = rows.groupBy(F.col("id_resp_h").alias("destination"), F.col("id_resp_p").alias("port")).agg(
        F.count("*").alias("sessions"), any_text(F.col("ja4")).alias("client_ja4"), F.max("ts").alias("last_seen")
    )
    return top(groups, k, F.desc("sessions"), "destination", "port")


def unusual_ports(t, span, k=20):
    usual = F.expr(" OR ".join(f"(service = '{s}' AND id_resp_p = {p})" for s, p in USUAL_PORT.items()))
    groups = _outgoing(t, span).where((F.col("service") != "") & ~usual).groupBy(F.col("service").alias("detected"), F.col("id_resp_p").alias("port")).agg(
        F.count("*").alias("connections"), F.countDistinct("id_resp_h").alias("destinations")
    )
    return top(groups, k, F.desc("connections"), "detected", "port")


def certificate_problems(t, span, k=20):
    rows = within(t["ssl"], span).where(~F.col("validation_status").isin("", "ok"))
    groups = rows.groupBy(F.col("server_name").alias("sni"), F.col("id_resp_h").alias("server"), F.col("validation_status").alias("status")).agg(
        any_text(F.col("issuer")).alias("cert_issuer"), F.count("*").alias("sessions")
    )
    return top(groups, k, F.desc("sessions"), "sni", "server", "status")


def outbound_bytes(t, span, step):
    return per_step(_outgoing(t, span), "ts", step).agg(F.sum("orig_bytes").alias("sent"), F.sum("resp_bytes").alias("received")).orderBy("time")
