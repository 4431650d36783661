"""DNS reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from hawkspan.functions.text import registered_domain
from hawkspan.functions.times import instant, plus_seconds
from hawkspan.operators.samples import share
from hawkspan.plans.common import distinct_total, latest_verdicts, per_step, top, total, within
from hawkspan.plans.triage import DNS_DETECTIONS


def _failed():
    return F.col("rcode_name") == "NXDOMAIN"


def query_count(t, span):
    return total(within(t["dns"], span), "queries")


def registered_domains(t, span):
    return distinct_total(within(t["dns"], span).where(F.col("query") != ""), registered_domain("query"), "domains")


def nxdomain_share(t, span):
    return within(t["dns"], span).agg(share(F.count_if(_failed()), F.count("*")).alias("nx"))


def queries_by_answer(t, span, step):
    answer = F.when(F.col("rcode_name") == "", "(no answer)").otherwise(F.col("rcode_name")).alias("answer")
    return per_step(within(t["dns"], span), "ts", step, answer).agg(F.count("*").alias("queries")).orderBy("time", "answer")


def nxdomain_share_over_time(t, span, step):
    return per_step(within(t["dns"], span), "ts", step).agg(share(F.count_if(_failed()), F.count("*")).alias("nxdomain_share")).orderBy("time")


def top_domains(t, span, k=20):
    # Grouping by (name, client) first leaves few rows for the two distinct counts, and the table is read once.
    pairs = within(t["dns"], span).where(F.col("query") != "").groupBy("query", "id_orig_h").agg(F.count("*").alias("n")).withColumn("domain", registered_domain("query"))
    groups = pairs.groupBy("domain").agg(F.sum("n").alias("queries"), F.countDistinct("query").alias("names"), F.countDistinct("id_orig_h").alias("clients"))
    return top(groups, k, F.desc("queries"), "domain")


def top_failed_names(t, span, k=20):
    groups = within(t["dns"], span).where(_failed()).groupBy(F.col("query").alias("name"), F.col("qtype_name").alias("record_type")).agg(
        F.count("*").alias("failures"), F.countDistinct("id_orig_h").alias("clients")
    )
    return top(groups, k, F.desc("failures"), "name", "record_type")


def longest_names(t, span, k=20):
    groups = within(t["dns"], span).groupBy(F.col("query").alias("name"), F.col("qtype_name").alias("record_type"), F.col("id_orig_h").alias("client")).agg(F.count("*").alias("times"))
    return top(groups.withColumn("chars", F.length("name")), k, F.desc("chars"), "name", "record_type", "client")


def record_types(t, span, k=20):
    groups = within(t["dns"], span).groupBy(F.col("qtype_name").alias("record_type"), F.col("id_resp_h").alias("resolver")).agg(
        F.count("*").alias("queries"), F.count_if(_failed()).alias("nxdomain")
    )
    return top(groups, k, F.desc("queries"), "record_type", "resolver")


def dns_findings_of_week(t, as_of, k=50, days=7):
    recent = t["hits"].where(F.col("detection_id").isin(*DNS_DETECTIONS) & (F.col("run_at") > plus_seconds(instant(as_of), -days * 86400.0)))
    judged = recent.join(latest_verdicts(t, "detection").withColumnRenamed("subject", "hit_key"), "hit_key", "left")
    groups = judged.groupBy(F.col("detection_id").alias("detection"), F.col("src").alias("source"), F.col("dst").alias("domain_or_resolver")).agg(
        F.max("score").alias("finding_score"), F.min("summary").alias("what"), F.min("run_at").alias("first_reported"), F.max("run_at").alias("last_reported"),
        F.coalesce(F.min("verdict"), F.lit("unreviewed")).alias("verdict"),
    )
    return top(groups, k, F.desc("last_reported"), "detection", "source", "domain_or_resolver")
