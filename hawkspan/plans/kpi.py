"""Operating figures: detection and response times, alert volume, false-positive rates, coverage and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hawkspan.functions.times import instant, plus_seconds, time_slice, unit_boundaries
from hawkspan.operators.samples import share
from hawkspan.plans.common import PRODUCTION_IFACE, latest_verdicts, pair_of_alert, top

DAY = 86400.0
STATUS_ORDER = ("gap", "observed", "validated")


def _since(as_of, days) -> Column:
    return plus_seconds(instant(as_of), -days * DAY)


def _upper_median(column: str) -> Column:
    """The upper of two middle elements: the discrete median of the descending order."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)")


def _passed(t, as_of, days=30):
    return t["validation_runs"].where((F.col("result") == "PASS") & (F.col("started_at") > _since(as_of, days)))


def median_time_to_detect(t, as_of):
    return _passed(t, as_of).agg(_upper_median("mttd_ms").alias("mttd"))


def median_time_to_visible(t, as_of):
    return _passed(t, as_of).agg((_upper_median("visible_ms") / 1000).alias("visible"))


def daily_alert_average(t, as_of, days=7, iface=PRODUCTION_IFACE):
    """Mean alerts per complete day."""
    today = F.date_trunc("day", instant(as_of))
    rows = time_slice(t["alert"], _since(as_of, days), today, "timestamp").where((F.col("in_iface") == iface) & (F.col("timestamp") > _since(as_of, days)))
    return rows.groupBy(F.to_date("timestamp").alias("d")).agg(F.count("*").alias("n")).agg(F.bround(F.avg("n")).alias("per_day"))


def daily_alerts_by_severity(t, span, iface=PRODUCTION_IFACE):
    level = F.concat(F.lit("severity "), F.col("alert_severity").cast("string")).alias("level")
    rows = time_slice(t["alert"], span[0], span[1], "timestamp").where(F.col("in_iface") == iface)
    return rows.groupBy(F.date_trunc("day", "timestamp").alias("time"), level).agg(F.count("*").alias("alerts")).orderBy("time", "level")


def _is(verdict: str) -> Column:
    return F.count_if(F.col("verdict") == verdict)


def _reviewed_pairs(t, iface) -> DataFrame:
    seen = t["alert"].where(F.col("in_iface") == iface).select(pair_of_alert().alias("subject")).distinct()
    return latest_verdicts(t, "suricata").join(seen, "subject", "left_semi")


def false_positive_rate(t, iface=PRODUCTION_IFACE):
    return _reviewed_pairs(t, iface).agg(share(_is("false_positive"), F.count("*")).alias("fp_rate"))


def false_positive_rates(t, iface=PRODUCTION_IFACE):
    """By reviewed pair, by alert and by finding."""
    # Alerts are counted per pair before they meet the verdicts.
    per_pair = t["alert"].where(F.col("in_iface") == iface).groupBy(pair_of_alert().alias("subject")).agg(F.count("*").alias("n"))
    findings = t["hits"].select(F.col("hit_key").alias("subject")).distinct().withColumn("n", F.lit(1).cast("long"))
    groups = {
        "Suricata (by reviewed pair)": _reviewed_pairs(t, iface).withColumn("n", F.lit(1).cast("long")),
        "Suricata (by alert, incl. tuned noise)": per_pair.join(latest_verdicts(t, "suricata"), "subject"),
        "Behavior detections (by finding)": findings.join(latest_verdicts(t, "detection"), "subject"),
    }
    out = None
    for name, rows in groups.items():
        right, wrong = (F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)), F.lit(0)) for v in ("true_positive", "false_positive"))
        part = rows.agg(right.alias("true_positives"), wrong.alias("false_positives"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("fp_rate_pct", F.bround(100 * share(F.col("false_positives"), F.col("total")), 1))


def coverage_share(t):
    return t["coverage"].where("in_target").agg(share(F.count_if(F.col("status") == "validated"), F.count("*")).alias("coverage"))


def coverage_table(t):
    place = F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("status"))
    rows = t["coverage"].where("in_target").orderBy(place, "technique_id")
    return rows.select(
        F.col("technique_id").alias("technique"), F.col("name").alias("technique_name"), "tactic", F.col("status").alias("coverage"),
        F.array_join("detections", ", ").alias("validated_by"), F.array_join("observed_by", ", ").alias("observed"),
    )


def detection_health(t, as_of):
    now = instant(as_of)
    newest = F.max_by(F.struct("result", "hits", "duration_ms"), F.struct("run_at", "run_id"))
    failed = (F.col("result") == "error") & (F.col("run_at") > plus_seconds(now, -DAY))
    groups = t["runs"].where(~F.col("backfill")).groupBy(F.col("detection_id").alias("detection")).agg(newest.alias("n"), F.max("run_at").alias("last_run"), F.count_if(failed).alias("errors_24h"))
    return groups.select(
        "detection", F.col("n.result").alias("last_result"), F.col("n.hits").alias("last_hits"), F.col("n.duration_ms").alias("last_duration_ms"), "last_run",
        unit_boundaries("minute", F.col("last_run"), now).alias("minutes_ago"), "errors_24h",
    ).orderBy("detection")


def validation_list(t, k=40):
    rows = t["validation_runs"].select(
        "started_at", F.col("case_name").alias("test_case"), F.col("attack_technique").alias("technique"), F.col("result").alias("outcome"), "mttd_ms", "visible_ms", "rules_loaded"
    )
    return top(rows, k, F.desc("started_at"), "test_case")
