"""Stored findings, run history, analyst verdicts, suppression rules and technique coverage."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hawkspan.functions.text import present
from hawkspan.functions.times import instant, plus_seconds, stored_days
from hawkspan.operators.allowlist import RejectedRows
from hawkspan.operators.ipjoin import cut_addresses, distinct_addresses, distinct_network_blocks
from hawkspan.plans import detections as _registered  # noqa: F401  (importing it fills the registry)
from hawkspan.plans.common import PRODUCTION_IFACE, latest_verdicts, pair_of_alert
from hawkspan.plans.registry import COMMON_COLUMNS, REGISTRY
from hawkspan.session import stored

WINDOW = timedelta(hours=24)
RUN_COLUMNS = "run_id string, run_at timestamp, window_start timestamp, window_end timestamp, detection_id string, result string, hits long, duration_ms long, backfill boolean, error string"


def to_hits(found: DataFrame, run_id: str | Column = "", run_at=None, start=None, end=None) -> DataFrame:
    """Findings as stored rows: the common columns, everything else as JSON with sorted keys, and a stable key."""
    extra = sorted(c for c in found.columns if c not in COMMON_COLUMNS and c != "window_end")
    details = F.to_json(F.struct(*extra)) if extra else F.lit("{}")
    port = F.coalesce(F.col("dst_port").cast("int"), F.lit(0))
    key = F.concat_ws("|", "detection_id", "src", "dst", port.cast("string"))
    run = [F.lit(run_id).alias("run_id")] + [
        (F.lit(None).cast("timestamp") if v is None else instant(v)).alias(n) for n, v in (("run_at", run_at), ("window_start", start), ("window_end", end))
    ]
    common = [port.alias("dst_port") if c == "dst_port" else F.col(c) for c in COMMON_COLUMNS]
    return found.select(*run, *common, details.alias("details"), key.alias("hit_key"))


def window_ends(now: datetime, backfill_hours: int = 0) -> list[tuple[datetime, bool]]:
    """Window ends to run: now, or every past full hour, oldest first."""
    now = now.replace(microsecond=0)
    if not backfill_hours:
        return [(now, False)]
    hour = now.replace(minute=0, second=0)
    return [(hour - timedelta(hours=h), True) for h in range(backfill_hours, 0, -1)]


def run_detections(spark: SparkSession, tables: Mapping[str, DataFrame], now: datetime, hits_path: str, runs_path: str, backfill_hours: int = 0, params: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Run every registered detection and append findings and run rows; one failure does not stop the rest. Returns the run rows.

    A backfill is one job per detection, however many hours it covers: all windows come out of one pass over each table.
    """
    windows, run, rows = window_ends(now, backfill_hours), str(uuid.uuid4()), []
    run_ids = {end: f"{run}-{end:%Y%m%d%H}" if backfill else run for end, backfill in windows}
    for detection_id, detection in sorted(REGISTRY.items()):
        began, counts, result, error = time.monotonic(), {}, "ok", ""
        options = (params or {}).get(detection_id, {})
        try:
            if backfill_hours:
                found = detection.hourly(tables, windows[0][0], windows[-1][0], now, int(WINDOW / timedelta(hours=1)), **options)
                named = F.concat(F.lit(f"{run}-"), F.date_format("window_end", "yyyyMMddHH"))
                hits = to_hits(found, named, F.col("window_end"), plus_seconds(F.col("window_end"), -WINDOW.total_seconds()), F.col("window_end"))
            else:
                end = windows[0][0]
                hits = to_hits(detection(tables, end - WINDOW, end, now, **options), run, now, end - WINDOW, end)
            path = f"{hits_path}/job={run}/detection={detection_id}"
            hits.withColumn("date", F.to_date("run_at")).write.mode("overwrite").parquet(path)
            # One row a window, of which there are as many as hours asked for.
            counts = {r["run_id"]: r["count"] for r in spark.read.parquet(path).groupBy("run_id").count().collect()}
        except Exception as problem:  # recorded in the run rows
            result, error = "error", str(problem).strip()[-1000:]
        took = int((time.monotonic() - began) * 1000) // len(windows)
        rows += [(run_ids[end], end if backfill else now, end - WINDOW, end, detection_id, result, counts.get(run_ids[end], 0), took, backfill, error) for end, backfill in windows]
    runs = spark.createDataFrame(rows, RUN_COLUMNS)
    runs.coalesce(1).write.mode("append").parquet(runs_path)
    return runs


# --- verdicts --------------------------------------------------------------------------------------------------------


def check_verdicts(rows: DataFrame) -> DataFrame:
    """Verdict rows plus ``errors``."""
    subject, source = F.col("subject"), F.col("source")
    return rows.withColumn(
        "errors",
        present(
            F.when(~source.isin("suricata", "detection"), F.lit("source")),
            F.when((source == "suricata") & ~subject.rlike(r"^[0-9]+\|[0-9A-Fa-f.:]+$"), F.lit("subject")),
            F.when((source == "detection") & ~subject.rlike(r"^DET-[0-9]{3}\|[^|]*\|[^|]*\|[0-9]+$"), F.lit("subject")),
            F.when(~F.col("verdict").isin("true_positive", "false_positive"), F.lit("verdict")),
            F.when(~F.col("tune_id").rlike("^(-|TUNE-[0-9]{3})?$"), F.lit("tune_id")),
            F.when(F.coalesce("note", F.lit("")) == "", F.lit("note")),
        ),
    )


def record_verdicts(rows: DataFrame, path: str) -> None:
    """Append checked verdicts; refuses the batch when any row is faulty."""
    checked = check_verdicts(rows)
    faulty = checked.where(F.size("errors") > 0).limit(20).collect()
    if faulty:
        raise RejectedRows("; ".join(f"{r['subject']}: {', '.join(r['errors'])}" for r in faulty))
    checked.drop("errors").withColumn("tune_id", F.when(F.col("tune_id") == "-", "").otherwise(F.col("tune_id"))).write.mode("append").parquet(path)


def verdict_list(t) -> DataFrame:
    newest = F.max_by(F.struct("verdict", "tune_id", "analyst", "note"), F.struct("created_at", "verdict", "note"))
    groups = t["verdicts"].groupBy("source", "subject").agg(newest.alias("v"), F.max("created_at").alias("decided"))
    return groups.select("source", "subject", "v.verdict", F.col("v.tune_id").alias("tune"), "v.analyst", "decided", "v.note").orderBy(F.desc("decided"), "source", "subject")


# --- signature suppression -------------------------------------------------------------------------------------------


def suppress_alerts(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """Alerts no rule covers. ``rules``: gid, sid, track (by_src, by_dst, by_either), ip (address or CIDR)."""
    named = rules.select("gid", "sid", "track", "ip").distinct()
    blocks = stored(named.join(distinct_network_blocks(named, "ip"), "ip").select("gid", "sid", "track", "block").distinct(), "rule-blocks")
    kept = alerts
    for side, column in (("by_src", "src_ip"), ("by_dst", "dest_ip")):
        mine = blocks.where(F.col("track").isin(side, "by_either"))
        pairs = alerts.select(F.col("alert_gid").alias("gid"), F.col("alert_signature_id").alias("sid"), F.col(column).alias("addr")).distinct()
        # Addresses that meet a block of any rule are found first; only their pairs are cut.
        near = cut_addresses(distinct_addresses(alerts, column), mine).join(mine.select("block").distinct(), "block", "left_semi").select("addr", "block")
        hit = pairs.join(near, "addr").join(mine, ["gid", "sid", "block"], "left_semi").select("gid", "sid", "addr").distinct()
        kept = kept.join(hit, (kept["alert_gid"] == hit["gid"]) & (kept["alert_signature_id"] == hit["sid"]) & (kept[column] == hit["addr"]), "left_anti")
    return kept


# --- technique coverage ----------------------------------------------------------------------------------------------

# Honeypot events and the technique they show.
HONEYPOT_TECHNIQUES = {
    "cowrie.login.failed": "T1110.001", "cowrie.login.success": "T1110.001", "cowrie.command.input": "T1059.004",
    "cowrie.session.file_upload": "T1105", "cowrie.session.file_download": "T1105", "cowrie.session.file_download.failed": "T1105",
}


def observed_techniques(t, as_of, days=30, iface=PRODUCTION_IFACE) -> DataFrame:
    """``technique, seen_by, sources`` from alerts not judged false positive, and from the honeypot."""
    since = plus_seconds(instant(as_of), -days * 86400.0)
    wrong = latest_verdicts(t, "suricata").where(F.col("verdict") == "false_positive")
    alerts = stored_days(t["alert"], since).where((F.col("in_iface") == iface) & (F.col("timestamp") > since))
    # Alerts shrink to distinct (technique, pair) before they meet the verdicts.
    pairs = alerts.select(F.explode("alert_metadata_mitre_technique_id").alias("technique"), pair_of_alert().alias("subject"), "src_ip").distinct()
    by_alert = pairs.join(wrong, "subject", "left_anti").groupBy("technique").agg(F.countDistinct("src_ip").alias("sources")).withColumn("seen_by", F.lit("suricata"))
    mapping = F.create_map(*[F.lit(x) for pair in HONEYPOT_TECHNIQUES.items() for x in pair])
    probes = stored_days(t["cowrie"], since).where((F.col("timestamp") > since) & F.col("eventid").isin(*HONEYPOT_TECHNIQUES)).withColumn("technique", F.try_element_at(mapping, F.col("eventid")))
    by_probe = probes.groupBy("technique").agg(F.countDistinct("src_ip").alias("sources")).withColumn("seen_by", F.lit("honeypot"))
    return by_alert.unionByName(by_probe)


def attack_coverage(catalog: DataFrame, targets: DataFrame, observed: DataFrame) -> DataFrame:
    """Status per technique: validated, else observed, else gap.

    ``catalog``: id, techniques (array), validated. ``targets``: technique_id, tactic, name. The arrays built here list
    detections of one technique, so their size is that of the catalogue.
    """
    listed = catalog.select("id", "validated", F.explode(F.array_distinct("techniques")).alias("technique_id"))
    known = listed.groupBy("technique_id").agg(F.array_sort(F.collect_set(F.when(F.col("validated"), F.col("id")))).alias("detections"))
    text = F.concat("seen_by", F.lit(" ("), F.col("sources").cast("string"), F.lit(" sources)"))
    seen = observed.where(F.col("sources") > 0).groupBy(F.col("technique").alias("technique_id")).agg(F.reverse(F.array_sort(F.collect_set(text))).alias("observed_by"))
    wanted = targets.select("technique_id", "tactic", "name", F.lit(True).alias("in_target"))
    empty = F.array().cast("array<string>")
    rows = wanted.join(known, "technique_id", "full_outer").join(seen, "technique_id", "full_outer").select(
        "technique_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("tactic", F.lit("")).alias("tactic"), F.coalesce("in_target", F.lit(False)).alias("in_target"),
        F.coalesce("detections", empty).alias("detections"), F.coalesce("observed_by", empty).alias("observed_by"),
    )
    status = F.when(F.size("detections") > 0, "validated").when(F.size("observed_by") > 0, "observed").otherwise("gap")
    return rows.withColumn("status", status).select("technique_id", "name", "tactic", "in_target", "status", "detections", "observed_by")


# Scores, colours, legend and view settings of the exported layer document.
LAYER_SCORES = {"validated": 2, "observed": 1, "gap": 0}
LAYER_COLOURS = ("#e8716b", "#f5d76e", "#66b86a")
LAYER_LEGEND = (("Validated detection", "#66b86a"), ("Observed in production only", "#f5d76e"), ("Target without detection (gap)", "#e8716b"))
LAYER_PLATFORMS, LAYER_SORTING, LAYER_LAYOUT = ("Linux", "Network"), 3, "side"


def layer_rows(coverage: DataFrame) -> DataFrame:
    """One row per technique of the exported layer: technique, score, comment, metadata."""
    score = F.expr("CASE status " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in LAYER_SCORES.items()) + " END")
    comment = F.array_join(
        present(
            F.when(F.size("detections") > 0, F.concat(F.lit("validated by "), F.array_join("detections", ", "))),
            F.when(F.size("observed_by") > 0, F.concat(F.lit("observed: "), F.array_join("observed_by", ", "))),
            F.when(F.col("status") == "gap", F.lit("in target list, no detection yet")),
            F.when(~F.col("in_target"), F.lit("outside the target list")),
        ), "; ",
    )

    def entry(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    metadata = F.concat(F.array(entry("status", F.col("status"))), F.transform("detections", lambda d: entry("detection", d)))
    return coverage.select(
        F.col("technique_id").alias("techniqueID"), score.alias("score"), comment.alias("comment"), F.lit(True).alias("enabled"),
        F.lit(False).alias("showSubtechniques"), metadata.alias("metadata"),
    )


def layer_document(coverage: DataFrame, name: str) -> DataFrame:
    """The layer as one JSON text row (the technique list is a catalogue of a few hundred rows)."""
    validated = F.count_if(F.col("status") == "validated")
    share = F.bround(100 * validated / F.greatest(F.count("*"), F.lit(1))).cast("int").cast("string")
    counts = coverage.where("in_target").agg(
        F.concat(
            F.lit("Targets: "), F.count("*").cast("string"), F.lit("; validated "), validated.cast("string"), F.lit(" ("), share, F.lit("%)"),
            F.lit("; observed only "), F.count_if(F.col("status") == "observed").cast("string"), F.lit("; gaps "), F.count_if(F.col("status") == "gap").cast("string"),
        ).alias("description")
    )
    rows = layer_rows(coverage)
    packed = rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("techniques")).withColumn("description", counts.scalar())
    head = F.struct(F.lit("4.5").alias("layer"), F.lit("5.1.0").alias("navigator"))
    gradient = F.struct(F.array(*map(F.lit, LAYER_COLOURS)).alias("colors"), F.lit(0).alias("minValue"), F.lit(2).alias("maxValue"))
    filters = F.struct(F.array(*map(F.lit, LAYER_PLATFORMS)).alias("platforms"))
    layout = F.struct(F.lit(LAYER_LAYOUT).alias("layout"), F.lit(True).alias("showID"), F.lit(True).alias("showName"))
    legend = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(colour).alias("color")) for label, colour in LAYER_LEGEND])
    return packed.select(
        F.to_json(F.struct(
            F.lit(name).alias("name"), head.alias("versions"), F.lit("enterprise-attack").alias("domain"), "description", filters.alias("filters"), F.lit(LAYER_SORTING).alias("sorting"),
            layout.alias("layout"), F.lit(False).alias("hideDisabled"), "techniques", gradient.alias("gradient"), legend.alias("legendItems"), F.lit(False).alias("showTacticRowBackground"),
            F.lit(True).alias("selectTechniquesAcrossTactics"),
        )).alias("value")
    )
