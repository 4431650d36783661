"""Checking the checks: expected signatures, expected findings, two fingerprint sources, arrival of test events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hawkspan.functions.times import instant, plus_seconds, time_slice


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def evaluate_cases(cases: DataFrame, alerts: DataFrame, iface: str) -> DataFrame:
    """Expected against seen signatures per case; ``visible_ms`` tells when the last expected one could be queried, where alerts say when they were loaded.

    ``cases``: case_name, started_at, deadline, expected_sids. Cases are joined on the minutes they span, so that a busy
    period is split; a case's set of signatures is at most the rule catalogue. Minutes are made for the cases only that any alert can meet,
    and narrow; the hint keeps them off the driver, as Spark guesses their size from the cases' alone.
    """
    # One row per (instant, signature) is all a case needs to know of the alerts, and only of the time the cases span.
    alerts = time_slice(alerts, cases.agg(F.min("started_at")).scalar(), cases.agg(F.max("deadline")).scalar(), "timestamp").where(F.col("in_iface") == iface)
    met = cases.where((F.col("started_at") <= alerts.agg(F.max("timestamp")).scalar()) & (F.col("deadline") > alerts.agg(F.min("timestamp")).scalar()))
    minutes = F.explode(F.sequence(F.date_trunc("minute", "started_at"), F.date_trunc("minute", "deadline"), F.expr("INTERVAL 1 MINUTE")))
    spans = met.select("case_name", "started_at", "deadline", minutes.alias("minute"))
    loaded = F.col("loaded_at") if "loaded_at" in alerts.columns else F.lit(None).cast("timestamp")
    seen = alerts.groupBy("alert_signature_id", "timestamp").agg(F.min(loaded).alias("loaded_at")).withColumn("minute", F.date_trunc("minute", "timestamp"))
    inside = (F.col("timestamp") >= F.col("started_at")) & (F.col("timestamp") < F.col("deadline"))
    hits = seen.join(spans.hint("merge"), "minute").where(inside).groupBy("case_name", "alert_signature_id").agg(
        F.min("timestamp").alias("first_at"), F.min("loaded_at").alias("loaded_at")
    )
    hits = hits.join(cases.select("case_name", "expected_sids"), "case_name").withColumn("is_expected", F.array_contains("expected_sids", F.col("alert_signature_id")))
    found = hits.groupBy("case_name").agg(
        F.array_sort(F.collect_list("alert_signature_id")).alias("detected_sids"), F.min(F.when(F.col("is_expected"), F.col("first_at"))).alias("first_expected"),
        F.max(F.when(F.col("is_expected"), F.col("first_at"))).alias("all_expected"), F.max(F.when(F.col("is_expected"), F.col("loaded_at"))).alias("all_loaded"),
    )
    judged = cases.join(found, "case_name", "left").withColumn("detected_sids", F.coalesce("detected_sids", _empty("bigint")))
    judged = judged.withColumn("missing_sids", F.array_except("expected_sids", "detected_sids")).withColumn("unexpected_sids", F.array_except("detected_sids", "expected_sids"))
    passed = F.size("missing_sids") == 0

    def millis(at: str) -> Column:
        return F.when(passed, F.floor((F.unix_micros(at) - F.unix_micros("started_at")) / 1000).cast("long"))

    return judged.select(
        "case_name", "started_at", F.array_sort("expected_sids").alias("expected_sids"), "detected_sids", F.array_sort("missing_sids").alias("missing_sids"), "unexpected_sids",
        F.when(passed, F.col("first_expected")).alias("first_alert_at"), millis("first_expected").alias("mttd_ms"), millis("all_expected").alias("complete_ms"),
        millis("all_loaded").alias("visible_ms"),
        F.when(passed, "PASS").otherwise("FAIL").alias("result"),
    )


def check_expectations(findings: DataFrame, expected: DataFrame, fields: list[str]) -> DataFrame:
    """Per expectation ``detection_id, src, flag, <fields>`` (NULL field: not compared): whether the findings agree.

    List values are compared sorted, everything else as text.
    """

    def text(df: DataFrame, name: str) -> Column:
        kind = dict(df.dtypes)[name]
        return F.array_join(F.array_sort(name), ",") if kind.startswith("array") else F.col(name).cast("string")

    have = findings.select("detection_id", "src", *[text(findings, f).alias(f"have_{f}") for f in fields], F.lit(True).alias("reported"))
    agree = F.col("reported")
    for f in fields:
        wanted = text(expected, f)
        agree = agree & (wanted.isNull() | wanted.eqNullSafe(F.col(f"have_{f}")))
    # Findings of the expected hosts only, reduced to "any" and "any that agrees".
    met = expected.join(have, ["detection_id", "src"], "left").groupBy("detection_id", "src", "flag", *fields).agg(
        F.coalesce(F.max(agree), F.lit(False)).alias("matched"), F.count("reported").alias("found")
    )
    return met.select("detection_id", "src", "flag", F.when(F.col("flag"), F.col("matched")).otherwise(F.col("found") == 0).alias("passed"))


def reconcile_fingerprints(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Two sources of TLS fingerprints, flow by flow.

    ``ours``: community_id, server_name, ja3, ja4, ja4_r. ``theirs``: community_id, ja3, ja4. One difference is known: the
    other engine hashes the extension text with a trailing underscore when there are no signature algorithms.
    """
    other = theirs.where(F.col("ja4") != "").select("community_id", F.col("ja3").alias("other_ja3"), F.col("ja4").alias("other_ja4"), F.lit(True).alias("in_theirs"))
    mine = ours.where(F.col("ja4") != "").select("community_id", "server_name", "ja3", "ja4", "ja4_r", F.lit(True).alias("in_ours"))
    both = mine.join(other, "community_id", "full_outer")
    raw = F.split("ja4_r", "_")
    underscored = F.substring(F.sha2(F.concat(F.get(raw, F.lit(2)), F.lit("_")), 256), 1, 12)
    same_head = F.substring_index("ja4", "_", 2) == F.substring_index("other_ja4", "_", 2)
    known = (F.col("ja3") == F.col("other_ja3")) & (F.size(raw) == 3) & same_head & (F.substring_index("other_ja4", "_", -1) == underscored)
    compared = F.col("in_ours") & F.col("in_theirs")
    verdict = (
        F.when(F.col("in_theirs").isNull(), "only ours").when(F.col("in_ours").isNull(), "only theirs")
        .when((F.col("ja3") == F.col("other_ja3")) & (F.col("ja4") == F.col("other_ja4")), "match").when(known, "known difference").otherwise("unexplained")
    )
    return both.withColumn("compared", F.coalesce(compared, F.lit(False))).withColumn("verdict", verdict)


def fingerprint_summary(reconciled: DataFrame) -> DataFrame:
    hit = F.col("compared")
    return reconciled.agg(
        F.count("in_ours").alias("flows_ours"), F.count("in_theirs").alias("flows_theirs"), F.count_if(hit).alias("compared"),
        F.count_if(hit & (F.col("ja3") == F.col("other_ja3"))).alias("ja3_match"), F.count_if(hit & (F.col("ja4") == F.col("other_ja4"))).alias("ja4_match"),
        F.count_if(F.col("verdict") == "known difference").alias("known_difference"), F.count_if(F.col("verdict") == "unexplained").alias("unexplained"),
        F.countDistinct(F.when(hit, F.col("ja4"))).alias("distinct_ja4"),
    )


def arrival_check(cowrie: DataFrame, src: str, marker: str, started_at) -> DataFrame:
    """Whether a test login arrived complete, with its place of origin."""
    rows = time_slice(cowrie, plus_seconds(instant(started_at), -5.0), ts="timestamp").where(F.col("src_ip") == src)
    login = (F.col("eventid") == "cowrie.login.success") & (F.col("password") == marker)
    refused = (F.col("eventid") == "cowrie.login.failed") & (F.col("username") == "root") & F.col("password").isin("root", "123456")
    typed = F.col("input").contains(marker)
    return rows.agg(
        F.count_if(refused).alias("refused"), F.count_if(login).alias("accepted"), F.count_if((F.col("eventid") == "cowrie.command.input") & typed).alias("commands"),
        F.min(F.when(login, F.col("src_country_code"))).alias("country_code"), F.min(F.when(login, F.col("src_asn"))).alias("asn"),
        F.max(F.when((F.col("password") == marker) | typed, F.col("timestamp"))).alias("newest"),
    )


def arrivals(cowrie: DataFrame, keys: list[str]) -> DataFrame:
    """The same counts for every source and password in the table."""
    event = F.col("eventid")
    return cowrie.groupBy(*keys).agg(
        F.count_if(event == "cowrie.login.failed").alias("refused"), F.count_if(event == "cowrie.login.success").alias("accepted"),
        F.min(F.when(event == "cowrie.login.success", F.col("src_country_code"))).alias("country_code"), F.max("timestamp").alias("newest"),
    )


def absence_check(http: DataFrame, uri: str, src: str, since) -> DataFrame:
    """Matching requests seen by the sensor (expected: none, or some as positive control)."""
    rows = time_slice(http, plus_seconds(instant(since), -5.0)).where((F.col("uri") == uri) & (F.col("id_orig_h") == src))
    return rows.agg(F.count("*").alias("requests"))
