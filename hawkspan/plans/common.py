"""Small pieces the report plans share. A span is a ``(start, end)`` pair; ``step`` is a bucket width in seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hawkspan.functions.times import bucket_start, time_slice

PRODUCTION_IFACE = "ens4"  # fixed value: the interface production traffic is captured on


def within(df: DataFrame, span, ts: str = "ts") -> DataFrame:
    return time_slice(df, span[0], span[1], ts)


def outbound() -> Column:
    return F.col("local_orig") & ~F.col("local_resp")


def production_alerts(t, span, iface: str = PRODUCTION_IFACE) -> DataFrame:
    return within(t["alert"], span, "timestamp").where(F.col("in_iface") == iface)


def top(df: DataFrame, k: int, *order) -> DataFrame:
    """The first ``k`` rows; pass enough columns to make the order total."""
    return df.orderBy(*order).limit(k)


def per_step(df: DataFrame, ts: str, step: int, *groups) -> DataFrame:
    """Grouped by time bucket and the given columns, ready for ``agg``."""
    return df.groupBy(bucket_start(F.col(ts), step).alias("time"), *groups)


def total(df: DataFrame, alias: str) -> DataFrame:
    return df.agg(F.count("*").alias(alias))


def distinct_total(df: DataFrame, column, alias: str) -> DataFrame:
    return df.agg(F.countDistinct(column).alias(alias))


def pair_of_alert() -> Column:
    """Unit of triage: signature and source."""
    return F.concat(F.col("alert_signature_id").cast("string"), F.lit("|"), F.col("src_ip"))


def latest_verdicts(t, source: str) -> DataFrame:
    """Newest verdict per subject (``subject, verdict``)."""
    rows = t["verdicts"].where(F.col("source") == source)
    return rows.groupBy("subject").agg(F.max_by("verdict", F.struct("created_at", "verdict")).alias("verdict"))


def latest_run(t) -> Column:
    """Time of the newest scheduled run, as a scalar subquery."""
    return t["runs"].where(~F.col("backfill")).agg(F.max("run_at").alias("run_at")).scalar()


def lab(t, role: str | None = None) -> DataFrame:
    rows = t["lab_addresses"] if role is None else t["lab_addresses"].where(F.col("role") == role)
    return rows.select("address").distinct()


def excluding(df: DataFrame, ip: str, addresses: DataFrame) -> DataFrame:
    return df.join(addresses, df[ip] == addresses["address"], "left_anti")

