"""Reviewed exceptions: loading, checking, and leaving excepted rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hawkspan.functions.net import cidr_bounds, ip_key
from hawkspan.functions.text import dot_suffixes, present
from hawkspan.functions.times import instant
from hawkspan.operators.ipjoin import covered_addresses, distinct_network_blocks

COLUMNS = ("id", "detection_id", "match_type", "value", "reason", "expires_at", "enabled")


class RejectedRows(ValueError):
    """A reference file that failed its checks; nothing of it is used."""


def check_entries(raw: DataFrame, known_detections: list[str]) -> DataFrame:
    """Text rows plus ``errors``, the list of everything wrong with the row (empty when it is fine)."""
    value, kind = F.col("value"), F.col("match_type")
    bounds = cidr_bounds("value")
    expires = F.try_to_timestamp(F.col("expires_at"), F.lit("yyyy-MM-dd HH:mm:ss"))
    same = raw.groupBy("id", "detection_id", "match_type", "value").agg(F.count("*").alias("copies"))

    def fault(condition: Column, text: str) -> Column:
        return F.when(F.coalesce(condition, F.lit(True)), F.lit(text))

    checked = raw.join(same, ["id", "detection_id", "match_type", "value"], "left")
    return checked.withColumn(
        "errors",
        present(
            fault(~F.col("id").rlike(r"^TUNE-\d{3}(-TEST)?$"), "id"),
            fault(~F.col("detection_id").isin(*known_detections, "*"), "detection_id"),
            fault((F.trim(value) == "") | (F.trim("reason") == ""), "empty value or reason"),
            F.when(~kind.isin("dst_ip", "dst_cidr", "sni", "sni_suffix"), F.lit("match_type")),
            F.when(kind == "dst_ip", fault(ip_key("value").isNull(), "address")),
            F.when(kind == "dst_cidr", fault(bounds.isNull() | bounds["host_bits"], "network")),
            F.when(kind == "sni", fault(~value.rlike(r"^[a-z0-9.-]+\.[a-z0-9-]+$"), "server name")),
            F.when(kind == "sni_suffix", fault(~value.rlike(r"^\.[a-z0-9.-]+\.[a-z0-9-]+$"), "server name suffix")),
            fault(expires.isNull() | (F.date_format(expires, "yyyy-MM-dd HH:mm:ss") != F.col("expires_at")), "expires_at"),
            fault(~F.col("enabled").isin("true", "false"), "enabled"),
            fault(F.coalesce(F.col("copies"), F.lit(1)) > 1, "duplicate"),
        ),
    ).drop("copies")


def typed_entries(checked: DataFrame) -> DataFrame:
    """The checked text rows as a typed table; raises when any row is faulty (all or nothing)."""
    faulty = checked.where(F.size("errors") > 0)
    shown = faulty.orderBy("id", "detection_id", "match_type", "value").limit(20).collect()
    if shown:
        raise RejectedRows("; ".join(f"{r['id']} {r['value']}: {', '.join(r['errors'])}" for r in shown))
    return checked.select(
        "id", "detection_id", "match_type", "value", "reason", F.to_timestamp("expires_at").alias("expires_at"),
        (F.col("enabled") == "true").alias("enabled"),
    )


def summary(allowlist: DataFrame, as_of) -> DataFrame:
    """Entries and active entries per detection and match type."""
    active = F.col("enabled") & (F.col("expires_at") > instant(as_of))
    return allowlist.groupBy("detection_id", "match_type").agg(F.count("*").alias("entries"), F.count_if(active).alias("active"))


def active_entries(allowlist: DataFrame, detection_id: str, as_of) -> DataFrame:
    return allowlist.where(
        F.col("enabled") & (F.col("expires_at") > instant(as_of)) & F.col("detection_id").isin(detection_id, "*")
    ).select("match_type", "value")


def excepted_names(names: DataFrame, name: str, entries: DataFrame) -> DataFrame:
    """Distinct server names that an exact or a suffix entry covers, as ``name``."""
    distinct = names.select(F.col(name).alias("name")).where(F.col("name") != "").distinct()
    forms = F.concat(
        F.array(F.struct(F.lit("sni").alias("match_type"), F.col("name").alias("value"))),
        F.transform(dot_suffixes("name"), lambda s: F.struct(F.lit("sni_suffix").alias("match_type"), s.alias("value"))),
    )
    spelled = distinct.select("name", F.inline(forms))
    return spelled.join(entries, ["match_type", "value"], "left_semi").select("name").distinct()


def without_excepted_addresses(rows: DataFrame, ip: str, entries: DataFrame) -> DataFrame:
    """Rows whose address no address or network entry covers. Reads the rows twice: the test parses each distinct address once."""
    blocks = distinct_network_blocks(entries.where(F.col("match_type").isin("dst_ip", "dst_cidr")), "value")
    covered = covered_addresses(rows, ip, blocks)
    return rows.join(covered, rows[ip] == covered["addr"], "left_anti")


def without_excepted_names(rows: DataFrame, name: str, entries: DataFrame) -> DataFrame:
    """Rows whose own server name no entry covers."""
    covered = excepted_names(rows, name, entries)
    return rows.join(covered, rows[name] == covered["name"], "left_anti")


def without_excepted_connections(rows: DataFrame, ssl: DataFrame, entries: DataFrame) -> DataFrame:
    """Connections (``uid``) without those whose server name an entry covers.

    A connection has one name: the smallest, where it logged several. Only excepted connections enter the join.
    """
    names = ssl.where(F.col("server_name") != "").groupBy("uid").agg(F.min("server_name").alias("server_name"))
    covered = excepted_names(ssl, "server_name", entries)
    uids = names.join(covered, names["server_name"] == covered["name"], "left_semi").select("uid")
    return rows.join(uids, "uid", "left_anti")
