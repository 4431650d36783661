"""Raw log lines to typed rows. Every normaliser takes rows with a text column and returns accepted rows; what cannot be
used is available from ``rejects`` with the reason.

All parsing is ``from_json`` with a declared schema; nothing is inferred.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hawkspan import schemas

LOG_NAME = r"/(conn|dns|http|ssl|x509|notice)(\.[0-9-]+)?\.log(\.gz)?$"
# Fields of the sensor's logs whose names hold a dot where the table has an underscore.
DOTTED_PREFIXES = ("id", "certificate", "san", "basic_constraints")
# The pipeline metrics that are kept.
KEPT_METRICS = (
    "component_received_events_total", "component_sent_events_total", "component_errors_total", "component_discarded_events_total", "buffer_events",
    "buffer_byte_size", "utilization", "uptime_seconds",
)
EVE_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxx"
# Faults of sound lines that no table takes.
OTHER_EVENT, OTHER_METRIC = "other event type", "other metric"


def log_type_of(path: Column) -> Column:
    """Log type from a file name such as ``/logs/conn.2026-01-05-10-00-00.log``; '' when it is none."""
    return F.regexp_extract(path, LOG_NAME, 1)


def default_of(kind: str) -> Column | None:
    """The value an absent field of a type takes; None where NULL is kept."""
    if kind.startswith(("array", "map")):
        return F.expr(f"CAST({'map()' if kind.startswith('map') else 'array()'} AS {kind})")
    return {"string": F.lit(""), "boolean": F.lit(False), "double": F.lit(0.0), "timestamp": F.lit(0).cast("timestamp")}.get(kind, F.lit(0).cast(kind))


def fill_defaults(df: DataFrame, ddl: str, keep_null: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``ddl`` in order and type, absent or NULL ones with their default."""
    have = set(df.columns)
    out = []
    for field in schemas.struct(ddl):
        kind = field.dataType.simpleString()
        value = F.col(field.name).cast(field.dataType) if field.name in have else F.lit(None).cast(field.dataType)
        out.append((value if field.name in keep_null else F.coalesce(value, default_of(kind))).alias(field.name))
    return df.select(*out)


def _epoch(seconds: Column) -> Column:
    return F.timestamp_micros((seconds * 1000000).cast("long"))


def _raw_name(name: str) -> str:
    """Name of a table column in the log line."""
    for prefix in DOTTED_PREFIXES:
        if name.startswith(prefix + "_"):
            return f"{prefix}.{name[len(prefix) + 1:]}"
    return name


def parse_sensor_log(lines: DataFrame, log_type: str, text: str = "value") -> DataFrame:
    """Adds ``parsed`` (the typed fields) and ``fault`` (NULL when the line is usable)."""
    fields = []
    for field in schemas.struct(schemas.SENSOR_LOGS[log_type]):
        kind = "double" if field.dataType.simpleString() == "timestamp" else field.dataType.simpleString()
        raw = _raw_name(field.name)
        fields.append(f"`{raw}` {kind}")
        if raw != field.name:
            fields.append(f"`{field.name}` {kind}")
    parsed = F.from_json(F.col(text), ", ".join([*fields, "_broken string"]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = lines.withColumn("parsed", parsed)
    usable = F.col("parsed").isNotNull() & F.col("parsed._broken").isNull()
    return rows.withColumn("fault", F.when(~usable, "not a JSON object of this log").when(F.col("parsed.ts").isNull(), "no event time"))


def normalize_sensor_log(lines: DataFrame, log_type: str, text: str = "value") -> DataFrame:
    """Typed rows of one log type from its JSON lines (epoch seconds cut to microseconds)."""
    good = parse_sensor_log(lines, log_type, text).where(F.col("fault").isNull())
    out = []
    for field in schemas.struct(schemas.SENSOR_LOGS[log_type]):
        raw = _raw_name(field.name)
        value = F.col("parsed").getField(raw)
        if raw != field.name:
            value = F.coalesce(value, F.col("parsed").getField(field.name))
        out.append((_epoch(value) if field.dataType.simpleString() == "timestamp" else value).alias(field.name))
    rows = good.select(*out)
    if log_type == "conn":
        # The direction is judged before defaults: an absent flag means "ours".
        rows = label_direction(rows)
        return fill_defaults(rows, schemas.SENSOR_LOGS["conn"] + ", direction string, remote_ip string")
    return fill_defaults(rows, schemas.SENSOR_LOGS[log_type])


def label_direction(conn: DataFrame) -> DataFrame:
    """Adds ``direction`` and the far end ``remote_ip`` ('' for internal connections)."""
    ours, theirs = F.coalesce("local_orig", F.lit(True)), F.coalesce("local_resp", F.lit(True))
    return conn.withColumn("direction", F.when(~ours, "inbound").when(~theirs, "outbound").otherwise("internal")).withColumn(
        "remote_ip", F.when(~ours, F.coalesce("id_orig_h", F.lit(""))).when(~theirs, F.coalesce("id_resp_h", F.lit(""))).otherwise("")
    )


def rejects(parsed: DataFrame, text: str = "value") -> DataFrame:
    """Lines that could not be used, with the reason; sound lines of kinds no table takes are left out."""
    return parsed.where(F.col("fault").isNotNull() & ~F.col("fault").isin(OTHER_EVENT, OTHER_METRIC)).select(F.col(text).alias("line"), "fault")


def reject_counts(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy(F.coalesce("fault", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("lines"))


# Nested groups of the alert engine's events and the fields used of each.
_EVE_GROUPS = {
    "alert": "action string, gid bigint, signature_id bigint, rev bigint, signature string, category string, severity int,"
             " metadata struct<mitre_tactic_id: array<string>, mitre_technique_id: array<string>, nsm_id: array<string>>",
    "http": "hostname string, url string, http_method string, http_user_agent string, status int",
    "tls": "sni string, version string",
    "flow": "start string, pkts_toserver bigint, pkts_toclient bigint, bytes_toserver bigint, bytes_toclient bigint",
}
_EVE_FLAT = (
    "event_type string, timestamp string, flow_id decimal(20,0), community_id string, in_iface string, pkt_src string, src_ip string, src_port int, dest_ip string,"
    " dest_port int, proto string, ip_v int, app_proto string, direction string, tx_id bigint, capture_file string"
)


def _group(ddl: str) -> str:
    """``a int, b string`` as the inside of a struct type."""
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in schemas.struct(ddl))


def _stats_type() -> str:
    """The engine counters are nested by their underscore-free groups; only leaves the table has are read."""
    groups = {
        "uptime": "bigint", "capture": "kernel_packets kernel_drops errors", "decoder": "pkts bytes invalid", "flow": "active memuse memcap emerg_mode_entered",
        "tcp": "active_sessions memuse reassembly_memuse reassembly_gap midstream_pickups", "detect": "alert alerts_suppressed alert_queue_overflow",
        "pcap_log": "written",
    }
    parts = [f"{g}: bigint" if leaves == "bigint" else f"{g}: struct<{', '.join(f'{n}: bigint' for n in leaves.split())}>" for g, leaves in groups.items()]
    return f"struct<{', '.join([*parts, 'memcap_pressure: bigint', 'memcap_pressure_max: bigint'])}>"


def parse_engine_events(lines: DataFrame, text: str = "value") -> DataFrame:
    ddl = ", ".join([_EVE_FLAT, *[f"{g} struct<{_group(d)}>" for g, d in _EVE_GROUPS.items()], f"stats {_stats_type()}", "_broken string"])
    rows = lines.withColumn("parsed", F.from_json(F.col(text), ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    at = F.try_to_timestamp(F.col("parsed.timestamp"), F.lit(EVE_TIME))
    usable = F.col("parsed").isNotNull() & F.col("parsed._broken").isNull()
    return rows.withColumn("at", at).withColumn(
        "fault",
        F.when(~usable | F.col("parsed.event_type").isNull(), "not a JSON event").when(~F.col("parsed.event_type").isin("alert", "stats"), OTHER_EVENT).when(F.col("at").isNull(), "no event time"),
    )


def _parsed(lines: DataFrame, parse: Callable[[DataFrame, str], DataFrame], text: str) -> DataFrame:
    """Lines that a caller has parsed already are not parsed again."""
    return lines if "fault" in lines.columns else parse(lines, text)


def normalize_alerts(lines: DataFrame, text: str = "value") -> DataFrame:
    rows = _parsed(lines, parse_engine_events, text).where(F.col("fault").isNull() & (F.col("parsed.event_type") == "alert"))
    flat = [F.col(f"parsed.{f.name}").alias(f.name) for f in schemas.struct(_EVE_FLAT) if f.name not in ("event_type", "timestamp")]
    nested = []
    for group, ddl in _EVE_GROUPS.items():
        for field in schemas.struct(ddl):
            if field.name == "metadata":
                nested += [F.col(f"parsed.alert.metadata.{n}").alias(f"alert_metadata_{n}") for n in ("mitre_tactic_id", "mitre_technique_id", "nsm_id")]
            elif (group, field.name) == ("flow", "start"):
                nested.append(F.try_to_timestamp(F.col("parsed.flow.start"), F.lit(EVE_TIME)).alias("flow_start"))
            else:
                nested.append(F.col(f"parsed.{group}.{field.name}").alias(f"{group}_{field.name}"))
    return fill_defaults(rows.select(F.col("at").alias("timestamp"), *flat, *nested, F.col(text).alias("raw")), schemas.ALERT)


def normalize_stats(lines: DataFrame, text: str = "value") -> DataFrame:
    rows = _parsed(lines, parse_engine_events, text).where(F.col("fault").isNull() & (F.col("parsed.event_type") == "stats"))
    out = [F.col("at").alias("timestamp")]
    for field in schemas.struct(f"stats {_stats_type()}")[0].dataType:
        if field.dataType.typeName() == "struct":
            out += [F.col(f"parsed.stats.{field.name}.{leaf.name}").alias(f"stats_{field.name}_{leaf.name}") for leaf in field.dataType]
        else:
            out.append(F.col(f"parsed.stats.{field.name}").alias(f"stats_{field.name}"))
    return fill_defaults(rows.select(*out), schemas.STATS)


# Table column and the field of the honeypot's event it comes from.
_POT_FIELDS = {"client_version": "version"}


def parse_honeypot_events(lines: DataFrame, text: str = "value") -> DataFrame:
    """The honeypot is assumed compromised: every field is read as text and forced to its type, the rest is dropped."""
    names = [_POT_FIELDS.get(f.name, f.name) for f in schemas.struct(schemas.COWRIE) if f.name != "raw"]
    ddl = ", ".join([f"{n} string" for n in names] + ["_broken string"])
    rows = lines.withColumn("parsed", F.from_json(F.col(text), ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    at = F.try_to_timestamp(F.when(F.col("parsed.timestamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$"), F.col("parsed.timestamp")))
    usable = F.col("parsed").isNotNull() & F.col("parsed._broken").isNull()
    return rows.withColumn("at", at).withColumn(
        "fault",
        F.when(~usable | F.col("parsed.eventid").isNull(), "not a JSON event").when(~F.col("parsed.eventid").startswith("cowrie."), "foreign event").when(F.col("at").isNull(), "no event time"),
    )


def normalize_honeypot(lines: DataFrame, text: str = "value") -> DataFrame:
    good = _parsed(lines, parse_honeypot_events, text).where(F.col("fault").isNull())
    out = [F.col("at").alias("timestamp"), F.col(text).alias("raw")]
    for field in schemas.struct(schemas.COWRIE):
        if field.name in ("timestamp", "raw"):
            continue
        value = F.col(f"parsed.{_POT_FIELDS.get(field.name, field.name)}")
        out.append((value if field.dataType.simpleString() == "string" else value.try_cast(field.dataType)).alias(field.name))
    return fill_defaults(good.select(*out), schemas.COWRIE)


def parse_metrics(lines: DataFrame, text: str = "value") -> DataFrame:
    """Adds ``parsed`` and ``fault``; metrics that are not kept are no malformed lines but have a fault too."""
    ddl = "timestamp string, name string, namespace string, kind string, tags map<string,string>, counter struct<value: double>, gauge struct<value: double>, _broken string"
    rows = lines.withColumn("parsed", F.from_json(F.col(text), ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    m = F.col("parsed")
    usable = m.isNotNull() & m["_broken"].isNull() & m["name"].isNotNull()
    return rows.withColumn(
        "fault",
        F.when(~usable, "not a JSON metric").when(~m["name"].isin(*KEPT_METRICS), OTHER_METRIC).when(F.coalesce(m["counter"]["value"], m["gauge"]["value"]).isNull(), "no value"),
    )


def normalize_metrics(lines: DataFrame, arrived_at: Column, text: str = "value") -> DataFrame:
    """Counters and gauges of the kept metrics; ``arrived_at`` stands in where a metric carries no time."""
    m = F.col("parsed")
    value = F.coalesce(m["counter"]["value"], m["gauge"]["value"])
    return fill_defaults(
        _parsed(lines, parse_metrics, text).where(F.col("fault").isNull()).select(
            F.coalesce(F.try_to_timestamp(m["timestamp"]), arrived_at).alias("timestamp"), m["name"].alias("name"), m["namespace"].alias("namespace"),
            m["kind"].alias("kind"), m["tags"].alias("tags"), value.alias("value"),
        ), schemas.METRICS,
    )
