"""Declared table layouts. Fields are text the way Spark's DDL spells it; absent values get the type's default on load."""

from __future__ import annotations

from pyspark.sql import types as T

_ENDS = "ts timestamp, uid string, id_orig_h string, id_orig_p int, id_resp_h string, id_resp_p int"


def _prefixed(names: str, kind: str, prefix: str = "") -> str:
    return ", ".join(f"{prefix}{n} {kind}" for n in names.split())


SENSOR_LOGS: dict[str, str] = {
    "conn": (
        f"{_ENDS}, proto string, service string, duration double, orig_bytes bigint, resp_bytes bigint, conn_state string, local_orig boolean, local_resp boolean,"
        " missed_bytes bigint, history string, orig_pkts bigint, orig_ip_bytes bigint, resp_pkts bigint, resp_ip_bytes bigint, tunnel_parents array<string>,"
        " ip_proto bigint, community_id string"
    ),
    "dns": (
        f"{_ENDS}, proto string, trans_id bigint, rtt double, query string, qclass bigint, qclass_name string, qtype bigint, qtype_name string, rcode bigint,"
        " rcode_name string, AA boolean, TC boolean, RD boolean, RA boolean, Z bigint, answers array<string>, TTLs array<double>, rejected boolean"
    ),
    "http": (
        f"{_ENDS}, trans_depth bigint, method string, host string, uri string, referrer string, version string, user_agent string, origin string,"
        " request_body_len bigint, response_body_len bigint, status_code bigint, status_msg string, info_code bigint, info_msg string, "
        + _prefixed("tags proxied orig_fuids orig_filenames orig_mime_types resp_fuids resp_filenames resp_mime_types", "array<string>")
    ),
    "ssl": (
        f"{_ENDS}, version string, cipher string, curve string, server_name string, resumed boolean, last_alert string, next_protocol string, established boolean,"
        " ssl_history string, cert_chain_fps array<string>, client_cert_chain_fps array<string>, subject string, issuer string, client_subject string,"
        " client_issuer string, sni_matches_cert boolean, validation_status string, ja3 string, ja4 string"
    ),
    "x509": (
        "ts timestamp, fingerprint string, certificate_version bigint, certificate_serial string, certificate_subject string, certificate_issuer string,"
        " certificate_not_valid_before timestamp, certificate_not_valid_after timestamp, certificate_key_alg string, certificate_sig_alg string,"
        " certificate_key_type string, certificate_key_length bigint, certificate_exponent string, certificate_curve string, san_dns array<string>,"
        " san_uri array<string>, san_email array<string>, san_ip array<string>, basic_constraints_ca boolean, basic_constraints_path_len bigint,"
        " host_cert boolean, client_cert boolean"
    ),
    "notice": (
        f"{_ENDS}, fuid string, file_mime_type string, file_desc string, proto string, note string, msg string, sub string, src string, dst string, p int,"
        " n bigint, peer_descr string, actions array<string>, suppress_for double"
    ),
}

ALERT = (
    "timestamp timestamp, flow_id decimal(20,0), community_id string, in_iface string, pkt_src string, src_ip string, src_port int, dest_ip string, dest_port int,"
    " proto string, ip_v int, app_proto string, direction string, tx_id bigint, alert_action string, alert_gid bigint, alert_signature_id bigint, alert_rev bigint,"
    " alert_signature string, alert_category string, alert_severity int, alert_metadata_mitre_tactic_id array<string>, alert_metadata_mitre_technique_id array<string>,"
    " alert_metadata_nsm_id array<string>, http_hostname string, http_url string, http_http_method string, http_http_user_agent string, http_status int, tls_sni string,"
    " tls_version string, flow_start timestamp, flow_pkts_toserver bigint, flow_pkts_toclient bigint, flow_bytes_toserver bigint, flow_bytes_toclient bigint,"
    " capture_file string, raw string"
)
STATS = "timestamp timestamp, " + _prefixed(
    "uptime capture_kernel_packets capture_kernel_drops capture_errors decoder_pkts decoder_bytes decoder_invalid flow_active flow_memuse flow_memcap"
    " flow_emerg_mode_entered tcp_active_sessions tcp_memuse tcp_reassembly_memuse tcp_reassembly_gap tcp_midstream_pickups detect_alert"
    " detect_alerts_suppressed detect_alert_queue_overflow pcap_log_written memcap_pressure memcap_pressure_max", "bigint", "stats_",
)
COWRIE = (
    "timestamp timestamp, eventid string, sensor string, session string, protocol string, src_ip string, src_port int, dst_ip string, dst_port int, username string,"
    " password string, input string, client_version string, hassh string, duration_ms bigint, url string, shasum string, message string, raw string"
)
METRICS = "timestamp timestamp, name string, namespace string, kind string, tags map<string,string>, value double"

STATE: dict[str, str] = {
    "allowlist": "id string, detection_id string, match_type string, value string, reason string, expires_at timestamp, enabled boolean",
    "lab_addresses": "address string, role string, note string, added timestamp",
    "validation_runs": (
        "run_id string, case_name string, pcap string, pcap_sha256 string, attack_technique string, primary_sid bigint, started_at timestamp, expected_sids array<bigint>,"
        " detected_sids array<bigint>, missing_sids array<bigint>, unexpected_sids array<bigint>, first_alert_at timestamp, mttd_ms bigint, visible_ms bigint,"
        " result string, ruleset_sha256 string, rules_loaded bigint"
    ),
    "actions": (
        "created_at timestamp, action string, ip string, trigger string, rule string, reason string, evidence_at timestamp, expires_at timestamp, mode string,"
        " actor string, detail string"
    ),
    "applies": "applied_at timestamp, firewall string, mode string, result string, ranges array<string>, added array<string>, removed array<string>, duration_ms bigint, error string",
    "runs": "run_id string, run_at timestamp, window_start timestamp, window_end timestamp, detection_id string, result string, hits bigint, duration_ms bigint, backfill boolean, error string",
    "hits": (
        "run_id string, run_at timestamp, window_start timestamp, window_end timestamp, detection_id string, severity string, src string, dst string, dst_port int,"
        " first_seen timestamp, last_seen timestamp, score double, summary string, details string, hit_key string"
    ),
    "verdicts": "created_at timestamp, source string, subject string, verdict string, analyst string, tune_id string, note string",
    "coverage": "technique_id string, name string, tactic string, in_target boolean, status string, detections array<string>, observed_by array<string>, updated_at timestamp",
}

# Tables whose rows tell where an address lies: the column of the address, and the prefix of the columns about it.
LOCATED = {"conn": ("remote_ip", "remote_"), "alert": ("src_ip", "src_"), "cowrie": ("src_ip", "src_")}
GEO_TABLES = {"geo_countries": "lo string, hi string, country_code string, country string", "geo_networks": "lo string, hi string, asn bigint, as_org string"}


def geo(prefix: str) -> str:
    return f"{prefix}country_code string, {prefix}country string, {prefix}as_org string, {prefix}asn bigint"


def stored(table: str) -> str:
    """The columns of an event table as ingest stores them."""
    ddl = {**SENSOR_LOGS, "conn": f"{SENSOR_LOGS['conn']}, direction string, remote_ip string", "alert": ALERT, "stats": STATS, "cowrie": COWRIE, "metrics": METRICS}[table]
    ddl = f"{ddl}, loaded_at timestamp" if table == "alert" else ddl
    return f"{ddl}, {geo(LOCATED[table][1])}" if table in LOCATED else ddl


# Days each event table is kept.
RETENTION_DAYS = {
    **{name: 30 for name in SENSOR_LOGS}, "alert": 90, "stats": 90, "cowrie": 90, "metrics": 7, "runs": 180, "hits": 180,
}


def struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def event_time(name: str) -> str:
    return "ts" if name in SENSOR_LOGS else "timestamp"
