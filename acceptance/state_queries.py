"""Normalisation, enrichment, stored findings, verdicts, response decisions, evaluation and streaming."""

from __future__ import annotations

from acceptance.catalog import ALL_TIME, AS_OF, query
from acceptance.detection_queries import scan_sql, v4
from acceptance.report_queries import ACTIVE, NOW, STANDING, verdicts
from hawkspan.functions.net import NOT_GLOBAL_V4, network_bounds
from hawkspan.functions.tls import tls_fingerprints
from hawkspan.operators import allowlist
from hawkspan.operators.ipjoin import geo_enrich, lookup_ranges
from hawkspan.plans import detections as det
from hawkspan.plans import evaluate, findings, response
from hawkspan.sources import normalize, reference, tables
from pyspark.sql import functions as F

START, END = ALL_TIME
DETECTION_IDS = [f"DET-10{i}" for i in range(1, 10)]


def js(path: str) -> str:
    return f"json_extract_string(j, '$.{path}')"


def lines(view: str) -> str:
    return f"(SELECT value, CASE WHEN json_valid(value) THEN value END AS j FROM {view})"


# --- normalisation ---------------------------------------------------------------------------------------------------

FLAG = "coalesce(CAST({} AS BOOLEAN), {})"
ORIG, RESP = FLAG.format(js("local_orig"), "true"), FLAG.format(js("local_resp"), "true")
CONN_ROWS = f"""SELECT make_timestamp(CAST(floor(CAST({js('ts')} AS DOUBLE) * 1000000) AS BIGINT)) AS ts, {js('uid')} AS uid, {js('"id.orig_h"')} AS id_orig_h, CAST({js('"id.orig_p"')} AS INT) AS id_orig_p,
    {js('"id.resp_h"')} AS id_resp_h, CAST({js('"id.resp_p"')} AS INT) AS id_resp_p, '' AS service, coalesce(CAST({js('orig_bytes')} AS BIGINT), 0) AS orig_bytes, {FLAG.format(js('local_orig'), 'false')} AS local_orig,
    {FLAG.format(js('local_resp'), 'false')} AS local_resp, CASE WHEN NOT {ORIG} THEN 'inbound' WHEN NOT {RESP} THEN 'outbound' ELSE 'internal' END AS direction,
    CASE WHEN NOT {ORIG} THEN {js('"id.orig_h"')} WHEN NOT {RESP} THEN {js('"id.resp_h"')} ELSE '' END AS remote_ip FROM {lines('raw_conn')} WHERE j IS NOT NULL AND {js('ts')} IS NOT NULL"""
query("norm_zeek", "ts t, uid s, id_orig_h s, id_orig_p i, id_resp_h s, id_resp_p i, service s, orig_bytes i, local_orig b, local_resp b, direction s, remote_ip s", CONN_ROWS)(lambda t: normalize.normalize_sensor_log(t["raw_conn"], "conn"))
query(
    "norm_rejects", "outcome s, lines i",
    f"SELECT CASE WHEN j IS NULL THEN 'not a JSON object of this log' WHEN {js('ts')} IS NULL THEN 'no event time' ELSE 'accepted' END AS outcome, count(*) AS lines FROM {lines('raw_conn')} GROUP BY outcome",
)(lambda t: normalize.reject_counts(normalize.parse_sensor_log(t["raw_conn"], "conn")))
EVE_AT = f"CAST(replace(substr({{}}, 1, 26), 'T', ' ') AS TIMESTAMP)"
query(
    "norm_eve", "timestamp t, src_ip s, dest_ip s, dest_port i, in_iface s, alert_signature_id i, alert_signature s, alert_severity i, alert_metadata_mitre_technique_id a, flow_start t, flow_bytes_toserver i, http_url s, raw s",
    f"""SELECT {EVE_AT.format(js('timestamp'))} AS timestamp, {js('src_ip')} AS src_ip, {js('dest_ip')} AS dest_ip, CAST({js('dest_port')} AS INT) AS dest_port, {js('in_iface')} AS in_iface, CAST({js('alert.signature_id')} AS BIGINT) AS alert_signature_id,
    {js('alert.signature')} AS alert_signature, CAST({js('alert.severity')} AS INT) AS alert_severity, CAST(json_extract(j, '$.alert.metadata.mitre_technique_id') AS VARCHAR[]) AS alert_metadata_mitre_technique_id, {EVE_AT.format(js('flow.start'))} AS flow_start,
    CAST({js('flow.bytes_toserver')} AS BIGINT) AS flow_bytes_toserver, '' AS http_url, value AS raw FROM {lines('raw_eve')} WHERE {js('event_type')} = 'alert'""",
)(lambda t: normalize.normalize_alerts(t["raw_eve"]))
query(
    "norm_cowrie", "timestamp t, eventid s, src_ip s, src_port i, username s, password s, client_version s, duration_ms i, raw s",
    f"SELECT {EVE_AT.format(js('timestamp'))} AS timestamp, {js('eventid')} AS eventid, {js('src_ip')} AS src_ip, CAST({js('src_port')} AS INT) AS src_port, {js('username')} AS username, '' AS password, {js('version')} AS client_version, 0 AS duration_ms, value AS raw FROM {lines('raw_cowrie')} WHERE {js('eventid')} LIKE 'cowrie.%'",
)(lambda t: normalize.normalize_honeypot(t["raw_cowrie"]))
KEPT = ", ".join(f"'{n}'" for n in normalize.KEPT_METRICS)
query(
    "norm_metrics", "timestamp t, name s, namespace s, value d",
    f"SELECT {EVE_AT.format(js('timestamp'))} AS timestamp, {js('name')} AS name, '' AS namespace, CAST(coalesce({js('counter.value')}, {js('gauge.value')}) AS DOUBLE) AS value FROM {lines('raw_metrics')} WHERE {js('name')} IN ({KEPT}) AND coalesce({js('counter.value')}, {js('gauge.value')}) IS NOT NULL",
)(lambda t: normalize.normalize_metrics(t["raw_metrics"], F.current_timestamp()))
query(
    "norm_rejects_eve", "outcome s, lines i",
    f"SELECT CASE WHEN {js('event_type')} IS NULL THEN 'not a JSON event' WHEN {js('event_type')} NOT IN ('alert', 'stats') THEN 'other event type' WHEN {js('timestamp')} IS NULL THEN 'no event time' ELSE 'accepted' END AS outcome, count(*) AS lines FROM {lines('raw_eve')} GROUP BY outcome",
)(lambda t: normalize.reject_counts(normalize.parse_engine_events(t["raw_eve"])))
query(
    "norm_rejects_cowrie", "outcome s, lines i",
    f"SELECT CASE WHEN {js('eventid')} IS NULL THEN 'not a JSON event' WHEN {js('eventid')} NOT LIKE 'cowrie.%' THEN 'foreign event' WHEN {js('timestamp')} IS NULL THEN 'no event time' ELSE 'accepted' END AS outcome, count(*) AS lines FROM {lines('raw_cowrie')} GROUP BY outcome",
)(lambda t: normalize.reject_counts(normalize.parse_honeypot_events(t["raw_cowrie"])))
query(
    "norm_rejects_metrics", "outcome s, lines i",
    f"SELECT CASE WHEN {js('name')} IS NULL THEN 'not a JSON metric' WHEN {js('name')} NOT IN ({KEPT}) THEN 'other metric' WHEN coalesce({js('counter.value')}, {js('gauge.value')}) IS NULL THEN 'no value' ELSE 'accepted' END AS outcome, count(*) AS lines FROM {lines('raw_metrics')} GROUP BY outcome",
)(lambda t: normalize.reject_counts(normalize.parse_metrics(t["raw_metrics"])))
WAY = "CASE WHEN NOT local_orig THEN 'inbound' WHEN NOT local_resp THEN 'outbound' ELSE 'internal' END"
query("label_direction", "uid s, direction s, remote_ip s", f"SELECT uid, {WAY} AS direction, CASE WHEN NOT local_orig THEN id_orig_h WHEN NOT local_resp THEN id_resp_h ELSE '' END AS remote_ip FROM conn")(lambda t: normalize.label_direction(t["conn"]))
query(
    "geo_enrich", "session s, eventid s, src_ip s, src_country_code s, src_country s, src_asn i, src_as_org s",
    """SELECT session, eventid, src_ip, coalesce(c.country_code, '') AS src_country_code, coalesce(c.country, '') AS src_country, coalesce(n.asn, 0) AS src_asn, coalesce(n.as_org, '') AS src_as_org FROM cowrie e
    LEFT JOIN countries c ON CAST(split_part(src_ip, '.', 1) AS INT) = c.a1 AND CAST(split_part(src_ip, '.', 2) AS INT) = c.a2
    LEFT JOIN networks n ON CAST(split_part(src_ip, '.', 1) AS INT) = n.a1 AND CAST(split_part(src_ip, '.', 2) AS INT) = n.a2 AND CAST(split_part(src_ip, '.', 3) AS INT) = 7 AND CAST(split_part(src_ip, '.', 4) AS INT) <= 99""",
)(lambda t: geo_enrich(t["cowrie"].drop("src_country_code", "src_country", "src_asn", "src_as_org"), "src_ip", t["countries"], t["networks"], "src_"))


query(
    "geo_lookup_v6", "addr s, asn i",
    """WITH n AS (SELECT DISTINCT block, upper, asn FROM v6_ranges) SELECT DISTINCT ip AS addr, coalesce(u.asn, l.asn) AS asn FROM v6_hosts h
    LEFT JOIN n u ON u.upper AND h.upper AND u.block = h.block LEFT JOIN n l ON NOT l.upper AND l.block = h.block WHERE known AND (u.asn IS NOT NULL OR l.asn IS NOT NULL)""",
)(lambda t: lookup_ranges(t["v6_hosts"], "ip", t["v6_ranges"], ["asn"]))


def codes(column: str) -> str:
    return f"list_filter({column}, lambda x: NOT (x // 256 = x % 256 AND x % 16 = 10))"


def hex4(values: str) -> str:
    return f"array_to_string(list_transform({values}, lambda x: lpad(lower(to_hex(x)), 4, '0')), ',')"


def dec(values: str) -> str:
    return f"array_to_string(list_transform({values}, lambda x: CAST(x AS VARCHAR)), '-')"


TLS_SQL = f"""WITH first_ AS (SELECT *, {codes('ciphers')} AS cs, {codes('extensions')} AS es, {codes('sig_algs')} AS sa, {codes('supported_versions')} AS sv FROM hello QUALIFY row_number() OVER (PARTITION BY uid ORDER BY seq) = 1),
    parts AS (SELECT uid, md5(version || ',' || {dec('cs')} || ',' || {dec('es')} || ',' || {dec(codes('curves'))} || ',' || {dec(codes('point_formats'))}) AS ja3,
      't' || CASE list_max(sv) WHEN 772 THEN '13' WHEN 771 THEN '12' ELSE '00' END || CASE WHEN list_contains(es, 0) THEN 'd' ELSE 'i' END || lpad(CAST(len(cs) AS VARCHAR), 2, '0') || lpad(CAST(len(es) AS VARCHAR), 2, '0')
        || CASE WHEN alpn = '' THEN '00' WHEN alpn = '-x-' THEN '2d' ELSE alpn[1] || alpn[-1] END AS a,
      {hex4('list_sort(cs)')} AS b, {hex4('list_sort(list_filter(es, lambda x: x <> 0 AND x <> 16))')} || '_' || {hex4('sa')} AS c FROM first_)
    SELECT uid, ja3, a || '_' || substr(sha256(b), 1, 12) || '_' || substr(sha256(c), 1, 12) AS ja4, a || '_' || b || '_' || c AS ja4_r FROM parts"""
query("tls_fingerprints", "uid s, ja3 s, ja4 s, ja4_r s", TLS_SQL)(lambda t: tls_fingerprints(t["hello"]))

# --- reference files, findings, verdicts -----------------------------------------------------------------------------

OCTETS_OK = "(list_max(list_transform(string_split(split_part(value, '/', 1), '.'), lambda x: CAST(x AS INT))) <= 255)"
query(
    "allowlist_checked", "id s, detection_id s, match_type s, value s, errors a",
    f"""SELECT id, detection_id, match_type, value, list_filter([
      CASE WHEN NOT regexp_full_match(id, 'TUNE-[0-9]{{3}}(-TEST)?') THEN 'id' END, CASE WHEN detection_id NOT IN ({', '.join(f"'{d}'" for d in DETECTION_IDS)}, '*') THEN 'detection_id' END,
      CASE WHEN trim(value) = '' OR trim(reason) = '' THEN 'empty value or reason' END, CASE WHEN match_type NOT IN ('dst_ip', 'dst_cidr', 'sni', 'sni_suffix') THEN 'match_type' END,
      CASE WHEN match_type = 'dst_ip' AND NOT (regexp_full_match(value, '[0-9.]+') AND {OCTETS_OK}) THEN 'address' END, CASE WHEN match_type = 'dst_cidr' AND NOT {OCTETS_OK} THEN 'network' END,
      CASE WHEN match_type = 'sni' AND NOT regexp_full_match(value, '[a-z0-9.-]+[.][a-z0-9-]+') THEN 'server name' END, CASE WHEN match_type = 'sni_suffix' AND NOT regexp_full_match(value, '[.][a-z0-9.-]+[.][a-z0-9-]+') THEN 'server name suffix' END,
      CASE WHEN try_cast(expires_at AS TIMESTAMP) IS NULL THEN 'expires_at' END, CASE WHEN enabled NOT IN ('true', 'false') THEN 'enabled' END,
      CASE WHEN count(*) OVER (PARTITION BY id, detection_id, match_type, value) > 1 THEN 'duplicate' END], lambda x: x IS NOT NULL) AS errors FROM (SELECT *, CASE WHEN match_type LIKE 'dst%' THEN value ELSE '0.0.0.0' END AS v FROM allow_text)""".replace("split_part(value, '/', 1), '.')", "split_part(v, '/', 1), '.')"),
)(lambda t: allowlist.check_entries(t["allow_text"], DETECTION_IDS))
query("allowlist_summary", "detection_id s, match_type s, entries i, active i", f"SELECT detection_id, match_type, count(*) AS entries, count(*) FILTER (WHERE enabled AND expires_at > {NOW}) AS active FROM allowlist GROUP BY ALL")(lambda t: allowlist.summary(t["allowlist"], AS_OF))
query(
    "hits", "detection_id s, src s, dst s, dst_port i, score d, hit_key s, targets i",
    f"SELECT detection_id, src, dst, dst_port, score, detection_id || '|' || src || '|' || dst || '|' || dst_port AS hit_key, targets FROM ({{}})".format(scan_sql().strip()),
)(lambda t: findings.to_hits(det.scanning(t, START, END, AS_OF)).withColumn("targets", F.get_json_object("details", "$.targets")))
query("verdict_list", "source s, subject s, verdict s, tune s, analyst s, decided t, note s", "SELECT source, subject, v.verdict, v.tune_id AS tune, v.analyst, decided, v.note FROM (SELECT source, subject, max_by(struct_pack(verdict := verdict, tune_id := tune_id, analyst := analyst, note := note), (created_at, verdict, note)) AS v, max(created_at) AS decided FROM verdicts GROUP BY source, subject)")(findings.verdict_list)
query(
    "verdict_errors", "errors a, n i",
    """WITH c AS (SELECT list_filter([CASE WHEN source NOT IN ('suricata', 'detection') THEN 'source' END, CASE WHEN source = 'suricata' AND NOT regexp_full_match(subject, '[0-9]+[|][0-9A-Fa-f.:]+') THEN 'subject' END,
    CASE WHEN source = 'detection' AND NOT regexp_full_match(subject, 'DET-[0-9]{3}[|][^|]*[|][^|]*[|][0-9]+') THEN 'subject' END, CASE WHEN verdict NOT IN ('true_positive', 'false_positive') THEN 'verdict' END,
    CASE WHEN NOT regexp_full_match(tune_id, '(-|TUNE-[0-9]{3})?') THEN 'tune_id' END, CASE WHEN note = '' THEN 'note' END], lambda x: x IS NOT NULL) AS errors FROM verdict_text) SELECT errors, count(*) AS n FROM c GROUP BY errors""",
)(lambda t: findings.check_verdicts(t["verdict_text"]).groupBy("errors").agg(F.count("*").alias("n")))
COVERED = lambda ip: f"(CASE WHEN r.ip LIKE '%/%' THEN ({v4(ip)} >> (32 - CAST(split_part(r.ip, '/', 2) AS INT))) = ({v4('split_part(r.ip, $$/$$, 1)')} >> (32 - CAST(split_part(r.ip, '/', 2) AS INT))) ELSE r.ip = {ip} END)"
query(
    "suppress_alerts", "community_id s, alert_signature_id i, src_ip s, dest_ip s",
    f"""SELECT community_id, alert_signature_id, src_ip, dest_ip FROM alert a WHERE NOT EXISTS (SELECT 1 FROM suppress_rules r WHERE r.sid = a.alert_signature_id AND r.gid = a.alert_gid
    AND ((r.track IN ('by_src', 'by_either') AND {COVERED('a.src_ip')}) OR (r.track IN ('by_dst', 'by_either') AND {COVERED('a.dest_ip')})))""",
)(lambda t: findings.suppress_alerts(t["alert"], t["suppress_rules"]))
CATALOGUE = "SELECT regexp_extract(value, '^[|] (DET-[0-9]+)', 1) AS id, list_sort(list_distinct(regexp_extract_all(split_part(value, ' | ', 4), 'T[0-9]{4}([.][0-9]{3})?'))) AS techniques, value LIKE '%| Validated%' AS validated FROM catalog_text WHERE value LIKE '| DET%'"
query("catalogue_rows", "id s, techniques a, validated b", CATALOGUE)(lambda t: reference.catalogue_rows(t["catalog_text"]))
OBSERVED = f"""(SELECT technique, 'suricata' AS seen_by, count(DISTINCT src_ip) AS sources FROM (SELECT unnest(alert_metadata_mitre_technique_id) AS technique, src_ip, alert_signature_id || '|' || src_ip AS subject FROM alert WHERE in_iface = 'ens4' AND timestamp > {NOW} - INTERVAL 30 DAY)
    WHERE subject NOT IN (SELECT subject FROM {verdicts('suricata')} WHERE verdict = 'false_positive') GROUP BY technique
    UNION ALL SELECT CASE WHEN eventid LIKE 'cowrie.login%' THEN 'T1110.001' WHEN eventid = 'cowrie.command.input' THEN 'T1059.004' ELSE 'T1105' END, 'honeypot', count(DISTINCT src_ip) FROM cowrie
    WHERE timestamp > {NOW} - INTERVAL 30 DAY AND (eventid LIKE 'cowrie.login.%' OR eventid = 'cowrie.command.input' OR eventid LIKE 'cowrie.session.file%') GROUP BY 1)"""
query("observed_techniques", "technique s, seen_by s, sources i", f"SELECT * FROM {OBSERVED}")(lambda t: findings.observed_techniques(t, AS_OF))
COVERAGE = f"""WITH cat AS ({CATALOGUE}), known AS (SELECT technique_id, list_sort(list_distinct(list(id) FILTER (WHERE validated))) AS d FROM (SELECT id, validated, unnest(techniques) AS technique_id FROM cat) GROUP BY technique_id),
    seen AS (SELECT technique AS technique_id, list_reverse_sort(list(seen_by || ' (' || sources || ' sources)')) AS o FROM {OBSERVED} GROUP BY technique),
    every_ AS (SELECT technique_id, coalesce(name, '') AS name, coalesce(tactic, '') AS tactic, targets.technique_id IS NOT NULL AS in_target, coalesce(d, []) AS detections, coalesce(o, []) AS observed_by FROM targets FULL JOIN known USING (technique_id) FULL JOIN seen USING (technique_id)),
    covered AS (SELECT *, CASE WHEN len(detections) > 0 THEN 'validated' WHEN len(observed_by) > 0 THEN 'observed' ELSE 'gap' END AS status FROM every_)"""


def coverage(t):
    return findings.attack_coverage(reference.catalogue_rows(t["catalog_text"]), t["targets"], findings.observed_techniques(t, AS_OF))


query("attack_coverage", "technique_id s, name s, tactic s, in_target b, status s, detections a, observed_by a", f"{COVERAGE} SELECT technique_id, name, tactic, in_target, status, detections, observed_by FROM covered")(coverage)
query(
    "layer_rows", "techniqueID s, score i, comment s",
    f"""{COVERAGE} SELECT technique_id AS techniqueID, CASE status WHEN 'validated' THEN 2 WHEN 'observed' THEN 1 ELSE 0 END AS score,
    array_to_string(list_filter([CASE WHEN len(detections) > 0 THEN 'validated by ' || array_to_string(detections, ', ') END, CASE WHEN len(observed_by) > 0 THEN 'observed: ' || array_to_string(observed_by, ', ') END,
    CASE WHEN status = 'gap' THEN 'in target list, no detection yet' END, CASE WHEN NOT in_target THEN 'outside the target list' END], lambda x: x IS NOT NULL), '; ') AS comment FROM covered""",
)(lambda t: findings.layer_rows(coverage(t)))
query(
    "lab_addresses_parsed", "address s, role s, note s",
    """WITH e AS (SELECT trim(unnest(string_split(value, ','))) AS e FROM lab_text), p AS (SELECT DISTINCT split_part(e, '=', 1) AS address, CASE WHEN e LIKE '%=%' THEN substr(e, position('=' IN e) + 1) ELSE '' END AS rest FROM e),
    q AS (SELECT address, CASE WHEN split_part(rest, ':', 1) = '' THEN 'other' ELSE split_part(rest, ':', 1) END AS role, CASE WHEN rest LIKE '%:%' THEN substr(rest, position(':' IN rest) + 1) ELSE '' END AS note FROM p)
    SELECT address, max((role, note))[1] AS role, max((role, note))[2] AS note FROM q GROUP BY address""",
)(lambda t: reference.current_lab_addresses(reference.parse_lab_addresses(t["lab_text"], "value", AS_OF)))
query("retention", "uid s", "SELECT uid FROM conn WHERE CAST(ts AS DATE) >= DATE '2000-01-01'")(lambda t: tables.retain(t["conn"], "ts", 31, "2000-02-01 00:00:00"))

# --- response --------------------------------------------------------------------------------------------------------

MINUTE = "make_timestamp(CAST(ceil(epoch_us({}) / 60000000.0) AS BIGINT) * 60000000)"


def ends(ts: str, minutes: int) -> str:
    return f"unnest(generate_series({MINUTE.format(ts)}, {MINUTE.format(ts)} + INTERVAL {minutes - 1} MINUTE, INTERVAL 1 MINUTE))"


USED = "eventid = 'cowrie.command.input' OR eventid LIKE 'cowrie.session.file_%'"
query(
    "trigger_honeypot", "evaluated_at t, src_ip s",
    f"""WITH e AS (SELECT {ends('timestamp', 15)} AS evaluated_at, src_ip, eventid FROM cowrie WHERE src_ip <> '') SELECT evaluated_at, src_ip FROM e GROUP BY ALL
    HAVING (count(*) FILTER (WHERE eventid = 'cowrie.login.success') >= 1 AND count(*) FILTER (WHERE {USED}) >= 1) OR count(*) FILTER (WHERE eventid = 'cowrie.login.failed') >= 20""",
)(response.honeypot_attackers_by_minute)
SEVERE = "alert_severity = 1 AND in_iface = 'ens4' AND dest_ip LIKE '10.128.%' AND NOT starts_with(http_url, '/api/ds/query')"
query("trigger_severe_alerts", "evaluated_at t, src_ip s, alerts i", f"WITH e AS (SELECT {ends('timestamp', 10)} AS evaluated_at, src_ip FROM alert WHERE {SEVERE}) SELECT evaluated_at, src_ip, count(*) AS alerts FROM e GROUP BY ALL")(response.severe_alerts_by_minute)
query("trigger_ssh_pressure", "evaluated_at t, src_ip s, connections i", f"WITH e AS (SELECT {ends('ts', 10)} AS evaluated_at, id_orig_h AS src_ip FROM conn WHERE id_resp_p = 22 AND NOT local_orig AND local_resp) SELECT evaluated_at, src_ip, count(*) AS connections FROM e GROUP BY ALL ")(lambda t: response.ssh_pressure_by_minute(t, at_least=1))
NOTICES_SQL = f"""WITH e AS (SELECT DISTINCT {ends('timestamp', 10)} AS at_, src_ip FROM alert WHERE {SEVERE}), g AS (SELECT *, CASE WHEN at_ - lag(at_) OVER w > INTERVAL 1 MINUTE OR lag(at_) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY src_ip ORDER BY at_)),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY src_ip ORDER BY at_) AS k FROM g), s AS (SELECT *, min(at_) OVER (PARTITION BY src_ip, k) AS began FROM n) SELECT 'RSP-002' AS rule, src_ip, at_ AS notified_at FROM s WHERE (epoch_us(at_) - epoch_us(began)) % 1800000000 = 0"""
query("notifications", "rule s, src_ip s, notified_at t", NOTICES_SQL)(
    lambda t: response.dedupe_notifications(response.severe_alerts_by_minute(t).select(F.lit("RSP-002").alias("rule"), "src_ip", "evaluated_at"))
)
query("active_blocks", "ip s, trigger s, rule s, expires_at t", f"SELECT ip, trigger, rule, expires_at FROM {ACTIVE}")(lambda t: response.active_blocks(t, "enforce", AS_OF))
query(
    "ip_history", "ip s, active b, suppressed_until t, earlier_blocks i",
    f"""SELECT coalesce(l.ip, b.ip) AS ip, coalesce(action = 'block' AND s.e > {NOW}, false) AS active, CASE WHEN action = 'release' THEN s.e END AS suppressed_until, coalesce(n, 0) AS earlier_blocks FROM {STANDING} l
    FULL JOIN (SELECT ip, count(*) AS n FROM actions WHERE mode = 'enforce' AND action = 'block' AND created_at > {NOW} - INTERVAL 30 DAY GROUP BY ip) b USING (ip)""",
)(lambda t: response.ip_history(t, "enforce", AS_OF))
query(
    "rolling_new_blocks", "created_at t, blocks i, recent i",
    "SELECT created_at, n AS blocks, sum(n) OVER (ORDER BY epoch_us(created_at) RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW) AS recent FROM (SELECT created_at, count(*) AS n FROM actions WHERE mode = 'enforce' AND action = 'block' AND trigger <> 'manual' GROUP BY created_at)",
)(lambda t: response.rolling_new_blocks(t, "enforce"))
BUSY = "2024-01-30 20:00:00"
query("evidence", "trigger s, ip s, evidence_at t", f"SELECT 'honeypot' AS trigger, src_ip AS ip, min(timestamp) AS evidence_at FROM cowrie WHERE timestamp > TIMESTAMP '{BUSY}' - INTERVAL 15 MINUTE AND timestamp <= TIMESTAMP '{BUSY}' GROUP BY src_ip UNION ALL SELECT 'suricata', src_ip, min(timestamp) FROM alert WHERE timestamp > TIMESTAMP '{BUSY}' - INTERVAL 10 MINUTE AND timestamp <= TIMESTAMP '{BUSY}' AND alert_severity = 1 AND in_iface = 'ens4' AND NOT starts_with(http_url, '/api/ds/query') GROUP BY src_ip")(lambda t: response.evidence(t, BUSY))
# The batch is judged against an empty log here; the rules that depend on the log are in the unit tests.
PUBLIC = " AND ".join(f"NOT ({v4('ip')} BETWEEN {int(lo[1:], 16)} AND {int(hi[1:], 16)})" for lo, hi in map(network_bounds, NOT_GLOBAL_V4))
IS_V4 = "regexp_full_match(ip, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+')"
DECIDE = f"""
    WITH shaped AS (SELECT *, CASE WHEN {IS_V4} THEN ip ELSE '1.1.1.1' END AS ip4 FROM notices),
    judged AS (SELECT n.* EXCLUDE (ip4), CASE WHEN trigger NOT IN ('honeypot', 'suricata', 'scanner', 'manual') THEN 'unknown trigger ''' || trigger || '''' WHEN ip = 'junk' THEN 'invalid address' WHEN NOT {IS_V4} THEN 'not IPv4 (the sensor has no IPv6 address)'
      WHEN NOT ({PUBLIC.replace('split_part(ip,', 'split_part(ip4,')}) THEN 'not a public address' WHEN b.a1 IS NOT NULL THEN 'never-block: ' || b.reason || ' (' || b.network || ')' END AS fault
      FROM shaped n LEFT JOIN never_block b ON CAST(split_part(ip4, '.', 1) AS INT) = b.a1 AND split_part(ip4, '.', 2) = '0'),
    ordered AS (SELECT *, row_number() OVER (ORDER BY alerted_at, ip, trigger, rule) AS place FROM judged),
    firsts AS (SELECT ip, min(place) AS place, arg_min(trigger, place) AS trig FROM ordered WHERE fault IS NULL AND trigger <> 'scanner' GROUP BY ip),
    ranked AS (SELECT *, row_number() OVER (ORDER BY place) AS r, coalesce(sum(CASE WHEN trig <> 'manual' THEN 1 ELSE 0 END) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM firsts),
    stop AS (SELECT min(place) AS at_, arg_min(CASE WHEN r > 200 THEN 'cap: 200 active blocks' ELSE 'cap: 20 new blocks per 10 min' END, place) AS why FROM ranked WHERE r > 200 OR a >= 20),
    won AS (SELECT ip AS won_ip, place AS won FROM ranked, stop WHERE at_ IS NULL OR place < at_),
    told AS (SELECT o.*, won, why, CASE WHEN fault IS NOT NULL THEN 'reject' WHEN place > won THEN 'skip' WHEN trigger = 'scanner' THEN 'observe' WHEN won IS NOT NULL THEN 'block' ELSE 'reject' END AS action FROM ordered o LEFT JOIN won ON won_ip = ip, stop)
    SELECT alerted_at, ip, trigger, rule, action, CASE WHEN fault IS NOT NULL THEN fault WHEN action = 'skip' THEN 'already blocked' WHEN action = 'observe' THEN 'trigger scanner is observe-only' WHEN action = 'block' THEN trigger ELSE why END AS reason,
      CASE WHEN action IN ('block', 'observe') THEN {NOW} + to_hours(CASE trigger WHEN 'suricata' THEN 6 WHEN 'scanner' THEN 1 ELSE 24 END) END AS expires_at FROM told"""


def decisions(t):
    nothing = {"actions": t["actions"].where("false")}
    return response.decide(t["notices"], response.ip_history(nothing, "enforce", AS_OF), response.block_totals(nothing, "enforce", AS_OF), t["never_block"], AS_OF)


query("decide", "alerted_at t, ip s, trigger s, rule s, action s, reason s, expires_at t", DECIDE)(decisions)
# The same batch against the whole log, at a time when some blocks are active, some sources released and some blocked before.
LOG_TIME = "2024-02-28 12:00:00"
AT = f"TIMESTAMP '{LOG_TIME}'"
DECIDE_ON_LOG = f"""
    WITH newest AS (SELECT ip, arg_max(action, (created_at, action, trigger, rule, reason)) AS state, arg_max(epoch_us(e), (created_at, action, trigger, rule, reason)) AS until_us
        FROM (SELECT *, coalesce(expires_at, TIMESTAMP '1970-01-01') AS e FROM actions WHERE mode = 'enforce' AND action IN ('block', 'release')) GROUP BY ip),
    past AS (SELECT ip, count(*) AS n FROM actions WHERE mode = 'enforce' AND action = 'block' AND created_at > {AT} - INTERVAL 30 DAY GROUP BY ip),
    totals AS (SELECT (SELECT count(*) FROM newest WHERE state = 'block' AND until_us > epoch_us({AT})) AS active,
        (SELECT count(*) FROM actions WHERE mode = 'enforce' AND action = 'block' AND trigger <> 'manual' AND created_at > {AT} - INTERVAL 10 MINUTE) AS fresh),
    shaped AS (SELECT *, CASE WHEN {IS_V4} THEN ip ELSE '1.1.1.1' END AS ip4 FROM notices),
    known AS (SELECT s.*, coalesce(state = 'block' AND until_us > epoch_us({AT}), false) AS active, CASE WHEN state = 'release' THEN make_timestamp(until_us) END AS released, coalesce(n, 0) AS n
        FROM shaped s LEFT JOIN newest USING (ip) LEFT JOIN past USING (ip)),
    judged AS (SELECT k.*, CASE WHEN trigger NOT IN ('honeypot', 'suricata', 'scanner', 'manual') THEN 'unknown trigger \'\'' || trigger || '\'\'' WHEN ip = 'junk' THEN 'invalid address' WHEN NOT {IS_V4} THEN 'not IPv4 (the sensor has no IPv6 address)'
      WHEN NOT ({PUBLIC.replace('split_part(ip,', 'split_part(ip4,')}) THEN 'not a public address' WHEN b.a1 IS NOT NULL THEN 'never-block: ' || b.reason || ' (' || b.network || ')'
      WHEN released > {AT} THEN 'suppressed by an analyst release until ' || strftime(released, '%Y-%m-%d %H:%M') || ' UTC' END AS fault
      FROM known k LEFT JOIN never_block b ON CAST(split_part(ip4, '.', 1) AS INT) = b.a1 AND split_part(ip4, '.', 2) = '0'),
    ordered AS (SELECT *, row_number() OVER (ORDER BY alerted_at, ip, trigger, rule) AS place FROM judged),
    firsts AS (SELECT ip, min(place) AS place, arg_min(trigger, place) AS trig FROM ordered WHERE fault IS NULL AND NOT active AND trigger <> 'scanner' GROUP BY ip),
    ranked AS (SELECT *, row_number() OVER (ORDER BY place) AS r, coalesce(sum(CASE WHEN trig <> 'manual' THEN 1 ELSE 0 END) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM firsts),
    stop AS (SELECT min(place) AS at_, arg_min(CASE WHEN active + r - 1 >= 200 THEN 'cap: 200 active blocks' ELSE 'cap: 20 new blocks per 10 min' END, place) AS why FROM ranked, totals WHERE active + r - 1 >= 200 OR fresh + a >= 20),
    won AS (SELECT ip AS won_ip, place AS won FROM ranked, stop WHERE at_ IS NULL OR place < at_),
    told AS (SELECT o.*, won, why, CASE WHEN fault IS NOT NULL THEN 'reject' WHEN active OR place > won THEN 'skip' WHEN trigger = 'scanner' THEN 'observe' WHEN won IS NOT NULL THEN 'block' ELSE 'reject' END AS action FROM ordered o LEFT JOIN won ON won_ip = ip, stop)
    SELECT alerted_at, ip, trigger, rule, action, CASE WHEN fault IS NOT NULL THEN fault WHEN action = 'skip' THEN 'already blocked' WHEN action = 'observe' THEN 'trigger scanner is observe-only'
        WHEN action = 'block' THEN trigger || CASE WHEN n > 0 THEN ', repeat offender ×' || CAST(CAST(1 AS HUGEINT) << CAST(2 * n AS INT) AS VARCHAR) ELSE '' END ELSE why END AS reason,
      CASE WHEN action IN ('block', 'observe') THEN {AT} + to_seconds(CAST(least(604800, CASE trigger WHEN 'suricata' THEN 6 WHEN 'scanner' THEN 1 ELSE 24 END * 3600 * pow(4, n)) AS BIGINT)) END AS expires_at FROM told"""
query("decide_on_log", "alerted_at t, ip s, trigger s, rule s, action s, reason s, expires_at t", DECIDE_ON_LOG)(
    lambda t: response.decide(t["notices"], response.ip_history(t, "enforce", LOG_TIME), response.block_totals(t, "enforce", LOG_TIME), t["never_block"], LOG_TIME)
)
query(
    "reconcile", "ranges a, added a, removed a",
    f"""WITH d AS (SELECT list_sort(list(ip || '/32')) AS ranges FROM {ACTIVE}), p AS (SELECT list_sort(arg_max(ranges, (applied_at, ranges))) AS previous FROM applies WHERE mode = 'enforce' AND result IN ('ok', 'dry-run', 'test'))
    SELECT ranges, list_filter(ranges, lambda x: NOT list_contains(previous, x)) AS added, list_filter(previous, lambda x: NOT list_contains(ranges, x)) AS removed FROM d, p WHERE ranges <> previous""",
)(lambda t: response.reconcile(t, "enforce", AS_OF))
query(
    "release_rows", "created_at t, action s, ip s, trigger s, rule s, reason s, expires_at t, mode s, actor s",
    f"SELECT {NOW} AS created_at, 'release' AS action, ip, 'manual' AS trigger, 'manual release' AS rule, reason, CASE WHEN suppress_seconds IS NOT NULL THEN {NOW} + to_seconds(CAST(suppress_seconds AS BIGINT)) END AS expires_at, 'enforce' AS mode, 'analyst' AS actor FROM release_requests",
)(lambda t: response.release_rows(t["release_requests"], "enforce", AS_OF, "analyst"))
query("without_test_rows", "created_at t, ip s, action s", "SELECT created_at, ip, action FROM actions WHERE mode <> 'test'")(lambda t: response.without_test_rows(t["actions"]))

# --- evaluation ------------------------------------------------------------------------------------------------------

query(
    "eval_cases", "case_name s, detected_sids a, missing_sids a, unexpected_sids a, first_alert_at t, mttd_ms i, visible_ms i, result s",
    """WITH h AS (SELECT case_name, alert_signature_id AS sid, min(timestamp) AS at_, min(loaded_at) AS loaded FROM cases JOIN alert ON in_iface = 'ens4' AND timestamp >= started_at AND timestamp < deadline GROUP BY ALL),
    g AS (SELECT c.*, coalesce(list_sort((SELECT list(sid) FROM h WHERE h.case_name = c.case_name)), []) AS detected, (SELECT min(at_) FROM h WHERE h.case_name = c.case_name AND list_contains(c.expected_sids, sid)) AS first_, (SELECT max(loaded) FROM h WHERE h.case_name = c.case_name AND list_contains(c.expected_sids, sid)) AS last_ FROM cases c),
    m AS (SELECT *, list_sort(list_distinct(list_filter(expected_sids, lambda x: NOT list_contains(detected, x)))) AS missing FROM g)
    SELECT case_name, detected AS detected_sids, missing AS missing_sids, list_filter(detected, lambda x: NOT list_contains(expected_sids, x)) AS unexpected_sids, CASE WHEN len(missing) = 0 THEN first_ END AS first_alert_at,
    CASE WHEN len(missing) = 0 THEN (epoch_us(first_) - epoch_us(started_at)) // 1000 END AS mttd_ms, CASE WHEN len(missing) = 0 THEN (epoch_us(last_) - epoch_us(started_at)) // 1000 END AS visible_ms, CASE WHEN len(missing) = 0 THEN 'PASS' ELSE 'FAIL' END AS result FROM m""",
)(lambda t: evaluate.evaluate_cases(t["cases"], t["alert"], "ens4"))
query("arrivals", "src_ip s, password s, refused i, accepted i, country_code s, newest t", "SELECT src_ip, password, count(*) FILTER (WHERE eventid = 'cowrie.login.failed') AS refused, count(*) FILTER (WHERE eventid = 'cowrie.login.success') AS accepted, min(src_country_code) FILTER (WHERE eventid = 'cowrie.login.success') AS country_code, max(timestamp) AS newest FROM cowrie GROUP BY ALL")(lambda t: evaluate.arrivals(t["cowrie"], ["src_ip", "password"]))
query("absence_check", "requests i", "SELECT count(*) AS requests FROM http WHERE uri LIKE '/en/%' AND id_orig_h = '10.0.4.1' AND uri = (SELECT min(uri) FROM http WHERE uri LIKE '/en/%')")(
    lambda t: evaluate.absence_check(t["http"], t["http"].where("uri LIKE '/en/%'").agg(F.min("uri")).scalar(), "10.0.4.1", START)
)


ARRIVED = "(SELECT src_ip, password, timestamp FROM cowrie WHERE eventid = 'cowrie.login.success' ORDER BY timestamp, src_ip, password LIMIT 1)"


def arrived(t):
    first = t["cowrie"].where("eventid = 'cowrie.login.success'").agg(F.min(F.struct("timestamp", "src_ip", "password")).alias("first"))
    told = [first.select(f"first.{c}").scalar() for c in ("src_ip", "password", "timestamp")]
    return evaluate.arrival_check(t["cowrie"], *told)


query(
    "arrival_check", "refused i, accepted i, commands i, country_code s, asn i, newest t",
    f"""SELECT count(*) FILTER (WHERE eventid = 'cowrie.login.failed' AND username = 'root' AND c.password IN ('root', '123456')) AS refused, count(*) FILTER (WHERE eventid = 'cowrie.login.success' AND c.password = f.password) AS accepted,
    count(*) FILTER (WHERE eventid = 'cowrie.command.input' AND contains(input, f.password)) AS commands, min(src_country_code) FILTER (WHERE eventid = 'cowrie.login.success' AND c.password = f.password) AS country_code,
    min(src_asn) FILTER (WHERE eventid = 'cowrie.login.success' AND c.password = f.password) AS asn, max(c.timestamp) FILTER (WHERE c.password = f.password OR contains(input, f.password)) AS newest
    FROM cowrie c JOIN {ARRIVED} f ON c.src_ip = f.src_ip AND c.timestamp >= f.timestamp - INTERVAL 5 SECOND""",
)(arrived)


def two_sources(t):
    ours = tls_fingerprints(t["hello"]).select(F.col("uid").alias("community_id"), F.lit("").alias("server_name"), "ja3", "ja4", "ja4_r")
    mark = F.substring(F.md5("community_id"), 1, 1)
    shifted = F.when(mark < "2", F.concat(F.substring("ja4", 1, 24), F.lit("000000000000"))).otherwise(F.col("ja4"))
    return ours, ours.where(mark != "f").select("community_id", "ja3", shifted.alias("ja4"))


query("reconcile_fingerprints", "flows_ours i, flows_theirs i, compared i, ja3_match i, known_difference i", "SELECT count(*) AS flows_ours, count(*) FILTER (WHERE k) AS flows_theirs, count(*) FILTER (WHERE k) AS compared, count(*) FILTER (WHERE k) AS ja3_match, 0 AS known_difference FROM (SELECT DISTINCT uid, true AS k FROM hello)")(
    lambda t: evaluate.fingerprint_summary(evaluate.reconcile_fingerprints(two_sources(t)[0], two_sources(t)[0].select("community_id", "ja3", "ja4")))
)
query(
    "reconcile_fingerprints_shifted", "flows_ours i, flows_theirs i, compared i, ja3_match i, ja4_match i, known_difference i, unexplained i, distinct_ja4 i",
    f"""WITH prints AS ({TLS_SQL}), both_ AS (SELECT *, substr(md5(uid), 1, 1) AS mark, CASE WHEN substr(md5(uid), 1, 1) < '2' THEN substr(ja4, 1, 24) || '000000000000' ELSE ja4 END AS other FROM prints)
    SELECT count(*) AS flows_ours, count(*) FILTER (WHERE mark <> 'f') AS flows_theirs, count(*) FILTER (WHERE mark <> 'f') AS compared, count(*) FILTER (WHERE mark <> 'f') AS ja3_match,
    count(*) FILTER (WHERE mark <> 'f' AND ja4 = other) AS ja4_match, 0 AS known_difference, count(*) FILTER (WHERE mark <> 'f' AND ja4 <> other) AS unexplained, count(DISTINCT ja4) FILTER (WHERE mark <> 'f') AS distinct_ja4 FROM both_""",
)(lambda t: evaluate.fingerprint_summary(evaluate.reconcile_fingerprints(*two_sources(t))))
EXPECTED = "SELECT DISTINCT 'DET-109' AS detection_id, id_orig_h AS src, true AS flag, 'high' AS severity FROM conn WHERE local_orig"


def expectations(t):
    hosts = t["conn"].where("local_orig").select(F.lit("DET-109").alias("detection_id"), F.col("id_orig_h").alias("src"), F.lit(True).alias("flag"), F.lit("high").alias("severity")).distinct()
    return evaluate.check_expectations(det.scanning(t, START, END, AS_OF), hosts, ["severity"])


query(
    "check_expectations", "detection_id s, src s, flag b, passed b",
    f"SELECT detection_id, src, flag, EXISTS (SELECT 1 FROM ({scan_sql().strip()}) f WHERE f.src = e.src AND f.severity = e.severity) AS passed FROM ({EXPECTED}) e",
)(expectations)
