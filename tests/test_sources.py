import gzip
import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from traffic import HOST, build

from hawkspan import schemas
from hawkspan.operators.allowlist import RejectedRows
from hawkspan.plans import findings
from hawkspan.plans.registry import REGISTRY
from hawkspan.sources import normalize, reference
from hawkspan.sources.tables import TableStore, retain, write_result
from hawkspan.streaming import ingest, triggers

CONN_LINE = {"ts": 1767571200.123456, "uid": "C1", "id.orig_h": "10.128.0.2", "id.orig_p": 5, "id.resp_h": "1.1.1.1", "id.resp_p": 443, "proto": "tcp", "local_orig": True, "local_resp": False, "new_field": 1}


def write_lines(path, lines, opener=open):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with opener(path, "wt") as out:
        out.write("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


def test_sensor_ingest_routes_and_rejects(spark, tmp_path):
    logs = f"{tmp_path}/in/zeek"
    write_lines(f"{logs}/conn.2026-01-05-00-00-00.log", [CONN_LINE, "{broken", {"uid": "no time"}])
    write_lines(f"{logs}/x509.log", [{"ts": 1767571201.5, "fingerprint": "f1", "certificate.not_valid_before": 1700000000.0, "san.dns": ["a.test"], "basic_constraints.ca": True}])
    write_lines(f"{logs}/weird.log", [CONN_LINE])
    store = TableStore(spark, f"{tmp_path}/tables")
    run = lambda: ingest.start_sensor_ingest(spark, f"{tmp_path}/in", store, f"{tmp_path}/cp", available_now=True, log_types=("conn", "x509")).awaitTermination()
    run()
    run()  # nothing new: the checkpoint remembers
    conn = store.events("conn").collect()
    assert [(c.uid, c.id_orig_h, c.direction, c.remote_ip, c.service, c.orig_bytes, c.tunnel_parents) for c in conn] == [("C1", "10.128.0.2", "outbound", "1.1.1.1", "", 0, [])]
    assert conn[0].ts == datetime(2026, 1, 5, 0, 0, 0, 123456)
    cert = store.events("x509").head()
    assert (cert.san_dns, cert.basic_constraints_ca, cert.certificate_not_valid_before) == (["a.test"], True, datetime(2023, 11, 14, 22, 13, 20))
    assert cert.certificate_not_valid_after == datetime(1970, 1, 1)
    assert sorted(r.fault for r in store.rows("rejected").collect()) == ["no event time", "not a JSON object of this log"]
    write_lines(f"{logs}/conn.2026-01-05-01-00-00.log", [{**CONN_LINE, "uid": "C2"}])
    run()
    assert store.events("conn").count() == 2


def test_alert_stats_and_metrics_ingest(spark, tmp_path):
    at = "2026-01-05T10:00:00.250000+0000"
    write_lines(f"{tmp_path}/in/eve.json", [
        {"event_type": "alert", "timestamp": at, "flow_id": 2**63 + 5, "src_ip": "1.2.3.4", "alert": {"signature_id": 7, "severity": 1, "metadata": {"mitre_technique_id": ["T1190"]}}, "http": {"url": "/x"}},
        {"event_type": "stats", "timestamp": at, "stats": {"uptime": 9, "capture": {"kernel_drops": 3}, "detect": {"alerts_suppressed": 4}}}, {"event_type": "flow", "timestamp": at}, "{cut",
    ])
    store = TableStore(spark, f"{tmp_path}/tables")
    ingest.start_alert_ingest(spark, f"{tmp_path}/in", store, f"{tmp_path}/cp", available_now=True).awaitTermination()
    alert, stats = store.events("alert").collect(), store.events("stats").collect()
    assert [(a.alert_signature_id, int(a.flow_id), a.http_url, a.alert_metadata_mitre_technique_id, a.tls_sni) for a in alert] == [(7, 2**63 + 5, "/x", ["T1190"], "")]
    assert [(s.stats_uptime, s.stats_capture_kernel_drops, s.stats_detect_alerts_suppressed, s.stats_tcp_memuse) for s in stats] == [(9, 3, 4, 0)]
    write_lines(f"{tmp_path}/m/a.json", [{"name": "uptime_seconds", "kind": "absolute", "gauge": {"value": 2.5}, "tags": {"host": "a"}}, {"name": "other", "gauge": {"value": 1}}])
    ingest.start_metrics_ingest(spark, f"{tmp_path}/m", store, f"{tmp_path}/cm", available_now=True).awaitTermination()
    assert [(m.name, m.value, m.tags) for m in store.events("metrics").collect()] == [("uptime_seconds", 2.5, {"host": "a"})]
    assert [(r.log, r.line) for r in store.rows("rejected").collect()] == [("eve", "{cut")]


def test_honeypot_objects_are_read_once(spark, tmp_path):
    event = {"eventid": "cowrie.login.failed", "timestamp": "2026-01-05T10:00:00.5Z", "session": "s", "src_ip": "1.2.3.4", "src_port": "x", "username": "root"}
    write_lines(f"{tmp_path}/in/20260105T100000Z-a.json.gz", [event, "nope", {"eventid": "other.event", "timestamp": event["timestamp"]}], gzip.open)
    write_lines(f"{tmp_path}/in/20260105T100100Z-b.json.gz", [event], gzip.open)  # the same event shipped twice
    write_lines(f"{tmp_path}/in/readme.txt", [event])
    store = TableStore(spark, f"{tmp_path}/tables")
    ingest.start_honeypot_ingest(spark, f"{tmp_path}/in", store, f"{tmp_path}/cp", available_now=True).awaitTermination()
    rows = store.events("cowrie").collect()
    assert [(r.eventid, r.username, r.src_port, r.timestamp) for r in rows] == [("cowrie.login.failed", "root", 0, datetime(2026, 1, 5, 10, 0, 0, 500000))]


def test_late_honeypot_objects_are_kept_and_bad_lines_stored(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/tables")
    event = lambda day, name: {"eventid": "cowrie.login.failed", "timestamp": f"2026-01-{day:02d}T10:00:00Z", "session": "s", "src_ip": "1.2.3.4", "username": name}
    objects = [[event(5, "a"), event(6, "b")], [event(4, "c"), "{bad", {"eventid": "other.event", "timestamp": "2026-01-04T00:00:00Z"}], [event(5, "a"), event(5, "d"), event(4, "c")]]
    for i, content in enumerate(objects):  # a run for each object: the second is older than all before it
        write_lines(f"{tmp_path}/in/2026010{i}T000000Z-x.json.gz", content, gzip.open)
        ingest.start_honeypot_ingest(spark, f"{tmp_path}/in", store, f"{tmp_path}/cp", available_now=True).awaitTermination()
    assert sorted(r.username for r in store.events("cowrie").collect()) == ["a", "b", "c", "d"]
    assert sorted((r.log, r.fault) for r in store.rows("rejected").collect()) == [("cowrie", "foreign event"), ("cowrie", "not a JSON event")]
    # A batch that is repeated after a failure leaves the same rows.
    batch = ingest.honeypot_batch(store)
    for _ in range(2):
        batch(spark.createDataFrame([(json.dumps(event(6, "e")),), (json.dumps(event(6, "b")),)], "value string"), 99)
    assert sorted(r.username for r in store.events("cowrie").collect()) == ["a", "b", "c", "d", "e"]


def test_tables_append_replace_and_expire(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    rows = spark.createDataFrame([(datetime(2026, 1, d), f"u{d}") for d in (1, 2, 20)], "ts timestamp, uid string")
    store.append_events("conn", normalize.fill_defaults(rows, schemas.SENSOR_LOGS["conn"]))
    assert "date=2026-01-01" in "".join(store.events("conn").inputFiles())
    assert retain(store.events("conn"), "ts", 30, "2026-02-01 12:00:00").count() == 2
    assert store.expire("conn", "2026-02-01 12:00:00") == ["date=2026-01-01"]
    assert sorted(r.uid for r in store.events("conn").collect()) == ["u2", "u20"]
    for version in (1, 2):
        store.replace("allowlist", spark.createDataFrame([(version,)], "v int"))
        assert [r.v for r in store.current("allowlist").collect()] == [version]
    write_result(rows, f"{tmp_path}/out", "tsv")
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/out").count() == 3


def test_reference_files(spark, tmp_path):
    good = "id\tdetection_id\tmatch_type\tvalue\treason\texpires_at\tenabled\nTUNE-001\tDET-101\tdst_cidr\t10.0.0.0/8\tours\t2030-01-01 00:00:00\ttrue\n"
    (tmp_path / "a.tsv").write_text(good)
    assert [(r.id, r.enabled) for r in reference.load_allowlist(spark, f"{tmp_path}/a.tsv", list(REGISTRY)).collect()] == [("TUNE-001", True)]
    for bad in (good.replace("10.0.0.0/8", "10.0.0.1/8"), good.replace("DET-101", "DET-999"), good.replace("\ttrue", "\tmaybe"), good.replace("\tours", ""), good + good.splitlines()[1] + "\n", good.replace("id\tdet", "ID\tdet")):
        (tmp_path / "b.tsv").write_text(bad)
        with pytest.raises(RejectedRows):
            reference.load_allowlist(spark, f"{tmp_path}/b.tsv", list(REGISTRY))
    (tmp_path / "r.csv").write_text("1.0.0.0,1.0.0.255,64500,Net\n2001:db8::,2001:db8::ffff,64501,Six\n")
    assert sorted(r.lo for r in reference.load_ranges(spark, f"{tmp_path}/r.csv", ("asn", "as_org")).collect()) == ["401000000", "620010db8000000000000000000000000"]


def test_run_history_and_errors(spark, tmp_path):
    tables = {name: rows.cache() for name, rows in build(spark).items() if name != "dns"}
    only = {k: v for k, v in REGISTRY.items() if k in ("DET-105", "DET-109")}
    saved = dict(REGISTRY)
    REGISTRY.clear()
    REGISTRY.update(only)
    try:
        runs = findings.run_detections(spark, tables, datetime(2031, 3, 13, 1, 30), f"{tmp_path}/hits", f"{tmp_path}/runs", backfill_hours=1)
    finally:
        REGISTRY.update(saved)
    assert sorted((r.detection_id, r.result, r.hits, r.backfill) for r in runs.collect()) == [("DET-105", "error", 0, True), ("DET-109", "ok", 2, True)]
    hit = spark.read.parquet(f"{tmp_path}/hits").where(F.col("src") == HOST["sweeper"]).head()
    assert hit.hit_key == f"DET-109|{HOST['sweeper']}||3389" and json.loads(hit.details)["targets"] == 45
    assert hit.window_end == datetime(2031, 3, 13)
    assert [e for e, _ in findings.window_ends(datetime(2026, 1, 1, 3, 5), 2)] == [datetime(2026, 1, 1, 1), datetime(2026, 1, 1, 2)]


def test_verdicts_layer_and_decision_batches(spark, tmp_path):
    verdict = "created_at timestamp, source string, subject string, verdict string, analyst string, tune_id string, note string"
    row = (datetime(2026, 1, 1), "suricata", "7|1.2.3.4", "true_positive", "a", "-", "n")
    findings.record_verdicts(spark.createDataFrame([row], verdict), f"{tmp_path}/v")
    assert spark.read.parquet(f"{tmp_path}/v").head().tune_id == ""
    with pytest.raises(RejectedRows):
        findings.record_verdicts(spark.createDataFrame([(*row[:3], "perhaps", *row[4:])], verdict), f"{tmp_path}/v")
    coverage = spark.createDataFrame([("T1", "n", "t", True, "validated", ["DET-101"], []), ("T2", "", "", True, "gap", [], [])], schemas.STATE["coverage"].rsplit(",", 1)[0])
    layer = json.loads(findings.layer_document(coverage, "x").head().value)
    assert [(x["techniqueID"], x["score"]) for x in layer["techniques"]] == [("T1", 2), ("T2", 0)]
    assert layer["description"] == "Targets: 2; validated 1 (50%); observed only 0; gaps 1"
    assert (layer["filters"], layer["sorting"], layer["layout"]["layout"], len(layer["legendItems"]), layer["hideDisabled"]) == ({"platforms": ["Linux", "Network"]}, 3, "side", 3, False)

    def tables(batch_id):
        empty = {"actions": schemas.STATE["actions"], "cowrie": schemas.COWRIE, "alert": schemas.ALERT, "conn": schemas.SENSOR_LOGS["conn"]}
        return {n: spark.createDataFrame([], d) for n, d in empty.items()}

    (tmp_path / "never.txt").write_text("10.0.0.0/8 x")
    alerts = spark.createDataFrame([(datetime(2026, 1, 1), "45.1.1.1", "suricata", "r", None)], "alerted_at timestamp, ip string, trigger string, rule string, ttl_seconds double")
    handle = triggers.decision_batch(tables, reference.load_never_block(spark, f"{tmp_path}/never.txt"), f"{tmp_path}/actions", "enforce", lambda b: "2026-01-01 00:00:00")
    handle(alerts, 0)
    handle(alerts, 0)  # repeated after a failure
    assert [(a.ip, a.action) for a in spark.read.parquet(f"{tmp_path}/actions").collect()] == [("45.1.1.1", "block")]


def test_direction_defaults(spark):
    rows = spark.createDataFrame([("a", "b", None, None), ("a", "b", False, None), ("a", "b", True, False)], "id_orig_h string, id_resp_h string, local_orig boolean, local_resp boolean")
    assert [(r.direction, r.remote_ip) for r in normalize.label_direction(rows).collect()] == [("internal", ""), ("inbound", "a"), ("outbound", "b")]
    assert rows.select(normalize.log_type_of(F.lit("/x/conn.2026-01-05-10-00-00.log")).alias("t")).head().t == "conn"
