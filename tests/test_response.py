import random
import tempfile
from datetime import datetime, timedelta

import pytest

from hawkspan.plans import response as r
from hawkspan.sources.reference import load_never_block

NOW = datetime(2026, 9, 14, 12)
AS_OF = "2026-09-14 12:00:00"
ATTACKER = "45.135.232.10"
ACTIONS = "created_at timestamp, action string, ip string, trigger string, rule string, reason string, expires_at timestamp, mode string"
ALERTS = "alerted_at timestamp, ip string, trigger string, rule string, ttl_seconds double"
LIST = ["35.235.240.0/20 admin access", "203.0.113.7/32 office # note", "# comment", ""]


def never_block(spark):
    path = f"{tempfile.mkdtemp()}/never-block.txt"
    with open(path, "w") as out:
        out.write("\n".join(LIST))
    return load_never_block(spark, path)


def log(spark, rows):
    return {"actions": spark.createDataFrame([(at, action, ip, trigger, "r", "x", until, "enforce") for at, action, ip, trigger, until in rows], ACTIONS)}


def judge(spark, alerts, rows=(), **kw):
    t = log(spark, list(rows))
    frame = spark.createDataFrame([(NOW - timedelta(seconds=1000 - i), ip, trig, f"r{i:04d}", ttl) for i, (ip, trig, ttl) in enumerate(alerts)], ALERTS)
    out = r.decide(frame, r.ip_history(t, "enforce", AS_OF), r.block_totals(t, "enforce", AS_OF), never_block(spark), AS_OF, **kw)
    return [(x.action, x.reason, x.expires_at) for x in out.orderBy("alerted_at").collect()]


def test_stateless_checks(spark):
    bad = ["not-an-ip", "10.178.0.2", "192.0.2.7", "169.254.169.254", "2001:4860::1", "35.235.241.1", "203.0.113.7"]
    out = judge(spark, [(ip, "honeypot", None) for ip in bad] + [("45.1.1.1", "unknown", None), (ATTACKER, "honeypot", None), ("45.135.232.11", "scanner", None), ("45.135.232.12", "manual", 1800.0)])
    assert [o[0] for o in out] == ["reject"] * 8 + ["block", "observe", "block"]
    assert out[4][1].startswith("not IPv4") and out[5][1] == "never-block: admin access (35.235.240.0/20)" and out[7][1] == "unknown trigger 'unknown'"
    assert out[8][2] == NOW + timedelta(hours=24) and out[9][2] == NOW + timedelta(hours=1) and out[10][2] == NOW + timedelta(minutes=30)


def test_test_network_only_in_test_mode(spark):
    assert judge(spark, [("203.0.113.50", "honeypot", None)])[0][0] == "reject"
    out = judge(spark, [("203.0.113.50", "honeypot", None), ("198.51.100.9", "honeypot", None)], test_net_ok=True)
    assert [o[0] for o in out] == ["block", "reject"]


def test_short_lifetimes_grow_to_the_ceiling(spark):
    past = [(NOW - timedelta(days=2, minutes=i), "block", ATTACKER, "suricata", NOW - timedelta(days=1)) for i in range(100)]
    (_, reason, until), = judge(spark, [(ATTACKER, "suricata", 5.0)], past[:10])
    assert until == NOW + timedelta(days=7) and reason == f"suricata, repeat offender ×{4**10}"
    (_, reason, until), = judge(spark, [(ATTACKER, "suricata", None)], past)
    assert until == NOW + timedelta(days=7) and reason == f"suricata, repeat offender ×{4**100}"


def test_notices_off_the_minute(spark):
    ends = [NOW + timedelta(seconds=60 * i + i % 2) for i in range(120)] + [NOW + timedelta(seconds=60 * 121 + 30)]
    firing = spark.createDataFrame([("r", ATTACKER, at) for at in ends], "rule string, src_ip string, evaluated_at timestamp")
    got = sorted(x.notified_at for x in r.dedupe_notifications(firing).collect())
    assert got == [NOW + timedelta(minutes=30 * i) for i in range(4)] + [ends[-1]]


@pytest.mark.parametrize("earlier,hours", [(0, 6), (1, 24), (2, 96), (3, 168)])
def test_repeat_offenders(spark, earlier, hours):
    past = [(NOW - timedelta(days=2 + i), "block", ATTACKER, "suricata", NOW - timedelta(days=1)) for i in range(earlier)]
    (action, reason, until), = judge(spark, [(ATTACKER, "suricata", None)], past)
    assert action == "block" and until == NOW + timedelta(hours=hours)
    assert reason == ("suricata" if not earlier else f"suricata, repeat offender ×{4 ** earlier}")


def test_release_suppression_and_active(spark):
    block = (NOW - timedelta(hours=3), "block", ATTACKER, "suricata", NOW + timedelta(hours=3))
    assert judge(spark, [(ATTACKER, "suricata", None)], [block])[0][:2] == ("skip", "already blocked")
    held = (NOW - timedelta(hours=1), "release", ATTACKER, "manual", NOW + timedelta(hours=2))
    assert judge(spark, [(ATTACKER, "suricata", None)], [block, held])[0][1] == "suppressed by an analyst release until 2026-09-14 14:00 UTC"
    # A release without suppression has no expiry; the older block's expiry must not come back.
    free = (NOW - timedelta(hours=1), "release", ATTACKER, "manual", None)
    assert judge(spark, [(ATTACKER, "suricata", None)], [block, free])[0][:2] == ("block", "suricata, repeat offender ×4")


def test_rate_cap_counts_automatic_blocks_only(spark):
    recent = [(NOW - timedelta(minutes=5), "block", f"45.9.9.{i}", "suricata", NOW + timedelta(hours=1)) for i in range(3)]
    recent.append((NOW - timedelta(minutes=5), "block", "45.9.8.1", "manual", NOW + timedelta(hours=1)))
    out = judge(spark, [(f"45.10.0.{i}", "suricata", None) for i in range(22)], recent)
    assert [o[0] for o in out] == ["block"] * 17 + ["reject"] * 5
    assert {o[1] for o in out[17:]} == {"cap: 20 new blocks per 10 min"}


def test_active_cap(spark):
    full = [(NOW - timedelta(days=1), "block", f"45.{i // 250}.1.{i % 250}", "manual", NOW + timedelta(days=1)) for i in range(200)]
    assert judge(spark, [(ATTACKER, "suricata", None), ("45.135.232.11", "scanner", None)], full) == [
        ("reject", "cap: 200 active blocks", None), ("observe", "trigger scanner is observe-only", NOW + timedelta(hours=1)),
    ]


def test_batches_equal_one_by_one_handling(spark):
    rng = random.Random(11)
    for active, fresh in ((0, 0), (190, 5), (150, 15)):
        past = [(NOW - timedelta(minutes=2), "block", f"46.0.0.{i}", "suricata" if i < fresh else "manual", NOW + timedelta(hours=1)) for i in range(active)]
        alerts = [(f"45.0.0.{rng.randint(1, 40)}", rng.choice(["suricata", "manual", "scanner", "honeypot"]), None) for _ in range(120)]
        got = [o[0] for o in judge(spark, alerts, past)]
        blocked, total, new, want = set(), active, min(fresh, active), []
        for ip, trigger, _ in alerts:
            if ip in blocked:
                want.append("skip")
            elif trigger == "scanner":
                want.append("observe")
            elif total >= 200 or new >= 20:
                want.append("reject")
            else:
                blocked.add(ip)
                total, new = total + 1, new + (trigger != "manual")
                want.append("block")
        assert got == want


def test_log_rows_release_and_reconcile(spark):
    t = log(spark, [(NOW - timedelta(hours=1), "block", "45.1.1.1", "suricata", NOW + timedelta(hours=1))])
    applies = "applied_at timestamp, firewall string, mode string, result string, ranges array<string>"
    t["applies"] = spark.createDataFrame([(NOW - timedelta(hours=2), "f", "enforce", "ok", ["45.2.2.2/32"]), (NOW, "f", "enforce", "error", ["9.9.9.9/32"])], applies)
    row = r.reconcile(t, "enforce", AS_OF).head()
    assert (row.ranges, row.added, row.removed) == (["45.1.1.1/32"], ["45.1.1.1/32"], ["45.2.2.2/32"])
    t["applies"] = spark.createDataFrame([(NOW, "f", "enforce", "ok", ["45.1.1.1/32"])], applies)
    assert r.reconcile(t, "enforce", AS_OF).count() == 0
    asked = spark.createDataFrame([("45.1.1.1", "mistake", None), ("45.1.1.2", "mistake", 3600.0)], "ip string, reason string, suppress_seconds double")
    rows = {x.ip: x.expires_at for x in r.release_rows(asked, "enforce", AS_OF, "ann").collect()}
    assert rows == {"45.1.1.1": None, "45.1.1.2": NOW + timedelta(hours=1)}
    with pytest.raises(Exception, match="not an address"):
        r.release_rows(spark.createDataFrame([("nobody", "x", None)], "ip string, reason string, suppress_seconds double"), "enforce", AS_OF, "ann").collect()
    decided = spark.createDataFrame([(NOW, "45.1.1.9", "suricata", "r", "block", "suricata", NOW), (NOW, "45.1.1.8", "suricata", "r", "skip", "already blocked", None)], "alerted_at timestamp, ip string, trigger string, rule string, action string, reason string, expires_at timestamp")
    seen = spark.createDataFrame([("suricata", "45.1.1.9", NOW - timedelta(minutes=3))], "trigger string, ip string, evidence_at timestamp")
    kept = r.action_rows(decided, seen, "enforce", AS_OF, "responder").collect()
    assert [(k.ip, k.evidence_at) for k in kept] == [("45.1.1.9", NOW - timedelta(minutes=3))]


def test_point_in_time_triggers(spark):
    at = lambda s: NOW - timedelta(seconds=s)
    cowrie = [(at(60), "1.1.1.1", "cowrie.login.success"), (at(50), "1.1.1.1", "cowrie.command.input"), (at(2000), "2.2.2.2", "cowrie.login.success"), (at(40), "2.2.2.2", "cowrie.command.input")]
    cowrie += [(at(100 + i), "3.3.3.3", "cowrie.login.failed") for i in range(20)]
    t = {"cowrie": spark.createDataFrame(cowrie, "timestamp timestamp, src_ip string, eventid string")}
    assert {x.src_ip for x in r.honeypot_attackers(t, AS_OF).collect()} == {"1.1.1.1", "3.3.3.3"}
    conn = [(at(i), "4.4.4.4", 22, False, True) for i in range(30)] + [(at(i), "5.5.5.5", 22, False, True) for i in range(29)]
    t["conn"] = spark.createDataFrame(conn, "ts timestamp, id_orig_h string, id_resp_p int, local_orig boolean, local_resp boolean")
    assert [(x.src_ip, x.connections) for x in r.ssh_pressure(t, AS_OF).collect()] == [("4.4.4.4", 30)]
    alert = [(at(5), 1, "ens4", "10.128.0.2", "6.6.6.6", "/x"), (at(5), 1, "ens4", "10.128.0.2", "10.128.0.9", "/x"), (at(5), 1, "ens4", "10.128.0.2", "7.7.7.7", "/api/ds/query?a"), (at(5), 2, "ens4", "10.128.0.2", "8.8.8.8", "/x")]
    t["alert"] = spark.createDataFrame(alert, "timestamp timestamp, alert_severity int, in_iface string, dest_ip string, src_ip string, http_url string")
    assert [x.src_ip for x in r.severe_alerts(t, AS_OF).collect()] == ["6.6.6.6"]


def test_analyst_words_are_kept(spark):
    t = log(spark, [])
    frame = spark.createDataFrame([(NOW, ATTACKER, "manual", "r", None, "seen twice"), (NOW, "45.1.1.1", "suricata", "r", None, "ignored")], ALERTS + ", note string")
    out = r.decide(frame, r.ip_history(t, "enforce", AS_OF), r.block_totals(t, "enforce", AS_OF), never_block(spark), AS_OF)
    assert {x.ip: x.reason for x in out.collect()} == {ATTACKER: "manual: seen twice", "45.1.1.1": "suricata"}


def test_never_block_file(spark, tmp_path):
    (tmp_path / "n.txt").write_text("\n".join(LIST))
    rows = {x.network: x.reason for x in load_never_block(spark, f"{tmp_path}/n.txt").collect()}
    assert rows == {"35.235.240.0/20": "admin access", "203.0.113.7/32": "office"}
    (tmp_path / "bad.txt").write_text("10.0.0.1/8 wrong")
    with pytest.raises(Exception, match="not a network"):
        load_never_block(spark, f"{tmp_path}/bad.txt").collect()


def test_arrival_and_absence(spark):
    from hawkspan.plans import evaluate

    rows = [(NOW, "1.1.1.1", "cowrie.login.failed", "root", "123456", "", "", 0), (NOW, "1.1.1.1", "cowrie.login.success", "root", "mark", "", "KR", 7), (NOW, "1.1.1.1", "cowrie.command.input", "", "", "echo mark", "", 0)]
    frame = spark.createDataFrame(rows, "timestamp timestamp, src_ip string, eventid string, username string, password string, input string, src_country_code string, src_asn int")
    got = evaluate.arrival_check(frame, "1.1.1.1", "mark", AS_OF).head()
    assert (got.refused, got.accepted, got.commands, got.country_code, got.asn, got.newest) == (1, 1, 1, "KR", 7, NOW)
    http = spark.createDataFrame([(NOW, "/x", "1.1.1.1")], "ts timestamp, uri string, id_orig_h string")
    assert [evaluate.absence_check(http, u, "1.1.1.1", AS_OF).head().requests for u in ("/x", "/y")] == [1, 0]


def test_honeypot_minutes_that_cannot_fire_are_not_repeated(spark, monkeypatch):
    rng = random.Random(3)
    kinds = ["cowrie.login.failed"] * 8 + ["cowrie.login.success", "cowrie.command.input", "cowrie.session.connect"]
    rows = [(f"s{rng.randrange(12)}", rng.choice(kinds), NOW + timedelta(seconds=int(rng.paretovariate(0.5)) % 40000)) for _ in range(1500)] + [("quiet", "cowrie.login.failed", NOW + timedelta(minutes=30 * i)) for i in range(200)]
    cowrie = spark.createDataFrame(rows, "src_ip string, eventid string, timestamp timestamp")
    repeated, plain = [], r.sliding
    monkeypatch.setattr(r, "sliding", lambda df, *more: repeated.append(df) or plain(df, *more))
    got = {(x.evaluated_at, x.src_ip) for x in r.honeypot_attackers_by_minute({"cowrie": cowrie}).collect()}
    want = set()
    for src in {s for s, _, _ in rows}:
        mine = [(k, t) for s, k, t in rows if s == src]
        for at in {t.replace(second=0) + timedelta(minutes=m + (t.second > 0)) for _, t in mine for m in range(15)}:
            seen = [k for k, t in mine if at - timedelta(minutes=15) < t <= at]
            if seen.count("cowrie.login.failed") >= 20 or ("cowrie.login.success" in seen and "cowrie.command.input" in seen):
                want.add((at, src))
    assert got == want and want
    assert repeated[0].where("src_ip = 'quiet'").isEmpty()
