import statistics

import pytest
from traffic import AS_OF, END, HOST, START, build

from hawkspan.plans import detections as det
from hawkspan.plans.registry import REGISTRY, listing

NAME = {address: name for name, address in HOST.items()}


@pytest.fixture(scope="module")
def tables(spark):
    return {name: rows.cache() for name, rows in build(spark).items()}


def found(detection, tables, start=START, end=END, **params):
    return {NAME[row["src"]]: row for row in detection(tables, start, end, AS_OF, **params).collect()}


def test_beaconing(tables):
    rows = found(det.beaconing, tables)
    assert set(rows) == {"buoy"} and rows["buoy"]["conns"] == 90
    moments = sorted(r.ts.timestamp() for r in tables["conn"].collect() if r.id_orig_h == HOST["buoy"])
    gaps = sorted(b - a for a, b in zip(moments, moments[1:], strict=False))
    middle = gaps[len(gaps) // 2]
    off = sorted(abs(g - middle) for g in gaps)
    timing, steady = 1 - off[len(off) // 2] / middle, 1 - statistics.pstdev(gaps) / statistics.fmean(gaps) * (len(gaps) / len(gaps)) ** 0.5
    assert rows["buoy"]["score"] == pytest.approx(0.45 * timing + 0.25 * steady + 0.15 + 0.15, abs=2e-3)
    assert set(found(det.beaconing, tables, use_allowlist=0)) == {"buoy", "tide", "late"}
    assert set(found(det.beaconing, tables, min_conns=91)) == set()


def test_long_connections(tables):
    rows = found(det.long_connections, tables)
    assert {k: v["max_duration_sec"] for k, v in rows.items()} == {"anchor": 10800, "dredger": 32400}
    assert set(found(det.long_connections, tables, use_allowlist=0)) == {"anchor", "dredger", "mooring"}
    assert set(found(det.long_connections, tables, "2031-03-12 02:00:00", "2031-03-12 04:00:00")) == {"dredger"}
    assert set(found(det.long_connections, tables, lookback_hours=5)) == {"anchor"}


@pytest.mark.parametrize("hours", [168, 24 * 40])
def test_rare_fingerprint(tables, hours):
    rows = found(det.rare_tls_fingerprint, tables, baseline_hours=hours)
    assert {k: (v["severity"], v["score"]) for k, v in rows.items()} == {"flare": ("medium", 1.0)}


def test_rare_fingerprint_exceptions_and_wider_limits(tables):
    rows = found(det.rare_tls_fingerprint, tables, max_seen=40, max_hosts=9, use_allowlist=0)
    assert {"crew1", "crew2", "crew3", "forger", "flare"} <= set(rows)
    assert "crew1" not in found(det.rare_tls_fingerprint, tables, max_seen=40, max_hosts=9)


def test_rare_fingerprint_window_longer_than_baseline(tables):
    assert found(det.rare_tls_fingerprint, tables, baseline_hours=2) == {}
    assert set(found(det.rare_tls_fingerprint, tables, baseline_hours=17)) == {"flare"}


def test_suspicious_certificate(tables):
    rows = found(det.suspicious_certificate, tables)
    assert {k: (v["severity"], v["reasons"]) for k, v in rows.items()} == {"forger": ("high", ["self_signed", "sni_mismatch"]), "amateur": ("medium", ["self_signed"])}
    assert (rows["forger"]["cert_subject"], rows["amateur"]["cert_validation"]) == ("CN=pier", "self-signed certificate in chain")


def test_dns_tunneling(tables):
    rows = found(det.dns_tunneling, tables)
    assert set(rows) == {"smuggler"}
    assert (rows["smuggler"]["base_domain"], rows["smuggler"]["queries"], rows["smuggler"]["avg_subdomain_len"], rows["smuggler"]["qtypes"]) == ("crates.example", 80, 45.0, "TXT")


def test_nxdomain_spike(tables):
    rows = found(det.nxdomain_spike, tables, "2031-03-12 14:00:00", "2031-03-12 15:00:00", baseline_hours=14)
    assert {k: (v["queries"], v["nxdomain"], v["baseline_nxdomain_per_bucket"]) for k, v in rows.items()} == {"drifter": (40, 36, 0.0)}


def test_exfiltration(tables):
    rows = found(det.exfiltration, tables)
    assert {k: v["reasons"] for k, v in rows.items()} == {"tanker": ["upload_heavy"], "night": ["offhours_bulk_upload"]}
    assert "partner" in found(det.exfiltration, tables, use_allowlist=0)


def test_nonstandard_port(tables):
    rows = found(det.nonstandard_port, tables)
    assert {k: (v["severity"], v["protocols"]) for k, v in rows.items()} == {"odd_web": ("high", "http"), "odd_shell": ("medium", "ssh")}


def test_scanning(tables):
    rows = found(det.scanning, tables)
    assert {k: (v["scan_type"], v["attack_technique"], v["severity"], v["targets"]) for k, v in rows.items()} == {
        "knocker": ("vertical", "T1595.001", "low", 70), "sweeper": ("horizontal", "T1046", "high", 45),
    }
    assert rows["knocker"]["sample_ports"] == [2000 + 3 * i for i in range(10)]


def test_thresholds_are_monotone(tables):
    tight = set(found(det.scanning, tables, min_ports=100))
    assert tight <= set(found(det.scanning, tables, min_ports=10, min_hosts=3))


def test_registry_checks_parameters(tables):
    assert [d["id"] for d in listing()] == [f"DET-10{i}" for i in range(1, 10)]
    with pytest.raises(KeyError):
        det.scanning(tables, START, END, AS_OF, min_port=3)
    with pytest.raises(TypeError):
        det.scanning(tables, START, END, AS_OF, min_ports="3")
    with pytest.raises(KeyError):
        REGISTRY["DET-105"]({}, START, END, AS_OF)
