"""Invented traffic of a small harbour office on Wednesday 2031-03-12 (UTC), one cast of machines per detection.

Machines are named; ``HOST`` gives their addresses. What each of them should lead to is written next to it.
"""

from __future__ import annotations

import hashlib
from datetime import datetime, timedelta

START, END = "2031-03-12 00:00:00", "2031-03-13 00:00:00"
AS_OF = "2031-03-13 00:00:00"
MIDNIGHT = datetime(2031, 3, 12)

NAMES = (
    "buoy",  # checks in every 45 s with little jitter: a beacon
    "tide",  # as regular, but its server name is excepted
    "gulls",  # as many contacts at random moments
    "ferry",  # regular, too few contacts
    "late",  # regular; its excepted name is logged two hours after the contacts
    "anchor",  # one session of three hours
    "mooring",  # a long session to an excepted network
    "canoe",  # a session of ten minutes
    "dredger",  # a session held from the evening before into this day
    "flare",  # the only one with its TLS fingerprint
    "crew1", "crew2", "crew3",  # share one
    "forger",  # self-signed certificate for another name
    "amateur",  # self-signed, the name fits
    "customs",  # nothing wrong
    "smuggler",  # long random names under one domain
    "clerk",  # few names under one domain
    "drifter",  # a burst of failing names
    "grumbler",  # fails all day long at a low level
    "tanker",  # heavy upload in office hours (Korea: UTC + 9)
    "night",  # bulk upload out of office hours
    "trawler",  # heavy download
    "partner",  # heavy upload to an excepted address
    "odd_web", "odd_shell", "web", "shell",  # services on usual and unusual ports
    "knocker",  # from outside: many ports of one host
    "sweeper",  # inside: one port on many hosts
    "visitor",  # a handful of connections
)
HOST = {name: f"10.44.{i // 8}.{20 + 7 * (i % 8)}" for i, name in enumerate(NAMES)} | {"knocker": "192.0.2.77"}

TYPES = {
    "conn": "ts timestamp, uid string, id_orig_h string, id_resp_h string, id_resp_p int, proto string, service string, duration double, orig_bytes bigint, resp_bytes bigint, conn_state string, history string, local_orig boolean, local_resp boolean",
    "dns": "ts timestamp, id_orig_h string, id_resp_h string, query string, qtype_name string, rcode_name string",
    "ssl": "ts timestamp, uid string, id_orig_h string, id_resp_h string, id_resp_p int, server_name string, ja3 string, ja4 string, subject string, issuer string, validation_status string, cert_chain_fps array<string>, sni_matches_cert boolean",
    "allowlist": "id string, detection_id string, match_type string, value string, reason string, expires_at timestamp, enabled boolean",
}
FINE = {"conn_state": "SF", "history": "ShADadFf"}
REFUSED = {"conn_state": "S0", "history": "S", "orig_bytes": 0, "resp_bytes": 0}


def noise(*words) -> float:
    """A number in [0, 1) that depends on the words alone."""
    return int.from_bytes(hashlib.sha256("/".join(map(str, words)).encode()).digest()[:6]) / 2**48


def clock(hour: float, seconds: float = 0.0) -> datetime:
    return MIDNIGHT + timedelta(hours=hour, seconds=seconds)


class Day:
    def __init__(self):
        self.rows = {table: [] for table in TYPES}

    def put(self, table: str, **values) -> dict:
        self.rows[table].append(values)
        return values

    def visit(self, who: str, to: str, port: int, at: datetime, **other) -> dict:
        plain = {"proto": "tcp", "service": "", "duration": 1.5, "orig_bytes": 640, "resp_bytes": 910, **FINE, "local_orig": True, "local_resp": False}
        return self.put("conn", ts=at, uid=f"V{len(self.rows['conn'])}", id_orig_h=HOST.get(who, who), id_resp_h=to, id_resp_p=port, **(plain | other))

    def shake(self, who: str, to: str, at: datetime, name: str, mark: str, **other) -> dict:
        plain = {"uid": f"T{len(self.rows['ssl'])}", "id_resp_p": 443, "subject": "", "issuer": "", "validation_status": "", "cert_chain_fps": [], "sni_matches_cert": False}
        return self.put("ssl", ts=at, id_orig_h=HOST[who], id_resp_h=to, server_name=name, ja4=mark, ja3=hashlib.md5(mark.encode()).hexdigest(), **(plain | other))

    def ask(self, who: str, name: str, at: datetime, answer: str = "NOERROR", kind: str = "A") -> None:
        self.put("dns", ts=at, id_orig_h=HOST[who], id_resp_h="10.44.9.9", query=name, qtype_name=kind, rcode_name=answer)

    def frames(self, spark) -> dict:
        return {table: spark.createDataFrame([tuple(row[c.split()[0]] for c in ddl.split(", ")) for row in self.rows[table]], ddl) for table, ddl in TYPES.items()}


def build(spark) -> dict:
    day = Day()

    for i in range(90):
        day.visit("buoy", "198.18.7.1", 8443, clock(2, 45 * i + 4 * noise("buoy", i)), orig_bytes=300)
        day.visit("gulls", "198.18.7.2", 8443, clock(24 * noise("gulls", i)), orig_bytes=int(200 + 9000 * noise("size", i)))
        contact = day.visit("tide", "198.18.7.3", 443, clock(3, 45 * i + 3 * noise("tide", i)), orig_bytes=300)
        day.shake("tide", "198.18.7.3", contact["ts"], "feed.weather.example", "t13d1516h2_tide", uid=contact["uid"])
    for i in range(12):
        day.visit("ferry", "198.18.7.4", 8443, clock(6, 45 * i))
    for i in range(60):
        contact = day.visit("late", "198.18.7.5", 443, clock(11, 50 * i), orig_bytes=300)
        day.shake("late", "198.18.7.5", contact["ts"] + timedelta(hours=2, minutes=10), "late.weather.example", "t13d1516h2_tide", uid=contact["uid"])

    day.visit("anchor", "198.18.8.1", 5223, clock(5), duration=10800.0)
    day.visit("mooring", "198.18.9.40", 5223, clock(5), duration=10800.0)
    day.visit("canoe", "198.18.8.2", 5223, clock(5), duration=600.0)
    day.visit("dredger", "198.18.8.3", 5223, clock(-6), duration=9 * 3600.0, service="ssl")

    day.shake("flare", "192.0.2.10", clock(8, 5), "lamp.example", "t13d0909h2_flare")
    for i in range(24):
        day.shake(f"crew{1 + i % 3}", "192.0.2.11", clock(8, i), "mess.example", "t13d1516h2_crew")
    forged = {"cert_chain_fps": ["aa"], "validation_status": "self signed certificate", "subject": "CN=pier", "issuer": "CN=pier"}
    day.shake("forger", "192.0.2.12", clock(9), "bank.example", "t13d1516h2_crew", **forged)
    day.shake("amateur", "192.0.2.13", clock(9), "home.example", "t13d1516h2_crew", **(forged | {"sni_matches_cert": True, "validation_status": "self-signed certificate in chain"}))
    day.shake("customs", "192.0.2.14", clock(9), "trade.example", "t13d1516h2_crew", cert_chain_fps=["bb"], validation_status="ok", sni_matches_cert=True)

    for i in range(80):
        text = hashlib.sha256(f"cargo {i}".encode()).hexdigest()[:44]
        day.ask("smuggler", f"{text}.{i % 10}.crates.example", clock(10, 3 * i), kind="TXT")
        day.ask("clerk", f"desk{i % 4}.port.example", clock(10, 3 * i))
    for i in range(40):
        day.ask("drifter", f"{hashlib.md5(f'wreck {i}'.encode()).hexdigest()[:11]}.net", clock(14, 60 + 9 * i), "NXDOMAIN" if i % 10 else "NOERROR")
    for i in range(24 * 30):
        day.ask("grumbler", "lost.port.example" if i % 15 == 0 else "found.port.example", clock(0, 120 * i), "NXDOMAIN" if i % 15 == 0 else "NOERROR")

    for who, hour, to, up, down in (("tanker", 4, "198.18.10.1", 70_000_000, 90_000), ("night", 15, "198.18.10.2", 20_000_000, 40_000), ("trawler", 4, "198.18.10.3", 90_000, 70_000_000), ("partner", 4, "198.18.10.4", 70_000_000, 90_000)):
        for part in range(10):
            day.visit(who, to, 443, clock(hour, 30 * part), orig_bytes=up // 10, resp_bytes=down // 10)

    for who, port, service in (("odd_web", 4445, "http"), ("odd_shell", 2022, "ssh"), ("web", 8080, "http"), ("shell", 22, "ssh")):
        day.visit(who, "198.18.11.1", port, clock(16), service=service)

    for i in range(70):
        day.visit("knocker", "10.44.9.1", 2000 + 3 * i, clock(18, 2 * i), **REFUSED, local_orig=False, local_resp=True)
    for i in range(45):
        day.visit("sweeper", f"10.44.12.{i}", 3389, clock(19, 2 * i), **(REFUSED | {"conn_state": "REJ", "history": "Sr"}), local_resp=True)
    for i in range(4):
        day.visit("visitor", f"198.18.12.{i}", 443, clock(20, i))

    far, past = datetime(2035, 1, 1), datetime(2030, 1, 1)
    for number, (detection, kind, value, until, on) in enumerate((
        ("DET-101", "sni_suffix", ".weather.example", far, True), ("DET-102", "dst_cidr", "198.18.9.0/26", far, True), ("DET-102", "dst_ip", "198.18.8.1", past, True),
        ("DET-107", "dst_ip", "198.18.10.4", far, True), ("*", "dst_ip", "198.18.11.1", far, False), ("DET-103", "sni", "mess.example", far, True),
    )):
        day.put("allowlist", id=f"TUNE-{700 + number}", detection_id=detection, match_type=kind, value=value, reason="agreed", expires_at=until, enabled=on)
    return day.frames(spark)
