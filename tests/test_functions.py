import ipaddress
import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hawkspan.functions import net, text
from hawkspan.operators.medians import counted, event_gaps, grouped_median
from hawkspan.operators.samples import latest_per_key, smallest_distinct

NETS = ["10.0.0.0/8", "172.16.0.0/12", "0.0.0.0/1", "fc00::/7", "fe80::/10", "2000::/3", "192.168.1.7/32"]


def key_of(value):
    try:
        a = ipaddress.ip_address(value)
    except ValueError:
        return None
    return f"{a.version}{int(a):0{8 if a.version == 4 else 32}x}"


def test_addresses_agree_with_the_standard_library(spark):
    rng = random.Random(3)
    values = ["1.2.3.4", "01.2.3.4", "256.1.1.1", "bad", "", "::", "::1", "1::", "2001:db8::ff00:42:8329", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", ":::", "1::2::3", "12345::",
              "::ffff:1.2.3.4", "::1.2.3.400", "1:2", "FE80::A", "192.0.0.9", "192.0.0.8", "100.64.1.1", "224.0.0.1", "203.0.113.9"]
    values += [str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128))) for _ in range(150)]
    values += [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(150)]
    rows = spark.createDataFrame([(v,) for v in values], "ip string").select("ip", net.ip_key("ip").alias("k"), net.in_networks("ip", NETS).alias("n"), net.is_global_v4("ip").alias("g")).collect()
    for row in rows:
        expected = key_of(row.ip)
        assert row.k == expected
        a = ipaddress.ip_address(row.ip) if expected else None
        assert row.n == (bool(a) and any(a in ipaddress.ip_network(n) for n in NETS))
        assert row.g == (bool(a) and a.version == 4 and a.is_global)


def test_cidr_bounds_agree_with_the_standard_library(spark):
    rng = random.Random(4)
    blocks = [f"{ipaddress.IPv4Address(rng.getrandbits(32))}/{rng.randint(0, 32)}" for _ in range(80)] + [f"{ipaddress.IPv6Address(rng.getrandbits(128))}/{rng.randint(0, 128)}" for _ in range(80)]
    for row in spark.createDataFrame([(b,) for b in blocks + ["1.2.3.4", "::1", "x/3", "1.2.3.4/33", "1.2.3.4/"]], "c string").select("c", net.cidr_bounds("c").alias("b")).collect():
        try:
            block = ipaddress.ip_network(row.c, strict=False)
        except ValueError:
            assert row.b is None
            continue
        assert (row.b.lo, row.b.hi) == net.network_bounds(str(block))
        assert row.b.host_bits == (ipaddress.ip_interface(row.c).ip != block.network_address)


def test_names_and_entropy(spark):
    names = ["a.b.example.com", "example.com", "localhost", "x.y.co.uk", "co.uk", "a1b2.t.exfil.test", "q.ngrok.io"]
    rows = spark.createDataFrame([(n,) for n in names], "q string").select("q", text.registered_domain("q").alias("d")).withColumn("again", text.registered_domain("d"))
    assert [r.d for r in rows.collect()] == ["example.com", "example.com", "", "y.co.uk", "co.uk", "exfil.test", "q.ngrok.io"]
    assert all(r.d == r.again for r in rows.collect())
    for row in spark.createDataFrame([("aab",), ("",), ("abcd",), ("zzzz",)], "s string").select("s", text.char_entropy("s").alias("h")).collect():
        n = len(row.s)
        assert row.h == pytest.approx(-sum(c / n * math.log2(c / n) for c in Counter(row.s).values()) if n else 0.0)
    sizes = spark.createDataFrame([(0,), (1023,), (1536,), (3 * 1024**2,)], "b bigint").select(text.readable_size("b").alias("t"), text.number_text(F.col("b") / 2, 1).alias("n")).collect()
    assert [r.t for r in sizes] == ["0.00 B", "1023.00 B", "1.50 KiB", "3.00 MiB"]
    assert [r.n for r in sizes] == ["0", "511.5", "768", "1572864"]
    assert spark.createDataFrame([("a.b.c",)], "n string").select(text.dot_suffixes("n").alias("s")).head().s == [".b.c", ".c"]


@pytest.mark.parametrize("kind", ["upper", "midpoint"])
def test_medians_and_gaps_against_sorting(spark, kind):
    rng = random.Random(5)
    events = []
    for group in ("few", "busy", "bursts", "copies"):
        at = 1_700_000_000_000_000
        for _ in range({"few": 2, "busy": 900, "bursts": 301, "copies": 400}[group]):
            at += {"few": 5_000_000, "busy": rng.randint(1, 90_000_000), "bursts": rng.choice([0, 0, 1, 7_200_000_000]), "copies": 0}[group]
            events.append((group, at))
    rows = spark.createDataFrame(events, "g string, at bigint").withColumn("n", F.lit(1).cast("long"))
    gaps = event_gaps(rows, ["g"], "at", "n")
    got = {r.g: (r.total, r.median) for r in grouped_median(gaps, ["g"], "gap", kind=kind).collect()}
    for group in ("few", "busy", "bursts", "copies"):
        times = sorted(a for g, a in events if g == group)
        steps = [b - a for a, b in zip(times, times[1:])]
        middle = sorted(steps)[len(steps) // 2] if kind == "upper" else statistics.median(steps)
        assert got[group] == (len(steps), middle)


def test_medians_keep_ties_and_small_groups_apart(spark):
    rows = spark.createDataFrame([("a", 5, 3), ("a", 5, 2), ("a", 9, 4), ("b", 1, 1)], "g string, v bigint, n bigint")
    assert [(r.g, r.median) for r in grouped_median(rows, ["g"], "v", min_count=2).collect()] == [("a", 5)]
    assert counted(rows, ["g"], "v", F.col("n")).where("v = 5").head().n == 5


def test_samples_and_latest(spark):
    rows = spark.createDataFrame([("a", x, None if x == 9 else x) for x in (9, 3, 1, 2, 2, 7)], "g string, t int, v int")
    assert smallest_distinct(rows, ["g"], F.col("v"), 3, "s").head().s == [1, 2, 3]
    assert latest_per_key(rows, ["g"], "t", ["v"]).head().v is None  # the newest row's NULL is kept
