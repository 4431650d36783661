"""Plans stay free of joins that pair everything with everything, of Python workers, and of hot groups in one task."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from acceptance import load_all
from acceptance.catalog import CATALOG
from hawkspan.functions.tls import tls_fingerprints
from hawkspan import session
from hawkspan.operators.ipjoin import covered_addresses, distinct_addresses, distinct_network_blocks, explode_blocks, geo_enrich, lookup_ranges, network_blocks
from hawkspan.operators.medians import attach, event_gaps
from hawkspan.plans import detections, evaluate

SMALL = "/root/testdata/sf0.001"
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas")
load_all()


@pytest.mark.parametrize("name", [
    "det_102_long_connections", "det_104_suspicious_certificate", "det_105_dns_tunneling", "det_107_exfiltration", "det_109_scanning", "decide", "geo_enrich",
    "suppress_alerts", "eval_cases", "rep_q17_findings_now", "rep_q23_alert_sources", "attack_coverage",
])
def test_no_unwanted_operators(spark, name):
    plan = CATALOG[name].run(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert [u for u in UNWANTED if u in plan] == []


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    rows = spark.range(10).select(F.timestamp_seconds(F.col("id") * 86400).alias("ts"), F.lit("a").alias("id_orig_h"), F.lit("x").alias("unused"), F.to_date(F.timestamp_seconds(F.col("id") * 86400)).alias("date"))
    rows.write.partitionBy("date").parquet(f"{tmp_path}/t")
    from hawkspan.functions.times import time_slice

    plan = time_slice(spark.read.parquet(f"{tmp_path}/t"), "1970-01-03", "1970-01-05").select("id_orig_h")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "unused" not in plan


def test_every_query_has_the_declared_columns():
    assert len(CATALOG) > 160
    for query in CATALOG.values():
        assert query.columns and (query.sql is None or "SELECT" in query.statement())


def test_a_busy_pair_is_split_by_time(spark):
    rows = spark.range(5000).select(F.lit("hot").alias("g"), (F.col("id") * 1_000_000).alias("at"), F.lit(1).cast("long").alias("n"))
    gaps = {r.gap: r.n for r in event_gaps(rows, ["g"], "at", "n").collect()}
    assert gaps == {1_000_000: 4999}


def test_geo_enrichment_of_both_families(spark):
    countries = spark.createDataFrame([("401000000", "4010000ff", "AA", "A"), ("6" + "20010db8" + "0" * 24, "6" + "20010db8" + "f" * 24, "BB", "B")], "lo string, hi string, country_code string, country string")
    networks = spark.createDataFrame([("401000000", "4010000ff", 64500, "Net")], "lo string, hi string, asn bigint, as_org string")
    rows = spark.createDataFrame([("1.0.0.7",), ("2001:db8::1",), ("9.9.9.9",), ("",), ("1.0.0.7",)], "ip string")
    got = sorted((r.ip, r.x_country_code, r.x_asn) for r in geo_enrich(rows, "ip", countries, networks, "x_").collect())
    assert got == [("", "", 0), ("1.0.0.7", "AA", 64500), ("1.0.0.7", "AA", 64500), ("2001:db8::1", "BB", 0), ("9.9.9.9", "", 0)]
    whole = spark.createDataFrame([("400000000", "4ffffffff")], "lo string, hi string")
    assert [r.block for r in explode_blocks(whole).collect()] == ["4"]


def test_aligned_blocks_hold_exactly_the_range(spark):
    rng = random.Random(7)
    pairs = [tuple(sorted((rng.randrange(16**n), rng.randrange(16**n)))) + (n,) for n in (2, 3, 4) for _ in range(60)]
    pairs += [(0, 255, 2), (16, 31, 2), (5, 5, 2), (0, 0, 2), (255, 255, 2), (0, 4095, 3), (1, 4094, 3), (0x100, 0x1FF, 3)]
    rows = [(i, f"4{lo:0{n}x}", f"4{hi:0{n}x}") for i, (lo, hi, n) in enumerate(pairs)] + [(-1, "4ff", "400"), (-2, "400", "6ff")]
    blocks = {}
    for r in explode_blocks(spark.createDataFrame(rows, "i int, lo string, hi string")).collect():
        blocks.setdefault(r.i, []).append(r.block)
    assert set(blocks) == set(range(len(pairs)))
    for i, (lo, hi, n) in enumerate(pairs):
        held = [int(b[1:] + tail, 16) if b[1:] + tail else 0 for b in blocks[i] for tail in ([f"{x:0{n - len(b) + 1}x}" for x in range(16 ** (n - len(b) + 1))] if len(b) <= n else [""])]
        assert sorted(held) == list(range(lo, hi + 1)) and len(blocks[i]) <= 30 * n


def test_a_hundred_thousand_ranges_in_one_network(spark):
    # All ranges and addresses share 2001:db8::/32; overlapping ones, too. An address meets the ranges that hold it, not its neighbours.
    ranges = spark.range(100_000).selectExpr("concat('620010db8', lpad(lower(hex(id * 16)), 8, '0'), repeat('0', 16)) AS lo", "concat('620010db8', lpad(lower(hex(id * 16 + 9)), 8, '0'), repeat('f', 16)) AS hi", "id AS asn")
    wide = spark.createDataFrame([("620010db8" + "0" * 24, "620010db8" + "f" * 24, -1)], "lo string, hi string, asn bigint")
    address = "concat('2001:db8:', hex((id * 16 + id % 12) div 65536), ':', hex((id * 16 + id % 12) % 65536), '::', hex(id % 65536)) AS ip"
    events = spark.range(0, 100_000, 7).selectExpr("id", address)
    found = lookup_ranges(events, "ip", ranges.unionByName(wide), ["asn"]).withColumnRenamed("addr", "ip").join(events, "ip")
    assert found.count() == events.count()
    assert found.where("asn <> IF(id % 12 <= 9, id, -1)").isEmpty()


def test_networks_of_any_size_cover(spark):
    nets = ["10.3.0.0/17", "198.51.100.77", "2001:db8:4::/47", "0.0.0.0/0", "not one"]
    rng = random.Random(3)
    ips = [str(ipaddress.ip_address(rng.randrange(2**32))) for _ in range(40)] + ["10.3.127.255", "10.3.128.0", "198.51.100.77", "198.51.100.78", "2001:db8:4::1", "2001:db8:5:ffff::", "2001:db8:6::", "", "x"]
    events = spark.createDataFrame([(i,) for i in ips], "ip string")
    for chosen in ([0], [1], [2], [3], [0, 1, 2], [4], []):
        blocks = network_blocks(spark.createDataFrame([(nets[i],) for i in chosen], "net string"), "net")
        got = {r.addr for r in covered_addresses(events, "ip", blocks).collect()}
        good = [ipaddress.ip_network(nets[i]) for i in chosen if i != 4]
        assert got == {i for i in ips if i and i != "x" and any(ipaddress.ip_address(i) in n for n in good)}


def test_known_fingerprint(spark):
    # The example of the published JA4 description, without its GREASE values' positions mattering.
    hello = spark.createDataFrame(
        [("u", 0, 771, [0x0A0A, 4865, 4866, 4867, 49195, 49199, 49196, 49200, 52393, 52392, 49171, 49172, 156, 157, 47, 53],
          [0x1A1A, 27, 0, 51, 16, 17513, 23, 45, 13, 5, 35, 18, 43, 65281, 11, 10, 21], [29, 23], [0], [0x0403, 0x0804, 0x0401, 0x0503, 0x0805, 0x0501, 0x0806, 0x0601], [0x2A2A, 772, 771], "h2")],
        "uid string, seq int, version int, ciphers array<int>, extensions array<int>, curves array<int>, point_formats array<int>, sig_algs array<int>, supported_versions array<int>, alpn string",
    )
    assert tls_fingerprints(hello).head().ja4 == "t13d1516h2_8daaf6152771_e5627efa2ab1"


def test_expected_findings_checker(spark):
    found = spark.createDataFrame([("DET-1", "a", ["x", "y"], "high"), ("DET-1", "b", ["x"], "low")], "detection_id string, src string, reasons array<string>, severity string")
    wanted = spark.createDataFrame(
        [("DET-1", "a", True, ["y", "x"], None), ("DET-1", "b", True, ["x"], "high"), ("DET-1", "c", True, None, None), ("DET-1", "d", False, None, None), ("DET-1", "b", False, None, None)],
        "detection_id string, src string, flag boolean, reasons array<string>, severity string",
    )
    got = sorted((r.src, r.flag, r.passed) for r in evaluate.check_expectations(found, wanted, ["reasons", "severity"]).collect())
    assert got == [("a", True, True), ("b", False, False), ("b", True, False), ("c", True, False), ("d", False, True)]


def test_repeated_rows_stay_off_the_driver(spark):
    """the copies of a group's row, whose number Spark does not foresee, are not broadcast."""
    values = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    groups = spark.range(3).select(F.col("id").alias("g"), (F.col("id") * 10).alias("mid"))
    joined = attach(values, groups, ["g"], spread="v")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.g, r.v, r.mid) for r in joined.collect()) == [(g, v, g * 10) for g in range(3) for v in range(g, 100, 3)]


def test_minutes_of_cases_stay_off_the_driver(spark):
    """neither the minutes of a case nor those of cases that no alert can meet reach a broadcast."""
    cases = spark.sql("""SELECT concat('c', id) AS case_name, timestamp_seconds(id * 86400) AS started_at, timestamp_seconds(id * 86400 + 5400) AS deadline, array(1L, 2L) AS expected_sids FROM range(400)""")
    alerts = spark.sql("""SELECT timestamp_seconds(86400 * 7 + id * 60) AS timestamp, 1L + id % 3 AS alert_signature_id, 'ens4' AS in_iface FROM range(3) UNION ALL SELECT timestamp_seconds(86400 * 9), 1L, 'other'""")
    judged = evaluate.evaluate_cases(cases, alerts, "ens4")
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [minute" not in plan and "SortMergeJoin [minute" in plan
    got = {r.case_name: (list(r.detected_sids), r.result, r.complete_ms) for r in judged.collect()}
    assert len(got) == 400 and got.pop("c7") == ([1, 2, 3], "PASS", 60000) and set(x[1] for x in got.values()) == {"FAIL"} and all(not x[0] for x in got.values())


def test_reports_over_whole_tables_see_late_rows(spark, tmp_path):
    """F6 to F11: rows after 2030 belong to the whole table where the SQL names no time."""
    import duckdb

    rows = spark.sql("""SELECT 45000000L + id AS o_orderkey, 101L + id % 3 AS o_custkey, 'F' AS o_orderstatus, 1.0D AS o_totalprice, timestamp'2000-01-01' AS o_orderdate, 'x' AS o_orderpriority FROM range(400)""")
    rows.unionByName(rows.withColumn("o_orderkey", F.col("o_orderkey") - 45000000)).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    connection.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    for name in ("rep_q14_top_server_names", "rep_q28_most_regular_pairs", "rep_q29_top_upload_destinations", "rep_q30_rarest_clients", "rep_q31_tls_without_name", "rep_q33_certificate_problems"):
        got = [tuple(r) for r in CATALOG[name].run(spark, str(tmp_path)).collect()]
        assert sorted(got, key=str) == sorted(connection.execute(CATALOG[name].statement()).fetchall(), key=str), name


def test_a_range_listed_often_meets_an_address_once(spark):
    """copies of a range, and ranges that share a block, do not multiply the addresses."""
    ranges = spark.range(3000).select(F.lit("401000000").alias("lo"), F.lit("4010000ff").alias("hi"), (F.col("id") % 7).alias("asn"))
    events = spark.range(256).select(F.concat(F.lit("1.0.0."), F.col("id").cast("string")).alias("ip"))
    found = lookup_ranges(events, "ip", ranges, ["asn"])
    assert sorted({r.asn for r in found.collect()}) == [6] and found.count() == 256
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join"):]
    assert "Aggregate [block" in join  # the blocks are reduced before they meet the addresses


def _below_the_grouping(df) -> str:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan[plan.rindex("Aggregate ["):]


def test_each_address_and_network_is_parsed_once(spark, tmp_path):
    spark.createDataFrame([("10.1.2.3",), ("10.1.2.3",), ("junk",), (None,), ("2001:db8::1",)], "ip string").write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([("10.1.0.0/16",), ("10.1.0.0/16",), ("10.1.2.3",), ("x",), (None,)], "net string").write.parquet(f"{tmp_path}/n")
    found = distinct_addresses(spark.read.parquet(f"{tmp_path}/a"), "ip")
    nets = distinct_network_blocks(spark.read.parquet(f"{tmp_path}/n"), "net")
    assert sorted(r.addr for r in found.collect()) == ["10.1.2.3", "2001:db8::1"]
    assert sorted(map(tuple, nets.collect())) == [("10.1.0.0/16", "40a01"), ("10.1.2.3", "40a010203")]
    assert "RLIKE" not in _below_the_grouping(found) and "RLIKE" not in _below_the_grouping(nets)


def test_nonstandard_ports_come_from_one_grouping(spark):
    rows = [
        ("a", "203.0.113.9", 4444, "http", True), ("a", "203.0.113.9", 4444, "ssl,http,-gssapi", True), ("a", "203.0.113.9", 4444, "smtp,x", True), ("b", "203.0.113.9", 443, "ssl,-ssl", True),
        ("b", "203.0.113.9", 443, "-http", True), ("c", "203.0.113.9", None, "ssh", True), ("d", "203.0.113.9", 80, "http,ssh", True), ("d", "203.0.113.9", 80, "nosuch,https", True),
    ]
    conn = spark.createDataFrame(rows, "id_orig_h string, id_resp_h string, id_resp_p int, service string, local_orig boolean").withColumns({"local_resp": F.lit(False), "uid": F.lit("u"), "ts": F.lit("2031-03-12 10:00:00").cast("timestamp")})
    found = detections.nonstandard_port({"conn": conn, "ssl": conn, "allowlist": conn}, "2031-03-12", "2031-03-13", "2031-03-13", use_allowlist=0)
    assert [(r.src, r.dst_port, r.protocols, r.conns, r.severity) for r in found.collect()] == [("a", 4444, "http,smtp,ssl", 3, "high"), ("d", 80, "ssh", 1, "medium")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and plan.count("find_in_set(http") == 1


def test_rules_that_repeat_are_parsed_once(spark, monkeypatch):
    from hawkspan.plans import findings

    parsed = []
    monkeypatch.setattr(findings, "distinct_network_blocks", lambda rules, ip: parsed.append(distinct_network_blocks(rules, ip)) or parsed[0])
    alerts = spark.createDataFrame([(1, 1, "40.0.7.1", "10.128.0.1"), (1, 2, "40.0.7.1", "10.128.0.1"), (1, 1, "41.0.7.1", "10.128.0.2"), (1, 1, None, "10.128.0.9")], "alert_gid long, alert_signature_id long, src_ip string, dest_ip string")
    rules = [(1, 1, "by_src", "40.0.0.0/16"), (1, 2, "by_dst", "10.128.0.2"), (1, 1, "by_either", "10.128.0.2/31"), (2, 1, "by_src", "0.0.0.0/0"), (1, 1, "by_src", "junk")] * 50
    kept = findings.suppress_alerts(alerts, spark.createDataFrame(rules, "gid long, sid long, track string, ip string"))
    assert sorted((r.alert_signature_id, r.src_ip or "") for r in kept.collect()) == [(1, ""), (2, "40.0.7.1")]
    assert len(parsed) == 1 and parsed[0].count() == 5


def test_one_window_of_scans_reads_the_connections_once(spark, tmp_path, monkeypatch):
    rows = [(f"s{i // 60 % 3}", f"h{i // 60}", i % 60) for i in range(2400)] + [("s9", "h1", 1)]
    conn = spark.createDataFrame(rows, "id_orig_h string, id_resp_h string, id_resp_p int").withColumns({"proto": F.lit("tcp"), "history": F.lit("S"), "conn_state": F.lit("S0"), "local_orig": F.lit(True), "ts": F.lit("2031-03-12 10:00:00").cast("timestamp")})
    conn.write.parquet(f"{tmp_path}/conn-rows")
    read = []

    def scans(df):
        return sum("FileScan" in line and "id_orig_h" in line for line in df._jdf.queryExecution().executedPlan().toString().splitlines())

    monkeypatch.setattr(detections, "stored", lambda df, purpose: read.append(scans(df)) or session.stored(df, purpose))
    found = detections.scanning({"conn": spark.read.parquet(f"{tmp_path}/conn-rows")}, "2031-03-12", "2031-03-13", "2031-03-13", min_ports=3, min_hosts=5)
    read.append(scans(found))
    assert sum(read) == 1 and {r.src for r in found.collect()} == {"s0", "s1", "s2"}


def test_fingerprints_are_made_once_whatever_tests_them(spark, tmp_path):
    hello = spark.createDataFrame([("u", 0, 771, [4865, 2570], [0, 16, 43], [29], [0], [1027], [772], "h2")], "uid string, seq int, version int, ciphers array<int>, extensions array<int>, curves array<int>, point_formats array<int>, sig_algs array<int>, supported_versions array<int>, alpn string")
    hello.write.parquet(f"{tmp_path}/hello")
    prints = tls_fingerprints(spark.read.parquet(f"{tmp_path}/hello")).where("ja4 <> ''").withColumn("head", F.substring_index("ja4", "_", 2))
    plan = prints._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 2 and prints.head().head.startswith("t13d01")
