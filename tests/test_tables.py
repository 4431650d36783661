"""Stored days: closing, readers beside it, late batches, look-ups, length classes and places of origin."""

import gzip
import json
import os
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from traffic import AS_OF, build

from hawkspan import schemas
from hawkspan.functions.times import newest_day
from hawkspan.plans import detections as det
from hawkspan.plans import honeypot, traffic
from hawkspan.sources import normalize
from hawkspan.sources.tables import TableStore, length_class
from hawkspan.streaming import ingest

SOON = datetime.now(UTC) + timedelta(days=1)


def connections(spark, low, high, day="2031-03-12"):
    rows = spark.range(low, high).select(
        (F.lit(f"{day} 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("id") % 80_000)).alias("ts"), F.concat(F.lit("U"), F.col("id").cast("string")).alias("uid"),
        F.concat(F.lit("10.1."), (F.col("id") * 7919 % 250).cast("string"), F.lit("."), (F.col("id") % 200).cast("string")).alias("id_orig_h"), F.concat(F.lit("1:"), F.md5(F.col("id").cast("string"))).alias("community_id"),
        (F.col("id") % 5000 * 4.0).alias("duration"),
    )
    return normalize.fill_defaults(rows, schemas.stored("conn"))


def batches(store, table):
    return sorted(f"{d}/{b}" for d in os.listdir(store.path(table)) if d.startswith("date=") for b in os.listdir(f"{store.path(table)}/{d}"))


def names(df):
    return sorted(r.uid for r in df.select("uid").collect())


def scanned(df):
    """Rows that the scan gave out: those of row groups that no statistics, dictionary or Bloom filter ruled out."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        execution = df._jdf.queryExecution()
        execution.executedPlan().executeCollect()
        return execution.executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_closing_a_day_beside_readers(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    for number in range(6):
        store.write_batch("conn", connections(spark, 100 * number, 100 * number + 100), "wa", number)
    store.write_batch("conn", connections(spark, 600, 620, "2031-03-13"), "wa", 6)
    want = [f"U{i}" for i in range(620)]
    early = store.events("conn")
    assert store.close_day("conn", "2031-03-12") and not store.close_day("conn", "2031-03-12")
    late = store.events("conn")
    assert names(early) == names(late) == sorted(want)
    assert not any("batch=wa" in f for f in late.where("date = '2031-03-12'")._jdf.queryExecution().optimizedPlan().toString().split()) and len(batches(store, "conn")) == 8
    # A batch repeated after the day was closed is hidden; new ones of this and another writer count at once.
    store.write_batch("conn", connections(spark, 500, 600), "wa", 5)
    store.write_batch("conn", connections(spark, 700, 705), "wa", 7)
    store.write_batch("conn", connections(spark, 710, 712), "wb", 0)
    want += [f"U{i}" for i in (*range(700, 705), 710, 711)]
    assert names(store.events("conn")) == sorted(want)
    assert len(store.sweep("conn", datetime.now(UTC) - timedelta(hours=1))) == 0
    assert len(store.sweep("conn", SOON)) == 6 and names(late.where("uid <> ''")) == sorted(want[:620])
    assert names(store.events("conn")) == sorted(want)
    assert store.close_day("conn", "2031-03-12") and names(store.events("conn")) == sorted(want)
    assert len(store.sweep("conn", SOON)) == 3
    assert [b.split("=")[2][0] for b in batches(store, "conn")] == ["c", "w"] and names(store.events("conn")) == sorted(want)


def test_newest_rows_read_the_newest_day(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    for number, day in enumerate(("2031-03-12", "2031-03-13", "2031-03-11")):
        store.write_batch("conn", connections(spark, 100 * number, 100 * number + 100, day), "wa", number)
    newest = newest_day(store.events("conn"))
    assert newest.agg(F.max("ts")).head()[0] == store.events("conn").agg(F.max("ts")).head()[0]
    assert newest.count() == 100 and "Subquery" in newest._jdf.queryExecution().executedPlan().toString()
    assert traffic.ingestion_lag({"conn": store.events("conn")}, "2031-03-14 00:00:00").head().lag > 0


def test_an_unfinished_closing_does_not_count(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.write_batch("conn", connections(spark, 0, 10), "wa", 0)
    connections(spark, 0, 10).withColumn("span", F.lit(0)).write.partitionBy("span").parquet(f"{tmp_path}/conn/date=2031-03-12/batch=c-5")
    assert len(names(store.events("conn"))) == 10
    assert store.close_day("conn", "2031-03-12") and len(names(store.events("conn"))) == 10
    assert store.sweep("conn", SOON) == ["2031-03-12/batch=c-5", "2031-03-12/batch=wa-0"]


def test_sorted_files_and_bloom_filters_keep_row_groups_closed(spark, tmp_path):
    spark.conf.set("parquet.block.size", str(64 << 10))
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", str(64 << 10))
    try:
        store = TableStore(spark, str(tmp_path))
        for number in range(3):
            store.write_batch("conn", connections(spark, 20_000 * number, 20_000 * (number + 1)), "wa", number)
        store.close_day("conn", "2031-03-12")
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
        spark.conf.unset("parquet.block.size")
    rows = store.events("conn")
    assert rows.count() == 60_000
    address = rows.where("uid = 'U4711'").head().id_orig_h
    assert scanned(rows.where(F.col("id_orig_h") == address).select("uid")) < 12_000
    wanted = rows.where("uid IN ('U5', 'U44444')").select("community_id").collect()
    found = store.find("conn", "community_id", [r.community_id for r in wanted])
    assert names(found) == ["U44444", "U5"] and scanned(found.select("uid")) < 15_000
    assert store.find("conn", "community_id", ["1:none"]).count() == 0
    with pytest.raises(ValueError):
        store.find("conn", "service", ["ssl"])


def test_length_classes_prune_the_look_back(spark, tmp_path):
    seconds = [0.0, 3599.9, 3600.0, 7199.0, 7200.0, 86_400.0, None]
    rows = spark.createDataFrame([(s,) for s in seconds], "d double")
    assert [r.c for r in rows.select(length_class(F.col("d")).alias("c")).collect()] == [0, 0, 1, 1, 2, 5, 0]
    tables = build(spark)
    store = TableStore(spark, str(tmp_path))
    store.append_events("conn", normalize.fill_defaults(tables["conn"], schemas.stored("conn")))
    filed = {**tables, "conn": store.events("conn")}
    for start, end in (("2031-03-12 02:00:00", "2031-03-12 04:00:00"), ("2031-03-12 00:00:00", "2031-03-13 00:00:00")):
        shown = [sorted(map(str, det.long_connections(t, start, end, AS_OF).collect())) for t in (tables, filed)]
        assert shown[0] == shown[1] and shown[0]
    narrow = det.long_connections(filed, "2031-03-12 20:00:00", "2031-03-12 22:00:00", AS_OF, use_allowlist=0)
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "span" in plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    spans = {r.span for r in store.events("conn").select("span").distinct().collect()}
    assert spans == {0, 2, 4}
    hourly = det.long_connections.hourly(filed, "2031-03-12 02:00:00", "2031-03-12 05:00:00", AS_OF, 2)
    assert sorted(map(str, hourly.collect())) == sorted(map(str, det.long_connections.hourly(tables, "2031-03-12 02:00:00", "2031-03-12 05:00:00", AS_OF, 2).collect()))


def test_places_of_origin_from_line_to_report(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/tables")
    login = {"eventid": "cowrie.login.failed", "timestamp": "2031-03-12T10:00:00Z", "session": "s1", "src_ip": "192.0.2.9", "username": "root"}
    connect = {**login, "eventid": "cowrie.session.connect"}
    line = {"ts": 1931162400.5, "uid": "C1", "id.orig_h": "2001:db8:7::1", "id.resp_h": "10.128.0.2", "id.resp_p": 22, "local_orig": False, "local_resp": True}

    def run(number):
        os.makedirs(f"{tmp_path}/pot", exist_ok=True)
        os.makedirs(f"{tmp_path}/logs", exist_ok=True)
        with gzip.open(f"{tmp_path}/pot/2031031{number}T100000Z-a.json.gz", "wt") as out:
            out.write("\n".join(json.dumps({**e, "session": f"s{number}"}) for e in (login, connect)) + "\n")
        with open(f"{tmp_path}/logs/conn.{number}.log", "w") as out:
            out.write("\n".join(json.dumps({**line, "uid": f"C{number}{i}", "id.orig_h": ip, "local_orig": ours}) for i, (ip, ours) in enumerate((("2001:db8:7::1", False), ("192.0.2.9", False), ("10.128.0.9", True)))) + "\n")
        ingest.start_honeypot_ingest(spark, f"{tmp_path}/pot", store, f"{tmp_path}/cp{number}", available_now=True).awaitTermination()
        ingest.start_sensor_ingest(spark, f"{tmp_path}/logs", store, f"{tmp_path}/cs{number}", available_now=True, log_types=("conn",)).awaitTermination()

    run(1)  # no ranges yet
    assert {(r.src_country_code, r.src_asn) for r in store.events("cowrie").collect()} == {("", 0)}
    store.replace("geo_countries", spark.createDataFrame([("4c0000200", "4c00002ff", "AA", "Aland"), ("6" + "20010db80007" + "0" * 20, "6" + "20010db80007" + "f" * 20, "BB", "Beland")], schemas.GEO_TABLES["geo_countries"]))
    store.replace("geo_networks", spark.createDataFrame([("4c0000200", "4c00002ff", 64501, "Net A")], schemas.GEO_TABLES["geo_networks"]))
    run(2)  # new checkpoints: everything is read again, honeypot events that are known are not stored twice
    pot = store.events("cowrie").collect()
    assert sorted((r.session, r.eventid, r.src_country, r.src_asn, r.src_as_org) for r in pot if r.session == "s2") == [("s2", "cowrie.login.failed", "Aland", 64501, "Net A"), ("s2", "cowrie.session.connect", "Aland", 64501, "Net A")]
    assert len(pot) == 4
    conn = store.events("conn").where("uid LIKE 'C2%'")
    assert sorted((r.direction, r.remote_ip, r.remote_country_code, r.remote_asn) for r in conn.collect()) == [("inbound", "192.0.2.9", "AA", 64501), ("inbound", "2001:db8:7::1", "BB", 0), ("internal", "", "", 0)]
    tables = {"conn": conn, "cowrie": store.events("cowrie"), "lab_addresses": spark.createDataFrame([], schemas.STATE["lab_addresses"])}
    span = ("2031-01-01 00:00:00", "2032-01-01 00:00:00")
    assert [(r.country_code, r.connections) for r in honeypot.inbound_by_country(tables, span).orderBy("country_code").collect()] == [("AA", 1), ("BB", 1)]
    assert sorted((r.country, r.sources) for r in honeypot.top_countries(tables, span).collect()) == [("(unknown)", 1), ("Aland", 1)]


def test_a_new_checkpoint_overwrites_nothing(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/tables")
    event = {"eventid": "cowrie.login.failed", "timestamp": "2031-03-12T10:00:00Z", "session": "s", "src_ip": "192.0.2.9", "username": "first"}
    forged = {**event, "timestamp": "1971-01-01T00:00:00Z", "username": "forged"}
    for number, content in enumerate(([event], [{**event, "username": "second"}, forged])):
        os.makedirs(f"{tmp_path}/in{number}")
        with gzip.open(f"{tmp_path}/in{number}/2031031{number}T100000Z-a.json.gz", "wt") as out:
            out.write("\n".join(map(json.dumps, content)) + "\n")
        ingest.start_honeypot_ingest(spark, f"{tmp_path}/in{number}", store, f"{tmp_path}/cp{number}", available_now=True).awaitTermination()
    assert sorted(r.username for r in store.events("cowrie").collect()) == ["first", "forged", "second"]
    assert ingest.writer_name(spark, f"{tmp_path}/cp0") == ingest.writer_name(spark, f"{tmp_path}/cp0") != ingest.writer_name(spark, f"{tmp_path}/cp1")
