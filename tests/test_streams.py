"""Streamed triggers, notifications and repairs against their batch forms."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hawkspan.plans import response
from hawkspan.sources.tables import TableStore
from hawkspan.streaming import triggers

NOON = datetime(2031, 3, 12, 12)


def appended(spark, stream, folder):
    def keep(rows, batch_id):
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns)


def source(spark, folder, schema, *parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_notifications_with_jittered_evaluations(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for source_ip, gaps in (("a", [0] * 70), ("b", [0, 0, 1, 0, 0, 0, 2, 0, 0]), ("c", [0] * 40 + [1] + [0] * 33)):
        minute = 0
        for gap in gaps:
            minute += 1 + gap
            rows.append(("R", source_ip, NOON + timedelta(minutes=minute, seconds=rng.randint(-14, 14))))
    rows.sort(key=lambda r: r[2])
    schema = "rule string, src_ip string, evaluated_at timestamp"
    parts = [rows[:40], rows[40:41], [rows[40]], rows[41:100], rows[100:]]
    want = response.dedupe_notifications(spark.createDataFrame(rows, schema)).select("rule", "src_ip", "notified_at", "episode").collect()
    got = appended(spark, triggers.notifications_stream(source(spark, tmp_path / "in", schema, *parts)), tmp_path).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) >= 8


def test_a_connection_logged_five_hours_late_reaches_the_trigger_by_repair(spark, tmp_path):
    schema = "ts timestamp, uid string, id_orig_h string, id_resp_p int, local_orig boolean, local_resp boolean"
    row = lambda minutes, uid, port=22: (NOON + timedelta(minutes=minutes, seconds=20), uid, "192.0.2.1", port, False, True)
    on_time, closing = [row(i % 5, f"a{i}") for i in range(29)], [row(600, "z")]
    late = [row(4, "late"), row(300, "other", 80), row(599, "fresh")]
    # Rows count as late one batch after the one that moved the watermark.
    stream = source(spark, tmp_path / "in", schema, on_time, closing, [row(601, "y", 80)], late)
    assert appended(spark, triggers.ssh_pressure_stream(stream), tmp_path / "t").count() == 0
    store = TableStore(spark, f"{tmp_path}/store")
    for _ in range(2):  # a repeated batch leaves the same rows
        writer = source(spark, tmp_path / "in", schema).writeStream.foreachBatch(triggers.late_rows_batch(store, "conn", "w")).option("checkpointLocation", f"{tmp_path}/cp{_}")
        writer.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.uid for r in store.rows("late/conn").collect()) == ["late", "other"]
    assert sorted((r.rows, r.late) for r in store.rows("late_progress/conn").collect()) == [(1, 0), (1, 0), (3, 2), (29, 0)]
    everything = spark.createDataFrame([*on_time, *closing, *late], schema)
    ssh = "id_resp_p = 22"
    fixed = triggers.repaired(response.ssh_pressure_by_minute, "conn", everything.where(ssh), store.rows("late/conn").where(ssh), "id_orig_h", "10 minutes").collect()
    batch = {r.evaluated_at: r.connections for r in response.ssh_pressure_by_minute({"conn": everything}).collect()}
    assert {r.evaluated_at: r.connections for r in fixed if r.fires} == batch and len(batch) == 6 and len(fixed) == 10


def test_state_has_a_row_per_source_and_minute(spark, tmp_path):
    schema = "timestamp timestamp, eventid string, src_ip string"
    rows = [(NOON + timedelta(seconds=1 + i % 50), "cowrie.login.failed", "192.0.2.1") for i in range(3000)]
    stream = triggers.honeypot_attackers_stream(source(spark, tmp_path / "in", schema, rows, [(NOON + timedelta(days=2), "cowrie.login.failed", "192.0.2.2")]))
    out = appended(spark, stream, tmp_path)
    want = response.honeypot_attackers_by_minute({"cowrie": spark.createDataFrame(rows, schema)})
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and want.count() == 15
    state = spark.read.format("statestore").option("batchId", 0).load(f"{tmp_path}/checkpoint")
    assert state.count() <= 2


def test_distinct_failed_domains_are_exact(spark, tmp_path):
    schema = "ts timestamp, id_orig_h string, query string, rcode_name string"
    rows = [(NOON + timedelta(seconds=i), "10.0.0.1", f"x{i % 137}.site{i % 137}.example", "NXDOMAIN" if i % 3 else "NOERROR") for i in range(590)]
    stream = triggers.nxdomain_buckets_stream(source(spark, tmp_path / "in", schema, rows[:300], rows[300:], [(NOON + timedelta(days=1), "10.0.0.2", "a.b", "NOERROR")]))
    (got,) = appended(spark, stream, tmp_path).collect()
    failed = [r for r in rows if r[3] == "NXDOMAIN"]
    assert (got.bucket, got.total, got.nx) == (NOON, 590, len(failed))
    assert got.nx_domains == spark.createDataFrame(failed, schema).select(F.substring_index("query", ".", -2)).distinct().count()


def test_a_part_arrives_in_many_files_and_as_one_batch(spark, tmp_path):
    """F14 to F17: no task writes or reads a whole table, and the parts are still batches one after the other."""
    from types import SimpleNamespace

    from acceptance.stream_queries import Arriving

    rows, seen = spark.range(1000, numPartitions=4), []
    arriving = Arriving(SimpleNamespace(spark=spark), rows, rows.where("id < 10"))

    def keep(batch, batch_id):
        seen.append((batch_id, batch.count(), len(batch.inputFiles())))

    arriving.run(arriving.rows.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start)
    assert [n for _, n, _ in seen] == [1000, 10] and len(list(__import__("pathlib").Path(arriving.folder, "000").glob("*.parquet"))) == 4


def test_repair_copies_its_arrivals_once_and_only_while_they_are_read(spark, tmp_path, monkeypatch):
    """both streams read one copy of a part, which goes when they have read it, as does the checkpoint when the stream has ended."""
    from acceptance import load_all, stream_queries
    from acceptance.catalog import CATALOG, Tables

    load_all()
    rng, folders = random.Random(11), []
    monkeypatch.setattr(stream_queries, "work_dir", lambda spark, purpose: folders.append(purpose) or f"{tmp_path}/{purpose}-{len(folders)}")
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    rows = [(2 * i, rng.randrange(9), rng.randrange(4), rng.choice([5, 6, 6]), 3.0, 70.0, "N", "F", NOON - timedelta(days=rng.randrange(3))) for i in range(240)]
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/sf/lineitem.parquet")
    got = CATALOG["stream_repair"].run(spark, f"{tmp_path}/sf")
    conn = Tables(spark, f"{tmp_path}/sf")["conn"]
    want = response.ssh_pressure_by_minute({"conn": conn}, at_least=1).select(F.date_format("evaluated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "src_ip", "connections")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 1000
    files = [str(p.relative_to(tmp_path)) for p in tmp_path.rglob("part-*.parquet")]
    assert folders.count("arriving") == 1 and not [f for f in files if f.startswith("arriving") and f.count("/") > 1]
    assert [p.name for p in tmp_path.glob("stream-*/*")] == ["result"]
    late = TableStore(spark, f"{tmp_path}/late-{folders.index('late') + 1}").rows("late/conn")
    assert late.columns == [*conn.columns, "batch"] and late.count() >= conn.count() // 3


def test_a_repair_judges_what_late_rows_touch_and_nothing_else(spark):
    rng = random.Random(13)
    schema = "ts timestamp, id_orig_h string, id_resp_p int, local_orig boolean, local_resp boolean"
    hosts = ["192.0.2.1", "192.0.2.2", "", None]
    rows = [(NOON + timedelta(seconds=rng.choice([0, 60, rng.randrange(20_000)]) + 600 * rng.randrange(40)), rng.choice(hosts), 22, False, True) for _ in range(700)]
    late = [rows[i] for i in range(0, 700, 23)]
    everything = spark.createDataFrame(rows, schema)
    for length, back in (("10 minutes", 10), ("7 minutes", 7)):
        rule = lambda t: response.ssh_pressure_by_minute(t, at_least=2, length=length)
        got = triggers.repaired(rule, "conn", everything, spark.createDataFrame(late, schema), "id_orig_h", length).collect()
        whole = {(r.evaluated_at, r.src_ip): r.connections for r in rule({"conn": everything}).collect()}
        first = lambda at: at.replace(second=0) + timedelta(minutes=at.second > 0)
        touched = {(first(r[0]) + timedelta(minutes=m), r[1]) for r in late if r[1] for m in range(back)}
        assert {(r.evaluated_at, r.src_ip) for r in got} == touched and len(got) == len(touched) > 50
        assert {(r.evaluated_at, r.src_ip): r.connections for r in got if r.fires} == {k: v for k, v in whole.items() if k in touched}
