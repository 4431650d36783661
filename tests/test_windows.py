"""All windows in one job give what one job per window gives."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from traffic import AS_OF, build

from hawkspan.functions.times import utc_datetime
from hawkspan.operators.windows import HourlyWindows
from hawkspan.plans import detections as _registered  # noqa: F401
from hawkspan.plans import findings
from hawkspan.plans.registry import REGISTRY
from hawkspan.session import stored

FIRST, LAST = datetime(2031, 3, 12, 3), datetime(2031, 3, 13, 2)
LOW = {
    "DET-101": {"min_conns": 10, "min_score": 0.1, "min_median_interval_s": 0.0}, "DET-102": {"lookback_hours": 30}, "DET-103": {"baseline_hours": 9, "max_seen": 12, "max_hosts": 2},
    "DET-105": {"min_queries": 5, "min_unique_subdomains": 2, "min_avg_sub_len": 1.0, "min_avg_entropy": 0.1}, "DET-106": {"min_nx": 1, "min_nx_ratio": 0.01, "min_unique_nx_domains": 1, "spike_factor": 0.5, "baseline_hours": 5},
    "DET-107": {"min_upload_bytes": 500, "min_upload_bytes_offhours": 500, "min_pcr": -0.5}, "DET-109": {"min_ports": 2, "min_hosts": 3},
}


@pytest.fixture(scope="module")
def tables(spark):
    return {name: rows.cache() for name, rows in build(spark).items()}


@pytest.mark.parametrize("detection_id", sorted(REGISTRY))
def test_hourly_windows_equal_a_loop(tables, detection_id):
    params, hours = LOW.get(detection_id, {}), 7
    together = REGISTRY[detection_id].hourly(tables, FIRST, LAST, AS_OF, hours, **params)
    names = [c for c in together.columns if c != "window_end"]
    got = {}
    for row in together.collect():
        got.setdefault(row["window_end"], []).append(str([row[n] for n in names]))
    assert got and len(got) > 3
    ends = [datetime(2031, 3, 12, h) for h in (12, 14, 17)]
    for end in ends:
        alone = REGISTRY[detection_id](tables, end - timedelta(hours=hours), end, AS_OF, **params)
        want = Counter(str([row[n] for n in names]) for row in alone.collect())
        assert Counter(got.get(end, [])) == want, end


def test_a_name_that_comes_late_leaves_out_only_the_windows_that_saw_it(tables):
    rows = REGISTRY["DET-101"].hourly(tables, FIRST, LAST, AS_OF, 7, **LOW["DET-101"]).where("src = '10.44.0.48'").collect()
    assert {r.window_end.hour for r in rows if r.window_end.day == 12} == {12, 13}


def test_backfill_is_one_job_per_detection(spark, tables, tmp_path):
    now = datetime(2031, 3, 13, 0, 30)
    runs = findings.run_detections(spark, tables, now, f"{tmp_path}/hits", f"{tmp_path}/runs", backfill_hours=3).collect()
    assert len(runs) == 27 and {r.result for r in runs} == {"ok"} and all(r.backfill for r in runs)
    hits = spark.read.parquet(f"{tmp_path}/hits")
    counts = {(r.run_id, r.detection_id): r["count"] for r in hits.groupBy("run_id", "detection_id").count().collect()}
    assert {(r.run_id, r.detection_id): r.hits for r in runs if r.hits} == counts
    assert hits.where("window_end <> run_at OR window_start <> window_end - INTERVAL 24 HOURS").isEmpty()
    assert not hits.where("details LIKE '%window_end%'").count()


def test_bounds(tables):
    with pytest.raises(ValueError):
        HourlyWindows("2031-03-12 00:30:00", "2031-03-13 00:00:00")
    assert HourlyWindows("2031-03-12T09:00:00+09:00", LAST).first == datetime(2031, 3, 12)
    assert utc_datetime(datetime(2031, 1, 1, 9, tzinfo=timezone(timedelta(hours=9)))) == datetime(2031, 1, 1)
    with pytest.raises(ValueError):
        REGISTRY["DET-106"].hourly(tables, FIRST, LAST, AS_OF, bucket_minutes=45)
    with pytest.raises(ValueError):
        REGISTRY["DET-103"].hourly(tables, FIRST, LAST, AS_OF, baseline_hours=5)


def test_trailing_sums(spark):
    panes = spark.createDataFrame([("a", h, h) for h in range(10)], "g string, pane bigint, v bigint")
    asked = spark.createDataFrame([("a", 5), ("a", 12), ("a", 40), ("b", 5)], "g string, end_no bigint")
    scope = HourlyWindows(FIRST, LAST)
    got = {(r.g, r.end_no): r.total for r in scope.trailing_sums(panes, ["g"], "v", asked, 3).collect()}
    assert got == {("a", 5): 2 + 3 + 4, ("a", 12): 9, ("a", 40): 0, ("b", 5): 0}
    assert scope.trailing_sums(panes, ["g"], "v", asked.where(F.col("end_no") == 12), 3, 4).head().total == 5 + 6 + 7


def test_only_groups_that_can_reach_the_least_are_handed_out(spark):
    """every group that reaches the least in a window is whole there; groups that never can are not repeated for 24 windows."""
    rng = random.Random(3)
    sparse = [(f"s{i}", i % 50, 1_000_000 + rng.randrange(400 * 3600)) for i in range(300)]
    dense = [("busy", rng.randrange(40), 1_000_000 + rng.randrange(400 * 3600)) for _ in range(1500)]
    rows = spark.createDataFrame(sparse + dense, "src string, port int, at long").withColumn("ts", F.timestamp_seconds("at"))
    scope = HourlyWindows("1970-01-12 12:00:00", "1970-01-30 00:00:00", 24)
    measures = {"n": ("sum", F.lit(1))}

    def many(df):
        groups = df.groupBy("window_end", "src").agg(F.count("*").alias("ports"), F.sum("n").alias("n")).where("ports >= 20")
        return sorted(map(tuple, groups.collect()))

    whole, fewer = scope.grouped(rows, ["src", "port"], measures), scope.grouped_where_many(rows, ["src", "port"], measures, ["src"], 20)
    assert many(whole) == many(fewer) and len(many(whole)) > 100
    assert {r.src for r in fewer.select("src").distinct().collect()} == {"busy"}


def test_panes_that_lie_together_are_handed_out_without_moving(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(f"s{rng.randrange(9)}", f"p{rng.randrange(3)}", rng.randrange(90), FIRST + timedelta(minutes=rng.randrange(1500))) for _ in range(900)], "src string, kind string, size int, ts timestamp")
    scope, measures = HourlyWindows(FIRST, LAST, 5), {"n": ("sum", F.lit(1)), "most": ("max", F.col("size"))}
    handed = []

    def even(panes):
        handed.append(panes.count())
        return panes.where("src <> 's3'").withColumn("first_letter", F.substring("kind", 1, 1))

    moved = scope.grouped(rows.where("src <> 's3'"), ["src", "kind"], measures)
    still = scope.grouped(rows, ["src", "kind"], measures, each=even, together=["src"])
    again = still.groupBy("window_end", "src").agg(F.sum("n"))
    assert Counter(map(str, still.drop("first_letter").collect())) == Counter(map(str, moved.collect()))
    assert set(still.columns) == {*moved.columns, "first_letter"} and handed[0] == rows.select("src", "kind", F.date_trunc("hour", "ts")).distinct().count()
    assert "hashpartitioning(window_end" in moved._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(window_end" not in again._jdf.queryExecution().executedPlan().toString()


def test_long_connections_are_judged_before_windows_repeat_them(tables, monkeypatch):
    from hawkspan.plans import detections

    seen = []
    monkeypatch.setattr(detections, "_judged", lambda groups, entries, name=None: seen.append(groups.columns) or groups)
    REGISTRY["DET-102"].hourly(tables, FIRST, LAST, AS_OF, 7, **LOW["DET-102"])
    assert len(seen) == 1 and "pane" in seen[0] and "window_end" not in seen[0]


def test_names_are_taken_apart_before_windows_repeat_them(tables, monkeypatch):
    from hawkspan.plans import detections

    taken, entropy = [], detections.char_entropy
    monkeypatch.setattr(detections, "stored", lambda df, purpose, *by: (taken.append((purpose, df.columns)), stored(df, purpose, *by))[1])
    found = REGISTRY["DET-105"].hourly(tables, FIRST, LAST, AS_OF, 7, **LOW["DET-105"])
    assert taken[0][0] == "queries" and "entropy" in taken[0][1] and "pane" in taken[0][1] and "window_end" not in taken[0][1]
    assert entropy is detections.char_entropy and not found.isEmpty()


def test_connections_are_not_repeated_for_the_windows_of_a_scan(tables, monkeypatch):
    """running counts judge the shapes, so what is shuffled does not grow with the windows that hold a connection."""
    from hawkspan.plans import detections

    plans = {}

    def kept(df, purpose, *by):
        plans[purpose] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, purpose, *by)

    monkeypatch.setattr(detections, "stored", kept)
    assert not REGISTRY["DET-109"].hourly(tables, FIRST, LAST, AS_OF, 7, **LOW["DET-109"]).isEmpty()
    assert plans["vertical"].count("Exchange") == 1 and "hashpartitioning(window_end" not in plans["vertical"]


@pytest.mark.parametrize("hours,least", [(24, 3), (5, 2), (1, 1), (2, 0)])
def test_running_counts_equal_the_windows_own(spark, hours, least):
    rng = random.Random(hours)
    pick = lambda values: rng.choice(values)
    hosts = [("a", 1, 600), ("b", 9, 400), (None, 2, 400), ("c", 3, 2600)]  # c alone meets every edge between blocks
    rows = [
        (src, pick(["x", "y", None]), pick([1, 2, 3, 4, None]), pick([True, False, None]), 4_000_000 + rng.randrange(every * 3600))
        for src, n, every in hosts for _ in range(n * 100)
    ]
    rows += rows[:150]  # rows that come twice
    rows = spark.createDataFrame(rows, "src string, dst string, port int, own boolean, at long").withColumn("ts", F.timestamp_seconds("at"))
    scope = HourlyWindows(datetime(1970, 2, 16, 20), datetime(1970, 3, 20), hours)
    rows = scope.rows(rows)
    measures = {"n": ("sum", F.lit(1)), "own": ("max", F.col("own")), "first": ("min", F.col("ts")), "last": ("max", F.col("ts")), "bits": ("bits", F.col("port"))}
    for group in (["src", "dst"], ["src", "port"]):
        tries = scope.grouped(rows.dropna(subset=group), ["src", "dst", "port"], measures)
        want = tries.groupBy("window_end", *group).agg(
            F.count("*").alias("kinds"), F.sum("n").alias("n"), F.max("own").alias("own"), F.min("first").alias("first"), F.max("last").alias("last"), F.bit_or("bits").alias("bits"),
        ).where(F.col("kinds") >= least)
        got = scope.counted_where_many(rows, ["src", "dst", "port"], measures, group, least)
        assert got.columns == want.columns
        assert Counter(map(str, got.collect())) == Counter(map(str, want.collect())) and want.count() > 100
