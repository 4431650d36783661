"""Block decisions: triggers, history, policy, reconciliation and the reports on them.

The decision log is append-only; the current state is always derived from the newest row per address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hawkspan.functions.net import in_networks, ip_key, is_global_v4, is_v4
from hawkspan.functions.text import power_text
from hawkspan.functions.times import instant, millis_between, plus_seconds, unit_boundaries
from hawkspan.functions.times import trailing as _trailing
from hawkspan.operators.ipjoin import cut_addresses, distinct_addresses, explode_blocks
from hawkspan.operators.later import first_later, median_later
from hawkspan.operators.samples import latest_per_key
from hawkspan.plans.common import PRODUCTION_IFACE, per_step, top, total, within

HOUR, DAY = 3600, 86400
SENSOR_NETWORK = ("10.128.0.0/9",)  # fixed value
OWN_QUERY_PATH = "/api/ds/query"  # fixed value: requests of the dashboard itself
TEST_NETWORK = ("203.0.113.0/24",)  # fixed value: accepted as public in test mode only

# Enforced or observed only, and base lifetime in seconds, per trigger.
TRIGGERS = {"honeypot": (True, 24 * HOUR), "suricata": (True, 6 * HOUR), "scanner": (False, HOUR), "manual": (True, 24 * HOUR)}
# Policy limits.
REPEAT_DAYS, REPEAT_FACTOR, MAX_TTL = 30, 4, 7 * DAY
MAX_ACTIVE, MAX_NEW, NEW_WINDOW = 200, 20, 600
EVALUATION, JITTER = 60, 30  # seconds between two evaluations of a rule, and how far one may be off
# Honeypot events that show use of a login.
HANDS_ON_EVENTS = ("cowrie.command.input", "cowrie.session.file_upload", "cowrie.session.file_download", "cowrie.session.file_download.failed")


# --- triggers --------------------------------------------------------------------------------------------------------
# Each trigger is evaluated every minute over a trailing window; ``sliding`` evaluates all minutes of a table at once.


def _hostile_logins(rows: DataFrame, *keys) -> DataFrame:
    event = F.col("eventid")
    counts = rows.where(F.col("src_ip") != "").groupBy(*keys, "src_ip").agg(
        F.count_if(event == "cowrie.login.success").alias("entered"), F.count_if(event.isin(*HANDS_ON_EVENTS)).alias("used"), F.count_if(event == "cowrie.login.failed").alias("refused")
    )
    return counts.where(((F.col("entered") >= 1) & (F.col("used") >= 1)) | (F.col("refused") >= 20))


def honeypot_attackers(t, as_of, seconds=15 * 60):
    """Sources that logged in and did something, or failed often."""
    return _hostile_logins(_trailing(t["cowrie"], "timestamp", as_of, seconds)).select("src_ip")


def _severe(rows: DataFrame, iface: str) -> DataFrame:
    return rows.where(
        (F.col("alert_severity") == 1) & (F.col("in_iface") == iface) & in_networks("dest_ip", SENSOR_NETWORK) & ~in_networks("src_ip", SENSOR_NETWORK)
        & ~F.col("http_url").startswith(OWN_QUERY_PATH)
    )


def severe_alerts(t, as_of, seconds=10 * 60, iface=PRODUCTION_IFACE):
    return _severe(_trailing(t["alert"], "timestamp", as_of, seconds), iface).groupBy("src_ip").agg(F.count("*").alias("alerts"))


def ssh_pressure(t, as_of, seconds=10 * 60, at_least=30):
    rows = _trailing(t["conn"], "ts", as_of, seconds).where((F.col("id_resp_p") == 22) & ~F.col("local_orig") & F.col("local_resp"))
    return rows.groupBy(F.col("id_orig_h").alias("src_ip")).agg(F.count("*").alias("connections")).where(F.col("connections") >= at_least)


def sliding(rows: DataFrame, ts: str, length: str, slide: str = "1 minute") -> DataFrame:
    """Rows repeated for every evaluation that sees them; ``evaluated_at`` is the end of the trailing window."""
    return rows.withColumn("evaluated_at", F.explode(F.expr(_ends(ts, length, slide))))


def _ends(ts: str, length: str, slide: str) -> str:
    # The window (end - length, end] holds ts, so the first end is the minute at or after ts.
    step = f"INTERVAL {slide}"
    first = f"timestamp_seconds(ceil(unix_micros({ts}) / 60e6) * 60)"
    return f"sequence({first}, {first} + INTERVAL {length} - {step}, {step})"


def _hostile(entered, used, refused):
    return ((entered >= 1) & (used >= 1)) | (refused >= 20)


def honeypot_attackers_by_minute(t):
    """Per-minute counts first, so a busy source is reduced before its rows are repeated for every evaluation; and of these only minutes whose
    surroundings could fire: an evaluation that sees a minute sees nothing beyond 14 minutes before and after it."""
    event = F.col("eventid")
    minute = F.timestamp_seconds(F.ceil(F.unix_micros("timestamp") / 60e6) * 60)
    counts = t["cowrie"].where(F.col("src_ip") != "").groupBy("src_ip", minute.alias("minute")).agg(
        F.count_if(event == "cowrie.login.success").alias("entered"), F.count_if(event.isin(*HANDS_ON_EVENTS)).alias("used"), F.count_if(event == "cowrie.login.failed").alias("refused")
    )
    near = Window.partitionBy("src_ip").orderBy(F.unix_seconds("minute")).rangeBetween(-14 * 60, 14 * 60)
    around = {c: F.sum(c).over(near) for c in ("entered", "used", "refused")}
    able = counts.withColumn("able", _hostile(**around)).where("able")
    seen = sliding(able, "minute", "15 minutes").groupBy("evaluated_at", "src_ip").agg(*[F.sum(c).alias(c) for c in around])
    return seen.where(_hostile(**{c: F.col(c) for c in around})).select("evaluated_at", "src_ip")


def severe_alerts_by_minute(t, iface=PRODUCTION_IFACE):
    minute = F.timestamp_seconds(F.ceil(F.unix_micros("timestamp") / 60e6) * 60)
    counts = _severe(t["alert"], iface).groupBy("src_ip", minute.alias("minute")).agg(F.count("*").alias("n"))
    return sliding(counts, "minute", "10 minutes").groupBy("evaluated_at", "src_ip").agg(F.sum("n").alias("alerts"))


def ssh_pressure_by_minute(t, at_least=30, length="10 minutes"):
    minute = F.timestamp_seconds(F.ceil(F.unix_micros("ts") / 60e6) * 60)
    rows = t["conn"].where((F.col("id_resp_p") == 22) & ~F.col("local_orig") & F.col("local_resp"))
    counts = rows.groupBy(F.col("id_orig_h").alias("src_ip"), minute.alias("minute")).agg(F.count("*").alias("n"))
    seen = sliding(counts, "minute", length).groupBy("evaluated_at", "src_ip").agg(F.sum("n").alias("connections"))
    return seen.where(F.col("connections") >= at_least)


def dedupe_notifications(firing: DataFrame, repeat_seconds: int = 1800) -> DataFrame:
    """Firing evaluations ``rule, src_ip, evaluated_at`` thinned to the first of each episode and one per repeat interval.

    An episode ends when an evaluation is missing; evaluations may come up to half a minute early or late. Within an episode
    the repeats follow from the time since its start, so no running state is needed.
    """
    keys = ["rule", "src_ip"]
    # Episodes start at gaps; the running maximum of start times carries them forward, per key over its minutes.
    order = Window.partitionBy(*keys).orderBy("evaluated_at")
    gap = F.unix_seconds("evaluated_at") - F.unix_seconds(F.lag("evaluated_at").over(order))
    started = F.when(gap.isNull() | (gap > EVALUATION + JITTER), F.col("evaluated_at"))
    episodes = firing.select(*keys, "evaluated_at").distinct().withColumn("mark", started)
    episodes = episodes.withColumn("episode", F.max("mark").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    age = F.unix_seconds("evaluated_at") - F.unix_seconds("episode")
    turn = F.floor((age + JITTER) / repeat_seconds)
    first = F.col("mark").isNotNull() | (F.col("turn") > F.lag("turn").over(order))
    return episodes.withColumn("turn", turn).withColumn("first", first).where("first").select(*keys, F.col("evaluated_at").alias("notified_at"), "episode")


# --- state -----------------------------------------------------------------------------------------------------------


def standing(t, mode: str) -> DataFrame:
    """Newest block or release per address, with NULL expiry kept."""
    rows = t["actions"].where((F.col("mode") == mode) & F.col("action").isin("block", "release"))
    return latest_per_key(rows, ["ip"], "created_at", ["action", "trigger", "rule", "reason", "expires_at"], tie=["action", "trigger", "rule", "reason"])


def active_blocks(t, mode, as_of):
    live = (F.col("action") == "block") & (F.col("expires_at") > instant(as_of))
    return standing(t, mode).where(live).select("ip", "trigger", "rule", "reason", F.col("latest_at").alias("blocked_at"), "expires_at")


def ip_history(t, mode, as_of):
    """Per address: active, suppressed until, and blocks within the repeat period."""
    now = instant(as_of)
    blocks = t["actions"].where((F.col("mode") == mode) & (F.col("action") == "block") & (F.col("created_at") > plus_seconds(now, -float(REPEAT_DAYS * DAY))))
    earlier = blocks.groupBy("ip").agg(F.count("*").alias("earlier_blocks"))
    known = standing(t, mode).join(earlier, "ip", "full_outer")
    active = (F.col("action") == "block") & (F.col("expires_at") > now)
    return known.select(
        "ip", F.coalesce(active, F.lit(False)).alias("active"), F.when(F.col("action") == "release", F.col("expires_at")).alias("suppressed_until"),
        F.coalesce("earlier_blocks", F.lit(0)).alias("earlier_blocks"),
    )


def block_totals(t, mode, as_of):
    """One row: active blocks, and automatic blocks within the rate window."""
    now = instant(as_of)
    recent = t["actions"].where(
        (F.col("mode") == mode) & (F.col("action") == "block") & (F.col("trigger") != "manual") & (F.col("created_at") > plus_seconds(now, -float(NEW_WINDOW)))
    )
    active = active_blocks(t, mode, as_of).select(F.lit(1).alias("active"), F.lit(0).alias("fresh"))
    return active.unionByName(recent.select(F.lit(0).alias("active"), F.lit(1).alias("fresh"))).agg(
        F.coalesce(F.sum("active"), F.lit(0)).alias("active_total"), F.coalesce(F.sum("fresh"), F.lit(0)).alias("new_blocks")
    )


def rolling_new_blocks(t, mode):
    """For every automatic block: how many there were in the ten minutes up to it.

    Blocks are counted per millisecond and laid into ten-minute buckets, each count also into the next bucket; a running
    window then needs one bucket at a time.
    """
    rows = t["actions"].where((F.col("mode") == mode) & (F.col("action") == "block") & (F.col("trigger") != "manual"))
    width = NEW_WINDOW * 1000
    per_ms = rows.groupBy(F.unix_millis("created_at").alias("ms")).agg(F.count("*").alias("n")).withColumn("own", F.floor(F.col("ms") / width))
    laid = per_ms.withColumn("bucket", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    recent = F.sum("n").over(Window.partitionBy("bucket").orderBy("ms").rangeBetween(-(width - 1), 0))
    return laid.withColumn("recent", recent).where(F.col("bucket") == F.col("own")).select(F.timestamp_millis("ms").alias("created_at"), F.col("n").alias("blocks"), "recent")


def evidence(t, as_of, iface=PRODUCTION_IFACE):
    """First matching event per (trigger, ip) within the window of the trigger."""
    probe = _trailing(t["cowrie"], "timestamp", as_of, 900).groupBy(F.col("src_ip").alias("ip")).agg(F.min("timestamp").alias("evidence_at")).withColumn("trigger", F.lit("honeypot"))
    severe = _trailing(t["alert"], "timestamp", as_of, 600).where(
        (F.col("alert_severity") == 1) & (F.col("in_iface") == iface) & ~F.col("http_url").startswith(OWN_QUERY_PATH)
    ).groupBy(F.col("src_ip").alias("ip")).agg(F.min("timestamp").alias("evidence_at")).withColumn("trigger", F.lit("suricata"))
    scan = _trailing(t["conn"], "ts", as_of, 600).where(F.col("id_resp_p") == 22).groupBy(F.col("id_orig_h").alias("ip")).agg(F.min("ts").alias("evidence_at")).withColumn("trigger", F.lit("scanner"))
    return probe.unionByName(severe).unionByName(scan)


# --- policy ----------------------------------------------------------------------------------------------------------


def _listed(alerts: DataFrame, never_block: DataFrame) -> DataFrame:
    """Distinct listed addresses with the first list entry that covers them."""
    blocks = explode_blocks(never_block)
    hits = cut_addresses(distinct_addresses(alerts, "ip"), blocks).join(blocks, "block").withColumnRenamed("addr", "ip")
    return hits.groupBy("ip").agg(F.min_by(F.concat(F.lit("never-block: "), "reason", F.lit(" ("), "network", F.lit(")")), "place").alias("listed"))


def _per_trigger(values: dict[str, object]) -> Column:
    parts = " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items())
    return F.expr(f"CASE trigger {parts} END")


def decide(alerts: DataFrame, history: DataFrame, totals: DataFrame, never_block: DataFrame, as_of, test_net_ok: bool = False) -> DataFrame:
    """Decision per alert of one batch, as if the alerts were handled one after the other in (alerted_at, ip, trigger, rule) order.

    ``alerts``: alerted_at, ip, trigger, rule, ttl_seconds (NULL for the trigger's own), and optionally ``note``, an
    analyst's words, which are added to the reason of manual requests. At most MAX_ACTIVE addresses
    can be admitted in a batch and both caps only fill up, so the admitted candidates are a prefix of the candidates in
    order: the first MAX_ACTIVE + 1 are all the ranking ever has to look at.
    """
    now = instant(as_of)
    enforced = _per_trigger({k: str(v[0]).lower() for k, v in TRIGGERS.items()})
    base = F.coalesce("ttl_seconds", _per_trigger({k: v[1] for k, v in TRIGGERS.items()}))
    public = is_global_v4("ip") | in_networks("ip", TEST_NETWORK) if test_net_ok else is_global_v4("ip")
    known = alerts.join(history, "ip", "left").join(_listed(alerts, never_block), "ip", "left")
    fault = (
        F.when(enforced.isNull(), F.concat(F.lit("unknown trigger '"), "trigger", F.lit("'")))
        .when(ip_key("ip").isNull(), "invalid address")
        .when(~is_v4("ip"), "not IPv4 (the sensor has no IPv6 address)")
        .when(~public, "not a public address")
        .when(F.col("listed").isNotNull(), F.col("listed"))
        .when(F.col("suppressed_until") > now, F.concat(F.lit("suppressed by an analyst release until "), F.date_format("suppressed_until", "yyyy-MM-dd HH:mm"), F.lit(" UTC")))
    )
    judged = known.withColumn("fault", fault).withColumn("active", F.coalesce("active", F.lit(False))).withColumn("earlier_blocks", F.coalesce("earlier_blocks", F.lit(0)))
    judged = judged.withColumn("enforced", F.coalesce(enforced, F.lit(False)))
    # 4^500 is still a finite double, and with it any lifetime above zero has reached the seven-day ceiling.
    ttl = F.least(base * F.pow(F.lit(float(REPEAT_FACTOR)), F.least("earlier_blocks", F.lit(500))), F.lit(float(MAX_TTL)))
    judged = judged.withColumn("until", plus_seconds(now, ttl))

    order = F.struct("alerted_at", "ip", "trigger", "rule")
    candidates = judged.where(F.col("fault").isNull() & ~F.col("active") & F.col("enforced"))
    first = candidates.groupBy("ip").agg(F.min_by(F.struct(order.alias("place"), "trigger"), order).alias("c")).select("ip", "c.place", F.col("c.trigger").alias("first_trigger"))
    ahead = first.orderBy("place").limit(MAX_ACTIVE + 1)
    line = Window.orderBy("place")
    ranked = ahead.withColumn("rank", F.row_number().over(line)).withColumn(
        "automatic", F.sum((F.col("first_trigger") != "manual").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    )
    full = totals.select("active_total").scalar() + F.col("rank") - 1 >= MAX_ACTIVE
    rushed = totals.select("new_blocks").scalar() + F.coalesce("automatic", F.lit(0)) >= MAX_NEW
    cap = F.when(full, f"cap: {MAX_ACTIVE} active blocks").when(rushed, f"cap: {MAX_NEW} new blocks per {NEW_WINDOW // 60} min")
    ranked = ranked.withColumn("cap", cap)
    # The first refusal and its reason hold for everyone behind it.
    stop = ranked.where(F.col("cap").isNotNull()).agg(F.min(F.struct("place", "cap")).alias("stop"))
    admitted = ranked.withColumn("stop", stop.scalar()).where(F.col("stop").isNull() | (F.col("place") < F.col("stop.place"))).select("ip", F.col("place").alias("won"))

    out = judged.withColumn("place", order).join(F.broadcast(admitted), "ip", "left").withColumn("stop", stop.scalar())
    repeat = F.when(F.col("earlier_blocks") > 0, F.concat(F.lit(", repeat offender ×"), power_text(REPEAT_FACTOR, F.col("earlier_blocks")))).otherwise("")
    later = F.col("won").isNotNull() & (F.col("place") > F.col("won"))
    action = (
        F.when(F.col("fault").isNotNull(), "reject").when(F.col("active") | later, "skip").when(~F.col("enforced"), "observe")
        .when(F.col("won").isNotNull(), "block").otherwise("reject")
    )
    out = out.withColumn("action", action)
    reason = (
        F.when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("action") == "skip", "already blocked")
        .when(F.col("action") == "observe", F.concat(F.lit("trigger "), "trigger", F.lit(" is observe-only")))
        .when(F.col("action") == "block", F.concat("trigger", repeat)).otherwise(F.col("stop.cap"))
    )
    if "note" in alerts.columns:
        reason = F.when((F.col("trigger") == "manual") & (F.col("note") != ""), F.concat(reason, F.lit(": "), "note")).otherwise(reason)
    expires = F.when(F.col("action").isin("block", "observe"), F.col("until"))
    return out.select("alerted_at", "ip", "trigger", "rule", "action", reason.alias("reason"), expires.alias("expires_at"))


def action_rows(decisions: DataFrame, evidence_rows: DataFrame, mode: str, as_of, actor: str, detail: Column | None = None) -> DataFrame:
    """Rows for the decision log; repeats of an active block are not recorded."""
    kept = decisions.where(F.col("action") != "skip").join(evidence_rows, ["trigger", "ip"], "left")
    seen = F.when(F.col("action").isin("block", "observe"), F.col("evidence_at"))
    return kept.select(
        instant(as_of).alias("created_at"), "action", "ip", "trigger", "rule", "reason", seen.alias("evidence_at"), "expires_at",
        F.lit(mode).alias("mode"), F.lit(actor).alias("actor"), (detail if detail is not None else F.lit("{}")).alias("detail"),
    )


def release_rows(requests: DataFrame, mode: str, as_of, actor: str) -> DataFrame:
    """Analyst releases ``ip, reason, suppress_seconds`` (NULL: no suppression) as log rows; anything but an address is refused."""
    checked = requests.withColumn("ip", F.when(ip_key("ip").isNotNull(), F.col("ip")).otherwise(F.raise_error(F.concat(F.lit("not an address: "), "ip"))))
    until = F.when(F.col("suppress_seconds").isNotNull(), plus_seconds(instant(as_of), F.col("suppress_seconds")))
    return checked.select(
        instant(as_of).alias("created_at"), F.lit("release").alias("action"), "ip", F.lit("manual").alias("trigger"), F.lit("manual release").alias("rule"), "reason",
        F.lit(None).cast("timestamp").alias("evidence_at"), until.alias("expires_at"), F.lit(mode).alias("mode"), F.lit(actor).alias("actor"), F.lit("{}").alias("detail"),
    )


def reconcile(t, mode, as_of, firewall="blocklist"):
    """The block list to apply, compared with the last one applied; no row when nothing changes."""
    # The policy never admits more than MAX_ACTIVE addresses, which bounds the list.
    desired = active_blocks(t, mode, as_of).agg(F.array_sort(F.collect_set(F.concat("ip", F.lit("/32")))).alias("ranges"))
    good = t["applies"].where((F.col("mode") == mode) & F.col("result").isin("ok", "dry-run", "test"))
    last = good.agg(F.max_by("ranges", F.struct("applied_at", "ranges")).alias("previous"))
    none = F.lit(None).cast("array<string>")
    pair = desired.select("ranges", none.alias("previous")).unionByName(last.select(none.alias("ranges"), "previous"))
    both = pair.agg(F.max("ranges").alias("ranges"), F.array_sort(F.coalesce(F.max("previous"), F.array().cast("array<string>"))).alias("previous"))
    return both.where(F.col("ranges") != F.col("previous")).select(
        instant(as_of).alias("applied_at"), F.lit(firewall).alias("firewall"), F.lit(mode).alias("mode"), "ranges",
        F.array_except("ranges", "previous").alias("added"), F.array_except("previous", "ranges").alias("removed"),
    )


# --- reports ---------------------------------------------------------------------------------------------------------


def active_count(t, mode, as_of):
    return total(active_blocks(t, mode, as_of), "active")


def decision_count(t, span, mode, action):
    return total(within(t["actions"], span, "created_at").where((F.col("mode") == mode) & (F.col("action") == action)), "decisions")


def active_list(t, mode, as_of):
    return active_blocks(t, mode, as_of).withColumn("minutes_left", unit_boundaries("minute", instant(as_of), F.col("expires_at"))).orderBy(F.desc("blocked_at"), "ip")


def decisions_over_time(t, span, mode, step):
    rows = within(t["actions"], span, "created_at").where(F.col("mode") == mode)
    return per_step(rows, "created_at", step, "action").agg(F.count("*").alias("decisions")).orderBy("time", "action")


def rejections_by_reason(t, span, mode):
    rows = within(t["actions"], span, "created_at").where((F.col("mode") == mode) & (F.col("action") == "reject"))
    cause = F.regexp_replace("reason", r" until .*$| \(.*\)$", "").alias("cause")
    return rows.groupBy(cause).agg(F.count("*").alias("decisions"), F.countDistinct("ip").alias("ips"), F.max("created_at").alias("last")).orderBy(F.desc("decisions"), "cause")


def decision_log(t, span, mode, k=200):
    rows = within(t["actions"], span, "created_at").where(F.col("mode") == mode)
    return top(rows.select(F.col("created_at").alias("time"), "action", "ip", "trigger", "rule", "reason", "expires_at", "actor"), k, F.desc("time"), "ip", "action")


def _blocks_and_additions(t, span, mode, results) -> tuple[DataFrame, DataFrame]:
    """Blocks and the applications that added addresses, both by ``range``. A block meets every application of its address at or after it."""
    added = t["applies"].where((F.col("mode") == mode) & results).select("applied_at", F.explode("added").alias("range"))
    blocks = within(t["actions"], span, "created_at").where((F.col("mode") == mode) & (F.col("action") == "block"))
    return blocks.withColumn("range", F.concat("ip", F.lit("/32"))), added


def _alert_was_fresh() -> Column:
    started = F.try_to_timestamp(F.get_json_object("detail", "$.startsAt"))
    return started >= F.col("created_at") - F.expr("INTERVAL 20 MINUTES")


def _evidence_to_applied(blocks: DataFrame, added: DataFrame, alias: str) -> DataFrame:
    """One row: the interpolated median of the seconds from first evidence to an application, over blocks and their later applications."""
    middle = median_later(blocks, added, "range", "created_at", "evidence_at", "applied_at")
    return blocks.sparkSession.range(1).select((middle / 1000).alias(alias))


def median_evidence_to_block(t, span, mode):
    """Seconds from first evidence to the applied block, interpolated median."""
    blocks, added = _blocks_and_additions(t, span, mode, F.col("result") != "error")
    blocks = blocks.where(F.col("evidence_at").isNotNull())
    return _evidence_to_applied(blocks.where(_alert_was_fresh()) if mode == "enforce" else blocks, added, "seconds")


def mean_time_to_respond(t, as_of, days=30):
    """Median seconds from evidence to confirmed block of automatic, freshly alerted blocks."""
    since = plus_seconds(instant(as_of), -days * float(DAY))
    blocks, added = _blocks_and_additions(t, (since, None), "enforce", F.col("result") == "ok")
    blocks = blocks.where((F.col("trigger") != "manual") & F.col("evidence_at").isNotNull() & (F.col("created_at") > since) & _alert_was_fresh())
    return _evidence_to_applied(blocks, added, "mttr")


def time_to_block(t, span, mode, k=50):
    blocks, added = _blocks_and_additions(t, span, mode, F.col("result") != "error")
    decided = blocks.select("range", "ip", "trigger", "evidence_at", F.col("created_at").alias("decided_at")).distinct()
    first = first_later(decided, added, "range", "decided_at", "applied_at").drop("range")
    timed = first.withColumn("evidence_to_block_s", F.bround(millis_between(F.col("evidence_at"), F.col("applied_at")) / 1000, 1)).withColumn(
        "decision_to_block_s", F.bround(millis_between(F.col("decided_at"), F.col("applied_at")) / 1000, 1)
    )
    return top(timed, k, F.desc("decided_at"), "ip")


def last_reconciler_result(t, mode, as_of):
    newest = t["applies"].where(F.col("mode") == mode).agg(F.max_by("result", F.struct("applied_at", "result")).alias("result"), F.max("applied_at").alias("at"))
    minutes = unit_boundaries("minute", F.col("at"), instant(as_of)).cast("string")
    return newest.select(F.concat("result", F.lit(" · "), minutes, F.lit(" min ago")).alias("last"))


def firewall_changes(t, span, mode, k=50):
    rows = within(t["applies"], span, "applied_at").where(F.col("mode") == mode).select(
        "applied_at", "result", F.size("ranges").alias("listed"), F.array_join("added", " ").alias("added"), F.array_join("removed", " ").alias("removed"), "duration_ms", "error"
    )
    return top(rows, k, F.desc("applied_at"), "added", "removed")


def daily_decisions(t, span):
    kind = F.concat("action", F.lit(" · "), "mode").alias("decision")
    rows = within(t["actions"], span, "created_at").where(F.col("mode") != "test")
    return rows.groupBy(F.date_trunc("day", "created_at").alias("time"), kind).agg(F.count("*").alias("decisions")).orderBy("time", "decision")


def without_test_rows(actions: DataFrame) -> DataFrame:
    return actions.where(F.col("mode") != "test")

