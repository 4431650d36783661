"""The nine behaviour detections.

Each plan reduces the event rows with map-side aggregation first, judges thresholds on the small aggregate, and only
then fetches the samples its findings show. A plan gets its rows and first groups from a scope, which stands for one window or for
many; with many, ``window_end`` leads the keys of every later step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hawkspan.functions.net import LOCAL_NETWORKS, in_networks
from hawkspan.functions.text import char_entropy, number_text, present, readable_size, registered_domain, subdomain_text
from hawkspan.functions.times import bucket_start, instant, plus_seconds, time_slice, utc_datetime
from hawkspan.operators.allowlist import active_entries, without_excepted_addresses, without_excepted_names
from hawkspan.operators.medians import attach, by_kind, frequent, grouped_median, measure_table, sliding_measure_table
from hawkspan.operators.samples import smallest_distinct
from hawkspan.operators.suffixes import with_domain
from hawkspan.operators.windows import MERGE, OneWindow, hour_of
from hawkspan.plans.registry import COMMON_COLUMNS, detection
from hawkspan.session import stored
from hawkspan.sources.tables import length_class

PAIR = ["src", "dst", "dst_port"]
HOUR = 3600


def _is_outbound() -> Column:
    return F.col("local_orig") & ~F.col("local_resp")


# Ports on which a recognised service is expected. Other services are not judged.
STANDARD_PORTS = {
    "http": (80, 8080, 8000, 8008, 8888, 3128),
    "ssl": (443, 8443, 993, 995, 465, 636, 853, 989, 990, 5061, 5986, 6443),
    "ssh": (22,), "dns": (53, 5353, 5355), "smtp": (25, 465, 587, 2525), "ftp": (21,), "rdp": (3389,),
    "dhcp": (67, 68), "ntp": (123,), "sip": (5060, 5061), "irc": (6667, 6697), "mysql": (3306,), "socks": (1080,),
}
# Ports known from remote-control tools.
SUSPICIOUS_PORTS = (4444, 4445, 1337, 31337, 6666, 6667, 8081, 9001, 9002, 50050)
# Connection states that mean the attempt failed.
FAILED_STATES = ("S0", "REJ", "RSTO", "RSTR", "RSTOS0", "SH", "OTH")


def _finding(scope, detection_id: str, severity: Column, score: Column, summary: Column, dst_port: Column | None = None) -> list[Column]:
    values = {
        "detection_id": F.lit(detection_id), "severity": severity, "score": score, "summary": summary,
        "dst_port": F.col("dst_port") if dst_port is None else dst_port,
    }
    return [*map(F.col, scope.keys), *(values.get(c, F.col(c)).alias(c) for c in COMMON_COLUMNS)]


def _level(condition: Column, yes: str = "high", no: str = "medium") -> Column:
    return F.when(condition, yes).otherwise(no)


def _outbound(tables, scope, exclude: tuple, before: float = 0.0) -> DataFrame:
    rows = scope.rows(tables["conn"], before).where(_is_outbound())
    return rows.where(~F.col("id_resp_h").isin(*exclude)) if exclude else rows


def _entries(tables, detection_id: str, as_of, p) -> DataFrame | None:
    return active_entries(tables["allowlist"], detection_id, as_of) if p.use_allowlist else None


def _named_connections(rows: DataFrame, tables, scope, entries, before: int = HOUR) -> DataFrame:
    """Connections minus those with an excepted server name; address exceptions are judged later, on the groups."""
    return rows if entries is None else scope.without_excepted(rows, tables["ssl"], entries, before)


def _judged(groups: DataFrame, entries, name: str | None = None) -> DataFrame:
    """Groups without the excepted ones. The tests look at distinct addresses and names, so the groups are written once and read again."""
    if entries is None:
        return groups
    kept = without_excepted_addresses(stored(groups, "groups"), "dst", entries)
    return kept if name is None else without_excepted_names(kept, name, entries)


def _text(column: str) -> tuple[str, Column]:
    """The measure behind "any non-empty value": the smallest one."""
    return "min", F.when(F.col(column) != "", F.col(column))


def _times() -> dict[str, tuple[str, Column]]:
    return {"first_seen": ("min", F.col("ts")), "last_seen": ("max", F.col("ts"))}


def _number(condition: Column) -> tuple[str, Column]:
    return "sum", F.when(condition, 1).otherwise(0)


def _endpoints(*extra: str | Column) -> list:
    return [F.col("id_orig_h").alias("src"), F.col("id_resp_h").alias("dst"), F.col("id_resp_p").alias("dst_port"), *extra]


def _left_out(rows: DataFrame) -> list[str]:
    """The column by which many windows tell where an excepted connection is left out."""
    return ["left_out"] if "left_out" in rows.columns else []


def _local_to_remote(rows: DataFrame, networks: tuple) -> DataFrame:
    return rows.where(in_networks("id_orig_h", networks) & ~in_networks("id_resp_h", networks))


@detection(
    "DET-101", "Beaconing", ("T1071.001",), ("conn", "ssl", "allowlist"),
    min_conns=20, target_conns=50, min_median_interval_s=5.0, min_score=0.8, exclude_dst=(), use_allowlist=1,
)
def beaconing(tables, scope, as_of, p) -> DataFrame:
    """Regular check-ins: how constant the gaps and sizes of a pair's connections are."""
    pair = [*PAIR, "proto"]
    keys = [*scope.keys, *pair]
    entries = _entries(tables, "DET-101", as_of, p)
    rows = _outbound(tables, scope, p.exclude_dst).select(*_endpoints("proto", "ts", "uid", F.col("orig_bytes").cast("long").alias("size")))
    # Counting comes first: a pair that no window has often enough never reaches the gaps, nor the look-up of its names.
    often = scope.grouped(rows, pair, {"conns": ("sum", F.lit(1))}).where(F.col("conns") >= p.min_conns)
    rows = _named_connections(frequent(rows, often, pair), tables, scope, entries).withColumn("at", F.unix_micros("ts"))
    if scope.keys:
        measures = sliding_measure_table(rows, pair, "at", "size", scope)
    else:
        measures = measure_table(rows.groupBy(*pair, "at", "size").agg(F.count("*").alias("n")), pair, "at", "n", "size")
    values = measures.where(F.col("kind").isin("gap", "size"))
    # A pair below the minimum has too few values and drops out as soon as its total is known.
    middles = grouped_median(values, [*keys, "kind"], "value", min_count=max(p.min_conns - 1, 1), alias="mid")
    spans = by_kind(measures.where(F.col("kind").isin("first", "last")), keys, first_at=("first", "value"), last_at=("last", "value"), conns=("first", "n"))
    pairs = by_kind(middles, keys, gap_mid=("gap", "mid"), size_mid=("size", "mid")).join(spans, keys)
    pairs = _judged(pairs.where((F.col("conns") >= p.min_conns) & (F.col("gap_mid") >= p.min_median_interval_s * 1e6)), entries)
    pairs = stored(pairs.withColumn("gap_mean", (F.col("last_at") - F.col("first_at")) / (F.col("conns") - 1)), "pairs")

    centres = pairs.select(*keys, "gap_mean", F.expr("stack(2, 'gap', gap_mid, 'size', size_mid) AS (kind, mid)"))
    around = attach(values, centres, [*keys, "kind"], spread="value").withColumn("off", F.abs(F.col("value") - F.col("mid")))
    squares = F.when(F.col("kind") == "gap", F.col("n") * F.pow(F.col("value") - F.col("gap_mean"), F.lit(2)))
    spread = around.groupBy(*keys).agg(F.sum(squares).alias("square_sum"))
    deviations = by_kind(grouped_median(around, [*keys, "kind"], "off", alias="mad"), keys, gap_mad=("gap", "mad"), size_mad=("size", "mad"))
    both = pairs.join(spread, keys).join(deviations, keys)
    scored = both.select(
        *keys, "conns", F.timestamp_micros("first_at").alias("first_seen"), F.timestamp_micros("last_at").alias("last_seen"),
        (F.col("gap_mid") / 1e6).alias("mid_s"), (F.col("gap_mad") / 1e6).alias("mad_s"),
        (F.sqrt(F.col("square_sum") / (F.col("conns") - 1)) / F.greatest(F.col("gap_mean"), F.lit(1e-3))).alias("cv"),
        F.greatest(F.lit(0.0), 1 - F.col("gap_mad") / F.greatest(F.col("gap_mid"), F.lit(1e-3))).alias("timing"),
        F.when(F.col("size_mid") == 0, F.when(F.col("size_mad") == 0, 1.0).otherwise(0.0))
        .otherwise(F.greatest(F.lit(0.0), 1 - F.col("size_mad") / F.greatest(F.col("size_mid"), F.lit(1)))).alias("sizing"),
        F.least(F.lit(1.0), F.col("conns") / p.target_conns).alias("volume"),
    ).withColumn("steadiness", F.greatest(F.lit(0.0), 1 - F.col("cv")))
    scored = scored.withColumn("raw", 0.45 * F.col("timing") + 0.25 * F.col("steadiness") + 0.15 * F.col("sizing") + 0.15 * F.col("volume"))
    text = F.concat(
        "src", F.lit(" -> "), "dst", F.lit(":"), F.col("dst_port").cast("string"), F.lit(" "), F.col("conns").cast("string"),
        F.lit(" connections, median interval "), number_text(F.col("mid_s"), 1), F.lit("s (MAD "), number_text(F.col("mad_s"), 1), F.lit("s)"),
    )
    return scored.where(F.col("raw") >= p.min_score).select(
        *_finding(scope, "DET-101", _level(F.col("raw") >= 0.9), F.bround("raw", 3), text), "proto", "conns",
        F.bround("mid_s", 2).alias("median_interval_sec"), F.bround("mad_s", 2).alias("mad_interval_sec"), F.bround("cv", 3).alias("interval_cv"),
        F.bround("timing", 3).alias("ts_score"), F.bround("steadiness", 3).alias("cv_score"), F.bround("sizing", 3).alias("size_score"),
        F.bround("volume", 3).alias("count_score"),
    ).orderBy(*scope.keys, F.desc("score"), *PAIR, "proto")


@detection(
    "DET-102", "Long connections", ("T1071",), ("conn", "ssl", "allowlist"),
    min_duration_s=3600.0, lookback_hours=72, exclude_dst=(), use_allowlist=1,
)
def long_connections(tables, scope, as_of, p) -> DataFrame:
    """Outbound sessions held open for long that overlap the window."""
    lookback = p.lookback_hours * HOUR
    ended = F.timestamp_micros(F.unix_micros("ts") + (F.col("duration") * 1000000).cast("long"))
    rows = _outbound(tables, scope, p.exclude_dst, lookback).where(F.col("duration") >= p.min_duration_s)
    if "span" in rows.columns:
        # Stored connections are filed by length: only classes that reach the minimum are opened, and of earlier days only those that reach the window.
        reach = F.timestamp_seconds(F.unix_date("date") * 86400 + 86400 + F.pow(F.lit(2), "span").cast("long") * HOUR)
        rows = rows.where((F.col("span") >= length_class(F.lit(p.min_duration_s))) & (reach >= scope.opens))
    rows = rows.withColumn("ended", ended)
    entries = _entries(tables, "DET-102", as_of, p)
    rows = _named_connections(rows, tables, scope, entries, lookback)
    keys = [*scope.keys, *PAIR, "proto"]
    # The service is part of the first grouping, so the list of services is built from a handful of rows per pair.
    measures = {
        "first_seen": ("min", F.col("ts")), "last_seen": ("max", F.col("ended")), "longest": ("max", F.col("duration")), "total": ("sum", F.col("duration")),
        "sessions": ("sum", F.lit(1)), "orig_bytes": ("sum", F.col("orig_bytes")), "resp_bytes": ("sum", F.col("resp_bytes")),
    }
    held = rows.select(*_endpoints("proto", "service", "ts", "duration", "ended", "orig_bytes", "resp_bytes", *_left_out(rows)))
    # Exceptions are judged and pairs brought together before a pane is handed out, so what windows repeat is neither written nor moved.
    by_service = scope.grouped(
        held, [*PAIR, "proto", "service"], measures, until="ended", before=lookback, each=lambda groups: _judged(groups, entries), together=[*PAIR, "proto"],
    )
    pairs = by_service.groupBy(*keys).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("longest").alias("longest"), F.sum("total").alias("total"),
        F.sum("sessions").alias("sessions"), F.sum("orig_bytes").alias("orig_bytes"), F.sum("resp_bytes").alias("resp_bytes"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("service") != "", F.col("service")))), ",").alias("services"),
    )
    text = F.concat(
        "src", F.lit(" -> "), "dst", F.lit(":"), F.col("dst_port").cast("string"), F.lit(" "), F.col("sessions").cast("string"),
        F.lit(" sessions, longest "), number_text(F.col("longest") / 60), F.lit(" min"),
    )
    score = F.bround(F.least(F.lit(1.0), F.col("longest") / (4 * p.min_duration_s)), 3)
    return pairs.orderBy(*scope.keys, F.desc(F.bround("longest")), *PAIR, "proto").select(
        *_finding(scope, "DET-102", _level(F.col("longest") >= 4 * p.min_duration_s), score, text), "proto", "services", "sessions",
        F.bround("longest").alias("max_duration_sec"), F.bround("total").alias("total_duration_sec"), "orig_bytes", "resp_bytes",
    )


def _rare_in_one_window(ssl: DataFrame, scope: OneWindow, p) -> tuple[DataFrame, bool]:
    """TLS rows of the window with a rare fingerprint, and whether ``max_seen`` bounds the rows of a fingerprint."""
    baseline = time_slice(ssl, plus_seconds(instant(scope.end), -p.baseline_hours * HOUR), scope.end)
    known = not isinstance(scope.start, Column) and not isinstance(scope.end, Column)
    if known and (utc_datetime(scope.end) - utc_datetime(scope.start)).total_seconds() <= p.baseline_hours * HOUR:
        # The window lies within the baseline. A fingerprint counts as rare only with at most max_seen rows, so one row
        # more per fingerprint is enough to tell; the rank limit drops the rest of a common one before the shuffle.
        per_mark = Window.partitionBy("ja4")
        few = baseline.withColumn("place", F.row_number().over(per_mark.orderBy("ts", "uid"))).where(F.col("place") <= p.max_seen + 1)
        rare = few.withColumn("seen", F.count("*").over(per_mark)).withColumn("hosts", F.size(F.collect_set("id_orig_h").over(per_mark)))
        return rare.where((F.col("seen") <= p.max_seen) & (F.col("hosts") <= p.max_hosts) & (F.col("ts") >= scope.opens)), True
    spread = baseline.groupBy("ja4").agg(F.count("*").alias("seen"), F.countDistinct("id_orig_h").cast("int").alias("hosts"))
    rare = spread.where((F.col("seen") <= p.max_seen) & (F.col("hosts") <= p.max_hosts))
    return scope.rows(ssl).join(rare, "ja4"), False


def _rare_in_each_window(ssl: DataFrame, scope, p) -> tuple[DataFrame, bool]:
    """The same for every window. Of an hour ``max_seen + 1`` rows of a fingerprint are enough, so a common one shrinks to a few rows an hour."""
    span = p.baseline_hours
    if span < scope.hours:
        raise ValueError("DET-103: for hourly windows the baseline must be as long as a window at least")
    baseline = scope.rows(ssl, (span - scope.hours) * HOUR).withColumn("pane", hour_of("ts"))
    few = baseline.withColumn("place", F.row_number().over(Window.partitionBy("ja4", "pane").orderBy("ts", "uid"))).where(F.col("place") <= p.max_seen + 1)
    few = stored(few.drop("place").withColumn("era", F.floor(F.col("pane") / span)), "few-tls")
    panes = few.groupBy("ja4", "pane").agg(F.count("*").alias("seen"))
    asked = panes.select("ja4", F.explode(scope.ends_of("pane", "pane")).alias("end_no")).distinct()
    rare = scope.trailing_sums(panes, ["ja4"], "seen", asked, span).where(F.col("total") <= p.max_seen)
    # A baseline touches at most two eras of its own length, by which its rows are found.
    eras = F.array_distinct(F.array(F.floor((F.col("end_no") - span) / span), F.floor((F.col("end_no") - 1) / span)))
    rare = rare.select("ja4", F.col("total").alias("seen"), "end_no", F.explode(eras).alias("era"))
    rows = few.join(rare, ["ja4", "era"]).where(F.col("pane").between(F.col("end_no") - span, F.col("end_no") - 1))
    marked = rows.withColumn("hosts", F.size(F.collect_set("id_orig_h").over(Window.partitionBy("ja4", "end_no"))))
    marked = marked.where((F.col("hosts") <= p.max_hosts) & (F.col("pane") >= F.col("end_no") - scope.hours))
    return marked.withColumn("window_end", F.timestamp_seconds(F.col("end_no") * HOUR)), True


@detection(
    "DET-103", "Rare TLS client fingerprint", ("T1071.001", "T1573.002"), ("ssl", "allowlist"),
    baseline_hours=168, max_seen=3, max_hosts=1, local_nets=LOCAL_NETWORKS, use_allowlist=1,
)
def rare_tls_fingerprint(tables, scope, as_of, p) -> DataFrame:
    """Client fingerprints hardly seen anywhere in the baseline that ends with the window."""
    marked = tables["ssl"].where(F.col("ja4") != "")
    rows, few = (_rare_in_each_window if scope.keys else _rare_in_one_window)(marked, scope, p)
    keys = [*scope.keys, *PAIR, "ja4"]
    flat = _local_to_remote(rows, p.local_nets).select(*_endpoints("ja4", "ja3", "server_name", "ts", "seen", "hosts", *scope.keys))
    flat = _judged(flat, _entries(tables, "DET-103", as_of, p), "server_name")
    target = F.when(F.col("server_name") == "", F.col("dst")).otherwise(F.col("server_name"))
    totals = [
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max("seen").alias("seen"), F.max("hosts").alias("hosts"),
        F.min("ja3").alias("ja3"), F.count("*").alias("sessions"),
    ]
    if few:
        # At most max_seen rows per fingerprint are left, which bounds the sets.
        sets = [F.slice(F.array_sort(F.collect_set(c)), 1, n).alias(a) for c, n, a in ((F.col("server_name"), 5, "server_names"), (target, 3, "shown"))]
        groups = flat.groupBy(*keys).agg(*totals, *sets)
    else:
        named = smallest_distinct(flat, keys, F.col("server_name"), 5, "server_names")
        groups = flat.groupBy(*keys).agg(*totals).join(named, keys).join(smallest_distinct(flat, keys, target, 3, "shown"), keys)
    text = F.concat(
        "src", F.lit(" connected to "), F.array_join("shown", ","), F.lit(" with JA4 "), "ja4", F.lit(" (seen "), F.col("seen").cast("string"), F.lit("x in baseline)")
    )
    return groups.select(
        *_finding(scope, "DET-103", _level(F.col("seen") == 1, "medium", "low"), F.bround(1 - (F.col("seen") - 1) / p.max_seen, 3), text),
        "ja4", "ja3", "server_names", "sessions", F.col("seen").alias("seen_in_baseline"), F.col("hosts").alias("hosts_in_baseline"),
    ).orderBy(*scope.keys, F.desc("score"), "first_seen", *keys)


@detection("DET-104", "Suspicious server certificate", ("T1573.002", "T1587.003"), ("ssl", "allowlist"), local_nets=LOCAL_NETWORKS, use_allowlist=1)
def suspicious_certificate(tables, scope, as_of, p) -> DataFrame:
    """Certificate problems of outbound TLS sessions, one reason per problem."""
    rows = _local_to_remote(scope.rows(tables["ssl"]), p.local_nets)
    status = F.col("validation_status")
    mismatch = (F.size("cert_chain_fps") > 0) & (F.col("server_name") != "") & ~F.col("sni_matches_cert")
    sessions = rows.select(*_endpoints("server_name", "subject", "issuer", "validation_status", "cert_chain_fps", "sni_matches_cert", "ts"))
    texts = {"cert_subject": "subject", "cert_issuer": "issuer", "cert_validation": "validation_status"}
    groups = scope.grouped(sessions, [*PAIR, "server_name"], {
        **{name: _text(column) for name, column in texts.items()}, **_times(), "sessions": ("sum", F.lit(1)),
        "is_self_signed": ("max", status.rlike("(?i)self[- ]signed certificate")), "is_mismatch": ("max", mismatch),
        "is_untrusted": ("max", status.rlike("(?i)unable to get local issuer|certificate has expired|not yet valid")),
    }).withColumns({name: F.coalesce(F.col(name), F.lit("")) for name in texts})
    faulty = groups.where(F.col("is_self_signed") | F.col("is_mismatch") | F.col("is_untrusted"))
    judged = _judged(faulty, _entries(tables, "DET-104", as_of, p), "server_name").withColumn(
        "reasons",
        present(F.when(F.col("is_self_signed"), F.lit("self_signed")), F.when(F.col("is_mismatch"), F.lit("sni_mismatch")), F.when(F.col("is_untrusted"), F.lit("untrusted"))),
    )
    target = F.when(F.col("server_name") == "", F.col("dst")).otherwise(F.col("server_name"))
    text = F.concat(
        "src", F.lit(" -> "), target, F.lit(":"), F.col("dst_port").cast("string"), F.lit(" certificate issues: "), F.array_join("reasons", ","),
        F.lit(" ("), "cert_validation", F.lit(")"),
    )
    return judged.select(
        *_finding(scope, "DET-104", _level(F.col("is_self_signed") & F.col("is_mismatch")), F.bround(F.size("reasons") / 3, 3), text),
        "server_name", "cert_subject", "cert_issuer", "cert_validation", "reasons", "sessions",
    ).orderBy(*scope.keys, F.desc("score"), "first_seen", *PAIR, "server_name")


def _with_base_domain(names: DataFrame, tables) -> DataFrame:
    """Adds the registered domain: by the table of suffix rules where there is one, else by the rule for labels under country codes."""
    if "suffix_rules" in tables:
        return with_domain(stored(names, "names"), "query", tables["suffix_rules"], "base_domain")
    return names.withColumn("base_domain", registered_domain("query"))


@detection(
    "DET-105", "DNS tunneling", ("T1071.004", "T1048"), ("dns",),
    min_queries=50, min_unique_subdomains=30, min_avg_sub_len=20.0, min_avg_entropy=3.5, exclude_domains=(),
)
def dns_tunneling(tables, scope, as_of, p) -> DataFrame:
    """Long, random, ever-changing subdomains under one registered domain."""
    rows = scope.rows(tables["dns"]).where(F.col("query") != "").select(F.col("id_orig_h").alias("src"), "query", "qtype_name", "id_resp_h", "ts")
    # Equal queries collapse before any per-character work.
    def parted(asked: DataFrame) -> DataFrame:
        names = _with_base_domain(asked, tables).withColumn("sub", subdomain_text("query", "base_domain"))
        names = names.where((F.col("base_domain") != "") & (F.col("sub") != ""))
        if p.exclude_domains:
            names = names.where(~F.col("base_domain").isin(*p.exclude_domains))
        return stored(names.withColumn("len", F.length("sub")).withColumn("entropy", char_entropy("sub")), "queries")

    # Names are taken apart before they are handed out to windows, and lie together by what they are grouped by next.
    measures = {"n": ("sum", F.lit(1)), "resolver": ("min", F.col("id_resp_h")), **_times()}
    names = scope.grouped(rows, ["src", "query", "qtype_name"], measures, each=parted, together=["src", "base_domain", "sub"])
    keys = [*scope.keys, "src", "base_domain"]
    subs = names.groupBy(*keys, "sub").agg(
        F.sum("n").alias("n"), F.min("resolver").alias("resolver"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.max("len").alias("len"), F.max("entropy").alias("entropy"),
    )
    groups = subs.groupBy(*keys).agg(
        F.sum("n").alias("queries"), F.count("*").alias("unique_subdomains"), (F.sum(F.col("n") * F.col("len")) / F.sum("n")).alias("avg_len"),
        F.max("len").alias("max_len"), (F.sum(F.col("n") * F.col("entropy")) / F.sum("n")).alias("avg_entropy"), F.min("resolver").alias("dst"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    ).where(
        (F.col("queries") >= p.min_queries) & (F.col("unique_subdomains") >= p.min_unique_subdomains)
        & (F.col("avg_len") >= p.min_avg_sub_len) & (F.col("avg_entropy") >= p.min_avg_entropy)
    )
    groups = stored(groups, "tunnels")
    flagged = stored(names.join(groups.select(*keys), keys, "left_semi").select(*keys, "qtype_name", "query"), "tunnel-names")
    types = smallest_distinct(flagged, keys, F.col("qtype_name"), 3, "types")
    samples = smallest_distinct(flagged, keys, F.col("query"), 3, "sample_queries")
    score = 0.4 * F.least(F.lit(1.0), F.col("avg_len") / 50) + 0.4 * F.least(F.lit(1.0), F.col("avg_entropy") / 5) + 0.2 * F.least(
        F.lit(1.0), F.col("unique_subdomains") / F.col("queries")
    )
    text = F.concat(
        "src", F.lit(" sent "), F.col("queries").cast("string"), F.lit(" queries under "), "base_domain", F.lit(" ("), F.col("unique_subdomains").cast("string"),
        F.lit(" distinct subdomains, avg length "), number_text(F.col("avg_len"), 1), F.lit(", entropy "), number_text(F.col("avg_entropy"), 2), F.lit(")"),
    )
    return groups.join(types, keys).join(samples, keys).select(
        *_finding(scope, "DET-105", _level((F.col("avg_entropy") >= 4.2) & (F.col("avg_len") >= 40)), F.bround(score, 3), text, F.lit(53)),
        "base_domain", "queries", "unique_subdomains", F.bround("avg_len", 1).alias("avg_subdomain_len"), F.col("max_len").alias("max_subdomain_len"),
        F.bround("avg_entropy", 3).alias("avg_subdomain_entropy"), F.array_join("types", ",").alias("qtypes"), "sample_queries",
    ).orderBy(*scope.keys, F.desc("score"), *keys)


@detection(
    "DET-106", "Suspected DGA (NXDOMAIN spike)", ("T1568.002",), ("dns",),
    bucket_minutes=10, baseline_hours=24, min_nx=20, min_nx_ratio=0.5, min_unique_nx_domains=15, spike_factor=5.0,
)
def nxdomain_spike(tables, scope, as_of, p) -> DataFrame:
    """Buckets in which one source's failed lookups pile up far beyond its usual level."""
    width = p.bucket_minutes * 60
    rows = scope.rows(tables["dns"], p.baseline_hours * HOUR).where(F.col("query") != "")
    failed = F.col("rcode_name") == "NXDOMAIN"
    flat = rows.select(F.col("id_orig_h").alias("src"), bucket_start(F.col("ts"), width).alias("bucket"), "query", "id_resp_h", failed.alias("failed"))
    keys = ["src", "bucket"]
    # Equal queries of a bucket collapse first; a source has at most one row a bucket after the second grouping.
    asked = flat.groupBy(*keys, "query", "failed").agg(F.count("*").alias("n"), F.min("id_resp_h").alias("dst"))
    buckets = _with_base_domain(asked, tables).groupBy(*keys).agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("failed"), F.col("n")).otherwise(0)).alias("nx"), F.min("dst").alias("dst"),
        F.countDistinct(F.when(F.col("failed"), F.col("base_domain"))).alias("nx_domains"),
    )
    ratio = F.col("nx") / F.col("total")
    level = F.greatest(F.col("usual"), F.lit(1.0))
    high = (F.col("nx") >= p.min_nx) & (ratio >= p.min_nx_ratio) & (F.col("nx_domains") >= p.min_unique_nx_domains)
    per_bucket = p.baseline_hours * 60 / p.bucket_minutes
    if scope.keys:
        if HOUR % width:
            raise ValueError("DET-106: for hourly windows bucket_minutes must divide an hour")
        buckets = stored(buckets.withColumn("pane", hour_of("bucket")), "buckets")
        spikes = buckets.where(high).withColumn("end_no", F.explode(scope.ends_of("pane", "pane")))
        panes = buckets.groupBy("src", "pane").agg(F.sum("nx").alias("nx"))
        usual = scope.trailing_sums(panes, ["src"], "nx", spikes, p.baseline_hours, scope.hours)
        spikes = spikes.join(usual.withColumnRenamed("total", "earlier"), ["src", "end_no"]).withColumn("usual", F.coalesce("earlier", F.lit(0)) / per_bucket)
        spikes = spikes.withColumn("window_end", F.timestamp_seconds(F.col("end_no") * HOUR))
    else:
        first = bucket_start(scope.opens, width)
        earlier = F.sum(F.when(F.col("bucket") < first, F.col("nx")).otherwise(0)).over(Window.partitionBy("src"))
        spikes = buckets.withColumn("usual", earlier / per_bucket).where((F.col("bucket") >= first) & high)
    spikes = spikes.where(F.col("nx") >= p.spike_factor * level)
    samples = smallest_distinct(flat.where("failed").join(spikes.select(*keys).distinct(), keys, "left_semi"), keys, F.col("query"), 5, "sample_nx_queries")
    score = 0.5 * F.least(F.lit(1.0), ratio) + 0.5 * F.least(F.lit(1.0), (F.col("nx") / level) / (2 * p.spike_factor))
    text = F.concat(
        "src", F.lit(" got "), F.col("nx").cast("string"), F.lit(f" NXDOMAIN in {p.bucket_minutes} min ("), number_text(100 * F.col("nx") / F.col("total")),
        F.lit("% of "), F.col("total").cast("string"), F.lit(" queries, "), F.col("nx_domains").cast("string"), F.lit(" base domains, usual "),
        number_text(F.col("usual"), 2), F.lit(" per bucket)"),
    )
    shaped = spikes.join(samples, keys).withColumn("first_seen", F.col("bucket")).withColumn("last_seen", plus_seconds(F.col("bucket"), width))
    return shaped.select(
        *_finding(scope, "DET-106", _level(ratio >= 0.8), F.bround(score, 3), text, F.lit(53)),
        F.col("total").alias("queries"), F.col("nx").alias("nxdomain"), F.col("nx_domains").alias("nxdomain_base_domains"),
        F.bround("usual", 3).alias("baseline_nxdomain_per_bucket"), "sample_nx_queries",
    ).orderBy(*scope.keys, F.desc("score"), "first_seen", "src")


@detection(
    "DET-107", "Suspected exfiltration", ("T1048", "T1041"), ("conn", "ssl", "allowlist"),
    min_upload_bytes=52428800, min_upload_bytes_offhours=10485760, min_pcr=0.6, tz="Asia/Seoul", work_start_hour=9, work_end_hour=18,
    exclude_dst=(), use_allowlist=1,
)
def exfiltration(tables, scope, as_of, p) -> DataFrame:
    """Destinations that mostly receive: heavy uploads, or bulk uploads outside business hours."""
    entries = _entries(tables, "DET-107", as_of, p)
    rows = _named_connections(_outbound(tables, scope, p.exclude_dst), tables, scope, entries)
    keys = [*scope.keys, *PAIR]
    local = F.from_utc_timestamp("ts", p.tz)
    off_hours = (F.weekday(local) >= 5) | (F.hour(local) < p.work_start_hour) | (F.hour(local) >= p.work_end_hour)
    groups = scope.grouped(rows.select(*_endpoints("ts", "orig_bytes", "resp_bytes", off_hours.alias("off_hours"), *_left_out(rows))), PAIR, {
        "up": ("sum", F.col("orig_bytes")), "down": ("sum", F.col("resp_bytes")), "up_off": ("sum", F.when(F.col("off_hours"), F.col("orig_bytes")).otherwise(0)),
        "conns": ("sum", F.lit(1)), **_times(),
    })
    up, down = F.col("up").cast("double"), F.col("down").cast("double")
    groups = groups.withColumn("balance", (up - down) / F.greatest(up + down, F.lit(1.0)))
    one_sided = F.col("balance") >= p.min_pcr
    judged = groups.withColumn("heavy", (F.col("up") >= p.min_upload_bytes) & one_sided).withColumn("late", (F.col("up_off") >= p.min_upload_bytes_offhours) & one_sided)
    judged = _judged(judged.where(F.col("heavy") | F.col("late")), entries).withColumn(
        "reasons", present(F.when(F.col("heavy"), F.lit("upload_heavy")), F.when(F.col("late"), F.lit("offhours_bulk_upload")))
    )
    judged = stored(judged, "uploads")
    named = scope.rows(tables["ssl"]).where(F.col("server_name") != "").select(*_endpoints("server_name", "ts")).join(judged.select(*PAIR).distinct(), PAIR, "left_semi")
    names = smallest_distinct(scope.grouped(named, [*PAIR, "server_name"], {}), keys, F.col("server_name"), 3, "server_names")
    shaped = judged.join(names, keys, "left").withColumn("server_names", F.coalesce("server_names", F.array().cast("array<string>")))
    score = (
        0.5 * F.least(F.lit(1.0), F.greatest(F.col("balance"), F.lit(0.0))) + 0.3 * F.least(F.lit(1.0), F.col("up") / (4 * p.min_upload_bytes))
        + F.when(F.col("late"), 0.2).otherwise(0.0)
    )
    text = F.concat(
        "src", F.lit(" -> "), F.coalesce(F.get("server_names", F.lit(0)), F.col("dst")), F.lit(":"), F.col("dst_port").cast("string"), F.lit(" sent "),
        readable_size("up"), F.lit(" / received "), readable_size("down"), F.lit(" (PCR "), number_text(F.col("balance"), 2), F.lit(", "),
        F.array_join("reasons", ","), F.lit(")"),
    )
    return shaped.select(
        *_finding(scope, "DET-107", _level(F.col("late") & (F.col("balance") >= 0.9)), F.bround(score, 3), text),
        F.col("up").alias("bytes_sent"), F.col("down").alias("bytes_received"), F.col("up_off").alias("bytes_sent_offhours"),
        F.bround("balance", 3).alias("pcr"), "conns", "server_names", "reasons",
    ).orderBy(*scope.keys, F.desc("score"), *PAIR)


@detection("DET-108", "Standard protocol on a non-standard port", ("T1571",), ("conn", "ssl", "allowlist"), include_inbound=0, suspicious_ports=SUSPICIOUS_PORTS, use_allowlist=1)
def nonstandard_port(tables, scope, as_of, p) -> DataFrame:
    """Recognised services that run on a port they are not expected on."""
    rows = scope.rows(tables["conn"]).where(F.col("service") != "")
    if p.include_inbound != 1:
        rows = rows.where(_is_outbound())
    # One bit per judged service name, so that the services of a group are a number and come with the only grouping.
    names = sorted(STANDARD_PORTS)
    bits = (f"IF(find_in_set('{s}', service) > 0 AND CAST(id_resp_p AS INT) NOT IN ({', '.join(map(str, STANDARD_PORTS[s]))}), {1 << i}, 0)" for i, s in enumerate(names))
    entries = _entries(tables, "DET-108", as_of, p)
    # A generated column: its test stays above it, so the bits of a row are found once.
    rows = rows.select("*", F.explode(F.array(F.expr(" | ".join(bits)))).alias("odd")).where(F.col("odd") > 0)
    rows = _named_connections(rows, tables, scope, entries)
    flat = rows.select(*_endpoints("ts", "local_orig", "odd", *_left_out(rows)))
    measures = {**_times(), "from_local": ("max", F.col("local_orig")), "conns": ("sum", F.lit(1)), "odd": ("bits", F.col("odd"))}
    groups = scope.grouped(flat, PAIR, measures, each=lambda found: _judged(found, entries))
    known_bad = F.col("dst_port").isin(*p.suspicious_ports)
    protocols = F.concat_ws(",", *[F.when(F.col("odd").bitwiseAND(1 << i) > 0, name) for i, name in enumerate(names)])
    score, direction = F.when(known_bad, 1.0).otherwise(0.7), F.when(F.col("from_local"), "outbound").otherwise("inbound")
    text = F.concat(
        "src", F.lit(" -> "), "dst", F.lit(":"), F.col("dst_port").cast("string"), F.lit(" speaks "), protocols, F.lit(" ("), direction, F.lit(", "),
        F.col("conns").cast("string"), F.lit(" connections)"),
    )
    return groups.orderBy(*scope.keys, F.desc(score), F.desc("conns"), *PAIR).select(
        *_finding(scope, "DET-108", _level(known_bad), score, text), protocols.alias("protocols"), direction.alias("direction"), "conns"
    )


@detection("DET-109", "Port and host scanning", ("T1046", "T1595.001"), ("conn",), min_ports=50, min_hosts=30, min_syn_ratio=3.0)
def scanning(tables, scope, as_of, p) -> DataFrame:
    """Many ports on one host, or one port on many hosts, mostly unanswered."""
    rows = scope.rows(tables["conn"]).where(F.col("proto") == "tcp")
    opened, answered = F.col("history").startswith("S"), F.col("history").contains("h")
    silent, lost = opened & ~answered, F.col("conn_state").isin(*FAILED_STATES)
    flat = rows.select(*_endpoints("ts", "local_orig", silent.alias("silent"), answered.alias("answered"), lost.alias("lost")))
    measures = {
        "attempts": ("sum", F.lit(1)), "unanswered": _number(F.col("silent")), "answered": _number(F.col("answered")), "failed": _number(F.col("lost")),
        "from_local": ("max", F.col("local_orig")), **_times(),
    }
    host, port = [*scope.keys, "src", "dst"], [*scope.keys, "src", "dst_port"]
    # Of one window both shapes are read from one table of tries: a row per source, target and port.
    tries = None if scope.keys else stored(scope.grouped(flat, PAIR, measures), "tries")

    def shape(name: str, keys: list[str], threshold: int) -> DataFrame:
        if scope.keys:
            groups = scope.counted_where_many(flat, PAIR, measures, keys[len(scope.keys):], threshold).withColumnRenamed("kinds", "targets")
        else:
            groups = tries.groupBy(*keys).agg(F.count("*").alias("targets"), *[MERGE[kind](name).alias(name) for name, (kind, _) in measures.items()])
        groups = groups.withColumn("syn_ratio", F.col("unanswered") / F.greatest("answered", F.lit(1))).withColumn("failed_share", F.col("failed") / F.col("attempts"))
        return groups.where((F.col("targets") >= threshold) & (F.col("syn_ratio") >= p.min_syn_ratio)).withColumn("scan_type", F.lit(name)).withColumn(
            "reach", F.least(F.lit(1.0), F.col("targets") / (4 * threshold))
        )

    # What the shapes give is small and written before it is sorted.
    vertical = stored(shape("vertical", host, p.min_ports), "vertical")
    if scope.keys:  # of many windows only those of hosts with a finding are unrolled
        found = flat.join(vertical.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
        tries = scope.grouped_where_many(found, PAIR, {}, ["src", "dst"], p.min_ports)
    hit = tries.join(vertical.select(*host), host, "left_semi")
    vertical = vertical.join(smallest_distinct(hit, host, F.col("dst_port"), 10, "sample_ports"), host).withColumn("dst_port", F.lit(0))
    horizontal = shape("horizontal", port, p.min_hosts).withColumn("dst", F.lit("")).withColumn("sample_ports", F.array("dst_port"))
    both = stored(vertical.unionByName(horizontal), "scans")
    upright = F.col("scan_type") == "vertical"
    text = F.concat(
        "src", F.when(F.col("from_local"), " (local)").otherwise(" (external)"), F.lit(" "), "scan_type", F.lit(" scan: "),
        F.when(upright, F.concat(F.col("targets").cast("string"), F.lit(" ports on "), "dst")).otherwise(
            F.concat(F.lit("port "), F.col("dst_port").cast("string"), F.lit(" on "), F.col("targets").cast("string"), F.lit(" hosts"))
        ),
        F.lit(", SYN:SYN-ACK "), number_text(F.col("syn_ratio"), 1), F.lit(", failed "), number_text(100 * F.col("failed_share")), F.lit("%"),
    )
    return both.select(
        *_finding(scope, "DET-109", _level(F.col("from_local"), "high", "low"), F.bround(0.6 * F.col("reach") + 0.4 * F.col("failed_share"), 3), text), "scan_type",
        F.when(F.col("from_local"), "T1046").otherwise("T1595.001").alias("attack_technique"), "targets", "attempts",
        F.bround("syn_ratio", 2).alias("syn_synack_ratio"), F.bround("failed_share", 3).alias("failed_ratio"), "sample_ports",
    ).orderBy(*scope.keys, F.desc("score"), *PAIR, "scan_type")
