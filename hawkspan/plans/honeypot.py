"""Honeypot activity and the map of where attacks come from."""

from __future__ import annotations

from pyspark.sql import functions as F

from hawkspan.functions.times import instant, newest_day, unit_boundaries
from hawkspan.operators.samples import any_text
from hawkspan.plans.common import distinct_total, excluding, lab, per_step, top, total, within

LOGIN_EVENTS = ("cowrie.login.failed", "cowrie.login.success")


def _events(t, span, role="sensor"):
    return excluding(within(t["cowrie"], span, "timestamp"), "src_ip", lab(t, role))


def _logins(t, span):
    return _events(t, span).where(F.col("eventid").isin(*LOGIN_EVENTS))


def _is_login():
    return F.col("eventid").isin(*LOGIN_EVENTS)


def login_attempts(t, span):
    return total(_logins(t, span), "attempts")


def sources(t, span):
    return distinct_total(_events(t, span).where(F.col("eventid") == "cowrie.session.connect"), "src_ip", "sources")


def accepted_logins(t, span):
    return total(_events(t, span).where(F.col("eventid") == "cowrie.login.success"), "accepted")


def commands_run(t, span):
    return total(_events(t, span).where(F.col("eventid") == "cowrie.command.input"), "commands")


def source_countries(t, span):
    rows = _events(t, span).where((F.col("eventid") == "cowrie.session.connect") & (F.col("src_country_code") != ""))
    return distinct_total(rows, "src_country_code", "countries")


def newest_event_age(t, as_of):
    return newest_day(t["cowrie"]).agg(unit_boundaries("second", F.max("timestamp"), instant(as_of)).alias("age"))


def logins_over_time(t, span, step):
    result = F.when(F.col("eventid") == "cowrie.login.success", "accepted").otherwise("failed").alias("result")
    return per_step(_logins(t, span), "timestamp", step, result).agg(F.count("*").alias("attempts")).orderBy("time", "result")


def top_countries(t, span, k=15):
    country = F.when(F.col("src_country") == "", "(unknown)").otherwise(F.col("src_country")).alias("country")
    groups = _events(t, span).groupBy(country).agg(F.countDistinct("src_ip").alias("sources"), F.count_if(_is_login()).alias("attempts"))
    return top(groups, k, F.desc("sources"), F.desc("attempts"), "country")


def top_networks(t, span, k=15):
    asn = F.when(F.col("src_asn") == 0, "(unknown)").otherwise(F.concat(F.lit("AS"), F.col("src_asn").cast("string"))).alias("asn")
    groups = _events(t, span).groupBy(asn).agg(F.min("src_as_org").alias("organization"), F.countDistinct("src_ip").alias("sources"), F.count_if(_is_login()).alias("attempts"))
    return top(groups, k, F.desc("sources"), F.desc("attempts"), "asn")


def top_usernames(t, span, k=20):
    return top(_logins(t, span).groupBy("username").agg(F.count("*").alias("attempts"), F.countDistinct("src_ip").alias("sources")), k, F.desc("attempts"), "username")


def top_passwords(t, span, k=20):
    return top(_logins(t, span).groupBy("password").agg(F.count("*").alias("attempts"), F.countDistinct("src_ip").alias("sources")), k, F.desc("attempts"), "password")


def top_credentials(t, span, k=20):
    groups = _logins(t, span).groupBy("username", "password").agg(
        F.count("*").alias("attempts"), F.countDistinct("src_ip").alias("sources"), F.count_if(F.col("eventid") == "cowrie.login.success").alias("accepted")
    )
    return top(groups, k, F.desc("attempts"), "username", "password")


def top_commands(t, span, k=20):
    rows = _events(t, span).where(F.col("eventid") == "cowrie.command.input")
    return top(rows.groupBy(F.col("input").alias("command")).agg(F.count("*").alias("runs"), F.countDistinct("src_ip").alias("sources")), k, F.desc("runs"), "command")


def ssh_clients(t, span, k=20):
    rows = _events(t, span).where(F.col("eventid").isin("cowrie.client.kex", "cowrie.client.version"))
    sessions = rows.groupBy("session").agg(F.min("src_ip").alias("source"), any_text(F.col("client_version")).alias("client_version"), any_text(F.col("hassh")).alias("hassh"))
    groups = sessions.where(F.col("hassh") != "").groupBy("client_version", "hassh").agg(F.count("*").alias("sessions"), F.countDistinct("source").alias("sources"))
    return top(groups, k, F.desc("sessions"), "client_version", "hassh")


def sources_with_sensor_visits(t, span, k=50):
    groups = _events(t, span).groupBy(F.col("src_ip").alias("source")).agg(
        F.min("src_country_code").alias("cc"), F.min("src_as_org").alias("organization"), F.count_if(_is_login()).alias("login_attempts"),
        F.count_if(F.col("eventid") == "cowrie.login.success").alias("accepted"), F.count_if(F.col("eventid") == "cowrie.command.input").alias("commands"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
    )
    busiest = top(groups, k, F.desc("login_attempts"), "source")
    # Only the k shown sources are counted on the sensor's side.
    inbound = within(t["conn"], span).where(~F.col("local_orig")).withColumnRenamed("id_orig_h", "source")
    visits = inbound.join(F.broadcast(busiest.select("source")), "source", "left_semi").groupBy("source").agg(F.count("*").alias("sensor_connections"))
    return busiest.join(visits, "source", "left").fillna(0, ["sensor_connections"]).orderBy(F.desc("login_attempts"), "source")


def recent_activity(t, span, k=100):
    rows = _events(t, span).where(F.col("eventid").isin(*LOGIN_EVENTS, "cowrie.command.input")).select(
        F.col("timestamp").alias("time"), "src_ip", F.col("src_country_code").alias("cc"), F.regexp_replace("eventid", r"^cowrie\.", "").alias("event"),
        "username", "password", F.col("input").alias("command"), "session",
    )
    return top(rows, k, F.desc("time"), "session")


# --- map -------------------------------------------------------------------------------------------------------------


def _foreign(t, span):
    return _events(t, span, None)


def _two_distincts(rows, keys, **columns):
    """Several exact distinct counts per group without repeating the input for each: one small grouping per column, joined."""
    out = None
    for alias, column in columns.items():
        part = rows.groupBy(*keys).agg(F.countDistinct(column).alias(alias))
        out = part if out is None else out.join(part, keys)
    return out


def attacks_by_country(t, span):
    rows = _foreign(t, span).where(F.col("src_country_code") != "").withColumnRenamed("src_country_code", "country_code")
    base = rows.groupBy("country_code").agg(F.min("src_country").alias("country"), F.count("*").alias("events"))
    return base.join(_two_distincts(rows, ["country_code"], sessions="session", addresses="src_ip"), "country_code").orderBy(F.desc("sessions"), "country_code")


def top_origins(t, span, k=20):
    return top(attacks_by_country(t, span).drop("events"), k, F.desc("sessions"), "country_code")


def attack_paths(t, span, k=8):
    """Per client program (HASSH): origins, sessions, what was typed and which files stayed behind."""
    sessions = _foreign(t, span).where(F.col("src_country_code") != "").groupBy("session").agg(any_text(F.col("hassh")).alias("hassh"), F.min("src_country_code").alias("cc"))
    sessions = sessions.where(F.col("hassh") != "")
    programs = top(sessions.groupBy("hassh").agg(F.count("*").alias("n")), k, F.desc("n"), "hassh").select("hassh")
    chosen = sessions.join(F.broadcast(programs), "hassh", "left_semi").withColumn("program", F.substring("hassh", 1, 8))
    rows = t["cowrie"].select("session", "src_ip", "eventid", "input", "message", "shasum").join(chosen, "session")
    key = ["program"]
    typed = F.when((F.col("eventid") == "cowrie.command.input") & (F.col("input") != ""), F.col("input"))
    base = rows.groupBy(*key).agg(
        F.array_join(F.array_sort(F.collect_set("cc")), " ").alias("arrives_from"),  # country codes: a few hundred at most
        F.substring(F.coalesce(F.min(typed), F.lit("")), 1, 46).alias("typed"),
    )
    left = rows.where(F.col("eventid").startswith("cowrie.session.file") & (F.col("shasum") != "")).select(*key, F.regexp_extract("message", 'file "([^"]+)"', 1).alias("file")).distinct()
    files = left.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("file")), ", ").alias("left_behind"))
    counts = _two_distincts(rows, key, sessions="session", addresses="src_ip")
    return base.join(counts, key).join(files, key, "left").fillna("", ["left_behind"]).orderBy(F.desc("sessions"), "program")


def inbound_by_country(t, span):
    rows = within(t["conn"], span).where((F.col("remote_country_code") != "") & (F.col("direction") == "inbound"))
    return rows.groupBy(F.col("remote_country_code").alias("country_code")).agg(
        F.min("remote_country").alias("country"), F.countDistinct("remote_ip").alias("addresses"), F.count("*").alias("connections")
    ).orderBy(F.desc("connections"), "country_code")


def alerting_networks(t, span, k=20):
    rows = within(t["alert"], span, "timestamp").where(F.col("src_country_code") != "")
    groups = rows.groupBy(F.col("src_country_code").alias("cc"), "src_asn").agg(
        F.substring(F.min("src_as_org"), 1, 30).alias("network"), F.countDistinct("src_ip").alias("addresses"), F.count("*").alias("alerts")
    )
    return top(groups, k, F.desc("alerts"), "cc", "src_asn")


def countries_seen(t, span):
    return distinct_total(_foreign(t, span), F.when(F.col("src_country_code") != "", F.col("src_country_code")), "v")


def attacking_addresses(t, span):
    return distinct_total(_foreign(t, span), "src_ip", "v")


def attack_sessions(t, span):
    return distinct_total(_foreign(t, span), "session", "v")


def attack_programs(t, span):
    return distinct_total(_foreign(t, span), F.when(F.col("hassh") != "", F.col("hassh")), "v")
