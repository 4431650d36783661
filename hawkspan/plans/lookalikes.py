"""Lookalike domain names: how much was asked, what exists, what to read."""

from __future__ import annotations

from pyspark.sql import functions as F

from hawkspan.plans.common import distinct_total, total


def _asked():
    return F.when(F.col("status") != "error", F.col("domain"))


def names_imagined(t):
    return total(t["candidates"], "v")


def names_asked(t):
    return distinct_total(t["checks"], _asked(), "v")


def coverage_percent(t):
    asked = t["checks"].agg(F.countDistinct(_asked()).alias("asked"))
    size = t["candidates"].agg(F.count("*").alias("n")).scalar()
    return asked.select(F.bround(100 * F.col("asked") / F.greatest(size, F.lit(1)), 1).alias("v"))


def names_that_exist(t):
    return distinct_total(t["checks"], F.when(F.col("status") == "found", F.col("domain")), "v")


def in_tier(t, tier):
    return t["lookalikes"].agg(F.count_if(F.col("tier") == tier).alias("v"))


def ranked_findings(t):
    return t["lookalikes"].select("score", "tier", "domain", "display", "brand", F.col("klass").alias("class"), F.array_join("reasons", " · ").alias("why")).orderBy(F.desc("score"), "domain")


def coverage_by_class(t):
    """``unasked`` is counted in rows of the left join, as in the report it reproduces."""
    checks = t["checks"].groupBy("domain").agg(F.count("*").alias("n"), F.max(F.col("status") != "error").alias("answered"))
    joined = t["candidates"].join(checks, "domain", "left")
    # A candidate listed twice is asked once: distinct domains count.
    groups = joined.groupBy(F.col("klass").alias("class")).agg(
        F.countDistinct(F.when(F.col("answered"), F.col("domain"))).alias("asked"), F.sum(F.greatest(F.coalesce("n", F.lit(1)), F.lit(1))).alias("rows")
    )
    return groups.select("class", "asked", (F.col("rows") - F.col("asked")).alias("unasked"), "rows").orderBy(F.desc("rows"), "class")


def answers_per_day(t):
    status = F.col("status")
    return t["checks"].groupBy(F.to_date("checked_at").cast("string").alias("day")).agg(
        F.count_if(status == "found").alias("found"), F.count_if(status == "absent").alias("absent"), F.count_if(status == "error").alias("errors")
    ).orderBy(F.desc("day"))


def certificates_behind_findings(t):
    names = t["lookalikes"].where(F.col("tier").isin("review", "watch", "weak")).select(F.col("domain").alias("candidate"))
    # Grouped before the join, so a name with many certificates is one row when it meets the findings.
    groups = t["certificates"].groupBy("candidate").agg(
        F.count("*").alias("certificates"), F.min("not_before").alias("first_seen"), F.max("not_before").alias("last_seen"), F.min("issuer_name").alias("issuer")
    )
    listed = names.groupBy("candidate").agg(F.count("*").alias("times"))
    return groups.join(listed, "candidate").select(
        F.col("candidate").alias("name"), (F.col("certificates") * F.col("times")).alias("certificates"), "first_seen", "last_seen", "issuer"
    ).orderBy("certificates", "name")
