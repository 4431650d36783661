"""Registered domains by a table of public suffix rules.

A rule is a suffix (``co.uk``), a wildcard (``*.ck``: every label below is a suffix) or an exception (``!www.ck``: not that one). Every
distinct name is cut into its trailing parts once, and these meet the rules in an equi-join; the longest suffix counts, an exception
before all others, and without any rule the last label is the suffix. Rules may be any number; names are judged once however often they
occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAIN, WILDCARD, EXCEPTION = 0, 1, 2


def parsed_rules(rules: DataFrame, rule: str = "rule") -> DataFrame:
    """Rules as ``part`` (what a name's end must be) and ``kind``; blank lines and comments go."""
    text = F.lower(F.trim(F.col(rule)))
    kind = F.when(text.startswith("!"), EXCEPTION).when(text.startswith("*."), WILDCARD).otherwise(PLAIN)
    part = F.regexp_replace(text, r"^(!|\*\.)", "")
    return rules.where((text != "") & ~text.startswith("//")).select(part.alias("part"), kind.alias("kind")).distinct()


def registered_names(names: DataFrame, name: str, rules: DataFrame) -> DataFrame:
    """``name, domain`` for each distinct value of a column; '' where the name is a suffix itself or has one label."""
    labels = F.split("name", "[.]")
    distinct = names.select(F.col(name).alias("name")).where(F.col("name").contains(".")).distinct()
    ends = distinct.withColumn("labels", labels).withColumn("n", F.size("labels"))
    ends = ends.withColumn("taken", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("part", F.lower(_last("labels", F.col("taken"))))
    met = ends.join(parsed_rules(rules), "part", "left")
    length = F.when(F.col("kind") == PLAIN, F.col("taken")).when((F.col("kind") == WILDCARD) & (F.col("taken") < F.col("n")), F.col("taken") + 1)
    longest = met.groupBy("name").agg(F.max(F.when(F.col("kind") == EXCEPTION, F.col("taken") - 1)).alias("spared"), F.max(length).alias("longest"))
    suffix = F.coalesce("spared", "longest", F.lit(1))
    domain = F.when(suffix < F.size(labels), _last(labels, suffix + 1)).otherwise("")
    single = names.select(F.col(name).alias("name")).where(~F.col("name").contains(".")).distinct().withColumn("domain", F.lit(""))
    return longest.select("name", domain.alias("domain")).unionByName(single)


def _last(labels: str | Column, count: Column) -> Column:
    return F.array_join(F.slice(labels, -count, count), ".")


def with_domain(rows: DataFrame, name: str, rules: DataFrame, domain: str) -> DataFrame:
    """The rows with the registered domain of a name column; reads them twice, so give it reduced ones."""
    found = registered_names(rows, name, rules).select(F.col("name").alias(name), F.col("domain").alias(domain))
    return rows.join(found, name)
