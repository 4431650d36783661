"""Small reference files kept by people: exceptions, target techniques, the detection catalogue, own addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hawkspan.functions.net import cidr_bounds, ip_key
from hawkspan.operators.allowlist import COLUMNS, RejectedRows, check_entries, typed_entries

TECHNIQUE = r"\bT\d{4}(?:\.\d{3})?\b"
CATALOGUE_ROW = r"^\| ((?:DET|RSP)-\d{3}) \| ([^|]+) \| ([^|]+) \| ([^|]+) \| ([^|]+) \|$"
VALIDATED_WORDS = ("Validated", "Enforcing")


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """Text columns of a tab-separated file; refuses a wrong header or a row with another number of columns."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    header = "\t".join(columns)
    parts = F.split("value", "\t", -1)
    faulty = lines.where((F.size(parts) != len(columns))).limit(5).collect()
    if faulty:
        raise RejectedRows(f"expected {len(columns)} columns: {faulty[0]['value']!r}")
    if lines.where(F.col("value") == header).limit(1).count() != 1:
        raise RejectedRows(f"header must be: {' '.join(columns)}")
    return lines.where(F.col("value") != header).select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def load_allowlist(spark: SparkSession, path: str, known_detections: list[str]) -> DataFrame:
    return typed_entries(check_entries(read_tsv(spark, path, COLUMNS), known_detections))


def load_targets(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, ("technique_id", "tactic", "name", "why_in_scope"))


def catalogue_rows(lines: DataFrame, text: str = "value") -> DataFrame:
    """``id, name, techniques, validated, status`` from the rows of a markdown index table."""
    line = F.trim(text)
    cells = [F.trim(F.regexp_extract(line, CATALOGUE_ROW, i)) for i in range(1, 6)]
    rows = lines.where(line.rlike(CATALOGUE_ROW)).select(cells[0].alias("id"), cells[1].alias("name"), cells[3].alias("attack"), cells[4].alias("status"))
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("attack", F.lit(TECHNIQUE), F.lit(0))))
    validated = F.lit(False)
    for word in VALIDATED_WORDS:
        validated = validated | F.col("status").startswith(word)
    return rows.select("id", "name", found.alias("techniques"), validated.alias("validated"), "status")


def load_catalogue(spark: SparkSession, path: str) -> DataFrame:
    rows = catalogue_rows(spark.read.text(path))
    if rows.limit(1).count() == 0:
        raise RejectedRows(f"no detection rows in {path}")
    return rows


def parse_lab_addresses(texts: DataFrame, text: str, added) -> DataFrame:
    """``address=role:note`` lists, comma separated, as rows; the newest entry per address counts on read."""
    rows = texts.select(F.explode(F.split(text, ",")).alias("entry")).select(F.trim("entry").alias("entry")).where(F.col("entry") != "")
    rest = F.when(F.col("entry").contains("="), F.expr("substring(entry, instr(entry, '=') + 1)")).otherwise("")
    rows = rows.select(F.split_part("entry", F.lit("="), F.lit(1)).alias("address"), rest.alias("rest"))
    role = F.split_part("rest", F.lit(":"), F.lit(1))
    note = F.when(F.col("rest").contains(":"), F.expr("substring(rest, instr(rest, ':') + 1)")).otherwise("")
    sound = F.when(F.col("address").rlike("^[0-9a-fA-F.:]+$"), F.col("address")).otherwise(F.raise_error(F.concat(F.lit("not an address: "), "address")))
    return rows.select(sound.alias("address"), F.when(role == "", "other").otherwise(role).alias("role"), note.alias("note"), F.lit(added).cast("timestamp").alias("added"))


def current_lab_addresses(rows: DataFrame) -> DataFrame:
    return rows.groupBy("address").agg(F.max_by(F.struct("role", "note"), F.struct("added", "role", "note")).alias("r"), F.max("added").alias("added")).select("address", "r.role", "r.note", "added")


def load_ranges(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """Address ranges ``start, end, <columns>`` from CSV as sortable keys ``lo, hi``; unusable rows are an error."""
    schema = ", ".join(f"{c} {'bigint' if c == 'asn' else 'string'}" for c in ("start", "end", *columns))
    rows = spark.read.schema(schema).csv(path)
    edge = {n: F.coalesce(ip_key(f"`{n}`"), F.raise_error(F.concat(F.lit("bad range edge "), F.col(n)))) for n in ("start", "end")}
    return rows.select(edge["start"].alias("lo"), edge["end"].alias("hi"), *columns)


def load_never_block(spark: SparkSession, path: str) -> DataFrame:
    """``lo, hi, network, reason, place`` from "<cidr> <reason>" lines; '#' starts a comment, host bits are an error."""
    rows = spark.read.text(path).select(F.trim(F.split_part("value", F.lit("#"), F.lit(1))).alias("entry")).where(F.col("entry") != "")
    rows = rows.select(F.split_part("entry", F.lit(" "), F.lit(1)).alias("network"), F.trim(F.regexp_extract("entry", r"^\S+\s+(.*)$", 1)).alias("reason"))
    bounds = rows.withColumn("b", cidr_bounds("network"))
    sound = F.when(F.col("b").isNotNull() & ~F.col("b.host_bits"), F.col("network")).otherwise(F.raise_error(F.concat(F.lit("not a network: "), "network")))
    # The order decides only which reason is shown where entries overlap.
    return bounds.select("b.lo", "b.hi", sound.alias("network"), F.when(F.col("reason") == "", "listed").otherwise(F.col("reason")).alias("reason"), F.col("network").alias("place"))
