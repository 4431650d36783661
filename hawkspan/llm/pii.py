"""Personal data in texts, in DataFrame expressions only.

Regular expressions propose spans, checksums (Luhn, mod 97) confirm them, and words near a span adjust its score. Spans count code
points, end exclusive. Spark's expressions give matches without their places, so a text is also split at the same pattern: a match
begins after all gaps and matches before it.

Every repeated group is possessive, which the regex engine runs as a loop instead of by recursion, and a pattern that could rescan a
long run starts only where the run begins or the match before ended; neither changes what matches. So very long texts are safe.

Defined cases: a null text counts as empty and has no spans; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hawkspan.llm.base import register, table

CONTEXT = 40  # code points on either side of a span that can adjust its score
BLOCK = 128  # prefix sums are built in blocks of this many matches


@dataclass(frozen=True)
class Kind:
    """A kind of span. ``base`` kinds are always reported; others from ``threshold`` on."""

    name: str
    pattern: str
    score: float
    context: str
    base: bool = True


# Patterns, words and scores.
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8, "mail|contact|write to|kontakt|correo|courriel"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "address|host|server|login|adresse|client"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.7, "card|visa|mastercard|payment|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|call|mobile|fax|telefon|tel"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.7, "iban|account|bank|konto|cuenta|compte", base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, "ssn|social|security|insurance", base=False),
)
THRESHOLD, NEARBY = 0.5, 0.3


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _mod97(text: Column) -> Column:
    """Whether an account number's check digits hold: first four characters to the end, letters as 10 to 35, remainder one."""
    bare = F.regexp_replace(text, " ", "")
    moved = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    values = F.transform(F.split(moved, "(?<=.)(?=.)"), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda rest, v: (rest * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(match)).between(12, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return _mod97(match)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _ends(lengths: Column) -> Column:
    """Running sums of an array of ints, by blocks: sums inside a block and sums of whole blocks."""

    def running(values: Column) -> Column:
        return F.aggregate(values, F.array().cast("array<int>"), lambda sums, v: F.concat(sums, F.array(v + F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0)))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: running(F.slice(lengths, b * BLOCK + 1, BLOCK)))
    whole = F.aggregate(
        blocks, F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("before")),
        lambda acc, block: F.struct((acc["sum"] + F.element_at(block, -1)).alias("sum"), F.concat(acc["before"], F.array(acc["sum"])).alias("before")),
    )["before"]
    return F.flatten(F.zip_with(blocks, whole, lambda block, before: F.transform(block, lambda v: v + before)))


def _placed(i: int, kind: Kind) -> Column:
    """The valid spans of a kind."""

    def span(hit: Column, end: Column) -> Column:
        start = (end - F.length(hit)).alias("start")
        return F.struct(start, F.lit(i).alias("order"), end.alias("end"), F.lit(kind.name).alias("kind"), _valid(kind.name, hit).alias("valid"))

    return F.filter(F.zip_with(F.col(f"hits{i}"), F.col(f"ends{i}"), span), lambda s: s["valid"])


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``pii``: array of (start, order, end, kind, score), sorted by start, then by kind as listed."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.coalesce(docs[text], F.lit("")).alias("content"))
    for i, kind in enumerate(KINDS):
        rows = rows.withColumn(f"hits{i}", F.regexp_extract_all("content", F.lit(kind.pattern), F.lit(0)))
    for i, kind in enumerate(KINDS):
        gaps = F.transform(F.split("content", kind.pattern), F.length)
        rows = rows.withColumn(f"gaps{i}", F.when(F.size(f"hits{i}") > 0, gaps))
    for i in range(len(KINDS)):
        rows = rows.withColumn(f"ends{i}", F.when(F.size(f"hits{i}") > 0, _ends(F.zip_with(F.col(f"hits{i}"), F.slice(f"gaps{i}", F.lit(1), F.size(f"hits{i}")), lambda hit, gap: F.length(hit) + gap))))
    found = [F.when(F.size(f"hits{i}") > 0, _placed(i, kind)).otherwise(F.array()) for i, kind in enumerate(KINDS)]
    rows = rows.withColumn("spans", F.flatten(F.array(*found)))

    def scored(span: Column) -> Column:
        begin = F.greatest(span["start"] - CONTEXT, F.lit(0))
        around = F.lower(F.substring(F.col("content"), begin + 1, span["end"] + CONTEXT - begin))
        score = F.lit(0.0)
        for kind in KINDS:
            near = F.when(around.rlike(rf"(?<![a-z])(?:{kind.context})"), NEARBY).otherwise(0.0)
            score = F.when(span["kind"] == kind.name, F.least(F.lit(1.0), F.lit(kind.score) + near)).otherwise(score)
        return F.struct(span["start"].alias("start"), span["order"].alias("order"), span["end"].alias("end"), span["kind"].alias("kind"), score.alias("score"))

    rows = rows.withColumn("spans", F.transform("spans", scored))
    n_base = sum(k.base for k in KINDS)
    kept = F.array_sort(F.filter("spans", lambda s: (s["order"] < n_base) | (s["score"] >= THRESHOLD)))
    return rows.select("doc.*", kept.alias("pii"))


def _count(kind: str) -> Column:
    return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("bigint")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@register("op2_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    base = [k.name for k in KINDS if k.base]
    counts = [_count(k).alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(F.filter("pii", lambda s: s["order"] < len(base))), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))
