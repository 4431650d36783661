"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate, target share times total size over own size. A document's number of copies is the inverse
of the Poisson distribution with that mean at a uniform number that a hash of seed and identifier gives, so it is the same on any
cluster and in any retry. Copies are exploded and shuffled globally by another hash: it deals them to tasks, which sort by it.

A rate above ``STEP`` is split into equal parts, each inverted at a uniform number of its own: their sum has the same distribution and
exp(-rate) never underflows. A source of a few characters beside gigabytes has millions of parts: beyond ``RUN`` of them a document's
parts are dealt to tasks in runs, each drawn and exploded by itself, and running sums number the copies.

Defined cases: a null source is a source of its own (''); sources without a weight, or with weight zero, get no copies; a null or
empty text has size zero and still is drawn at its source's rate; a source whose size is zero has rate zero; rows that repeat
with the same identifier are drawn alike; an empty table gives an empty result; extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hawkspan.llm.base import register, table
from hawkspan.session import stored

MAX_SOURCES = 10_000  # sources whose rates are broadcast; more are joined by a shuffle
STEP = 8
RUN = 64  # parts of a rate that are drawn in one row
TERMS = 64  # beyond this many terms the rest of a Poisson distribution with mean STEP is below 1e-38, less than any uniform number resolves


def _uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 bits out of a hash of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, source: str = "source", text: str = "text", total: int | None = None) -> DataFrame:
    """(source, rate) of every source in ``docs``. Sizes are code points of text; ``weights`` None: the same share for every source."""
    sizes = docs.groupBy(F.coalesce(docs[source].cast("string"), F.lit("")).alias("mix_source")).agg(F.sum(F.coalesce(F.length(docs[text]), F.lit(0)).cast("bigint")).alias("size"))
    if weights is None:
        shares = sizes.withColumn("weight", F.lit(1.0))
    else:
        listed = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "mix_source string, weight double")
        shares = sizes.join(listed, "mix_source", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    whole = shares.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rate = F.col("weight") / F.col("all_weight") * (F.lit(total) if total is not None else F.col("all_size")) / F.col("size")
    return shares.crossJoin(F.broadcast(whole)).select("mix_source", F.when((F.col("size") > 0) & (F.col("all_weight") > 0), rate).otherwise(0.0).alias("rate"))  # one row of totals


def _draw(rate: Column, seed: int, identifier: Column, first: Column | None = None, last: Column | None = None) -> Column:
    """Copies of a document: over equal parts of the rate, how many values of the distribution function are not above the uniform number.

    ``first`` and ``last`` choose some of the parts."""
    parts = F.ceil(rate / STEP).cast("int")
    mean = rate / parts

    def inverse(part: Column) -> Column:
        u = _uniform(F.lit(str(seed)), identifier, part.cast("string"))
        start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("below"), F.lit(0).alias("n"))
        end = F.aggregate(
            F.sequence(F.lit(1), F.lit(TERMS)), start,
            lambda a, k: F.struct((a["p"] * mean / k).alias("p"), (a["below"] + a["p"] * mean / k).alias("below"), (a["n"] + F.when(a["below"] <= u, 1).otherwise(0)).alias("n")),
        )
        return end["n"]

    chosen = F.sequence(F.lit(1) if first is None else first, parts if last is None else F.least(last, parts))
    return F.when(rate > 0, F.aggregate(chosen, F.lit(0), lambda sum_, part: sum_ + inverse(part))).otherwise(0)


def _in_runs(rows: DataFrame, seed: int) -> DataFrame:
    """The copies of documents with many parts. Equal identifiers of a source are drawn alike, so each is drawn once."""
    keys = ["mix_source", "mix_id"]
    runs = rows.select(*keys, "rate").distinct().withColumn("run", F.explode(F.sequence(F.lit(0), F.ceil(F.col("rate") / (STEP * RUN)).cast("int") - 1)))
    spread = runs.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "run")
    drawn = spread.withColumn("n", _draw(F.col("rate"), seed, F.col("mix_id"), F.col("run") * RUN + 1, F.col("run") * RUN + RUN))
    line = Window.partitionBy(*keys)
    upto = F.sum("n").over(line.orderBy("run").rowsBetween(Window.unboundedPreceding, 0))
    numbered = drawn.select(*keys, "n", upto.alias("upto"), F.sum("n").over(line).alias("copies")).where("n > 0")
    return rows.join(numbered, keys).withColumn("copy", F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.col("upto")))).drop("n", "upto")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = 17, identifier: str = "doc_id", source: str = "source", text: str = "text", total: int | None = None) -> DataFrame:
    """``docs`` replicated towards the target weights and globally shuffled: columns ``doc`` (all of the row's), copy (from 1), copies, rate, shuffle_key."""
    rates = stored(source_rates(docs, weights, source, text, total), "mix-rates")
    small = rates.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.coalesce(docs[source].cast("string"), F.lit("")).alias("mix_source"), F.coalesce(docs[identifier].cast("string"), F.lit("")).alias("mix_id"))
    rated = rows.join(F.broadcast(rates) if small else rates, "mix_source")
    many = F.col("rate") > STEP * RUN
    columns = ["doc", "mix_id", "rate", "copies", "copy"]
    drawn = rated.where(~many).withColumn("copies", _draw(F.col("rate"), seed, F.col("mix_id")).cast("bigint")).where("copies > 0")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(*columns)
    if not rates.where(many).isEmpty():
        copies = copies.unionByName(_in_runs(rated.where(many), seed).select(*columns))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"order-{seed}"), "mix_id", "copy").cast("binary")))
    dealt = keyed.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shuffle_key").sortWithinPartitions("shuffle_key")
    return dealt.select("doc", "copy", "copies", "rate", "shuffle_key")


@register(
    "op7_mix_sources",
    f"""WITH size AS (SELECT coalesce(source, '') AS source, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS size FROM documents GROUP BY 1),
    rate AS (SELECT source, CASE WHEN size > 0 THEN CAST(1 AS DOUBLE) / (SELECT CAST(count(*) AS DOUBLE) FROM size) * (SELECT CAST(sum(size) AS DOUBLE) FROM size) / size ELSE 0 END AS rate FROM size),
    part AS (SELECT doc_id, d.source, rate, unnest(range(1, CAST(ceil(rate / {STEP}) AS INT) + 1)) AS part, rate / ceil(rate / {STEP}) AS mean FROM documents d JOIN rate ON coalesce(d.source, '') = rate.source),
    uniform AS (SELECT *, CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || part), 1, 13)) AS BIGINT) / {float(2**52)} AS u FROM part),
    drawn AS (SELECT doc_id, source, rate, CAST(sum(len(list_filter(list_transform(range(0, {TERMS}), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(-mean + j * ln(mean) - lgamma(j + 1))))), lambda c: c <= u))) AS BIGINT) AS copies
      FROM uniform GROUP BY doc_id, source, rate)
    SELECT doc_id, source, unnest(range(1, copies + 1)) AS copy, copies, md5('order-17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy) AS shuffle_key FROM drawn WHERE copies > 0""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source brought to the same share of code points; total size stays."""
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc.doc_id", "doc.source", "copy", "copies", "shuffle_key")
