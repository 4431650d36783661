"""Column helpers for names, sizes, numbers in text and string entropy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels that, before a two-letter country code, form a suffix under which names are registered.
SUFFIX_LABELS = ("ac", "co", "com", "edu", "gen", "go", "gob", "gouv", "gov", "govt", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
# Other two-label suffixes under which names are registered.
TWO_LABEL_SUFFIXES = ("github.io", "ngrok.io")


def registered_domain(name: str, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES, labels: Sequence[str] = SUFFIX_LABELS) -> Column:
    """The registered part of a host name column; '' for a single label. ``suffixes`` adds to the rule of labels under
    country codes; give the rows of a public suffix table where it is at hand."""
    listed = ", ".join(f"'{s}'" for s in suffixes) or "NULL"
    last = f"substring_index({name}, '.', -2)"
    by_rule = f"(length(substring_index({name}, '.', -1)) = 2 AND substring_index({last}, '.', 1) IN ({', '.join(f"'{x}'" for x in labels)}))"
    return F.expr(f"CASE WHEN NOT contains({name}, '.') THEN '' WHEN {by_rule} OR coalesce({last} IN ({listed}), false) THEN substring_index({name}, '.', -3) ELSE {last} END")


def subdomain_text(name: str, base: str) -> Column:
    """What precedes the registered domain, without dots."""
    return F.expr(f"replace(substring({name}, 1, greatest(length({name}) - length({base}) - 1, 0)), '.', '')")


def char_entropy(text: str) -> Column:
    """Shannon entropy in bits per character; 0 for the empty string."""
    share = f"((length({text}) - length(replace({text}, c, ''))) / length({text}))"
    letters = f"array_distinct(filter(split({text}, ''), c -> c <> ''))"
    return F.expr(f"aggregate({letters}, 0D, (total, c) -> total - {share} * log2({share}))")


def readable_size(size: str) -> Column:
    """Bytes with a binary unit and two decimals, e.g. ``1.50 MiB``."""
    value = f"CAST({size} AS DOUBLE)"
    units = ("B", "KiB", "MiB", "GiB", "TiB", "PiB")
    cases = " ".join(f"WHEN {value} < {1024 ** (i + 1)}D THEN format_string('%.2f {u}', {value} / {1024 ** i}D)" for i, u in enumerate(units))
    return F.expr(f"CASE {cases} ELSE format_string('%.2f EiB', {value} / {1024 ** len(units)}D) END")


def number_text(value: Column, decimals: int = 0) -> Column:
    """A rounded number (half to even) the short way: no trailing zeros, no exponent."""
    if decimals == 0:
        return F.bround(value).cast("decimal(38,0)").cast("string")
    return F.regexp_replace(F.bround(value, decimals).cast(f"decimal(38,{decimals})").cast("string"), r"\.?0+$", "")


def power_text(base: int, exponent: Column) -> Column:
    """The digits of ``base`` to a whole power of any size, multiplied out in limbs of nine digits, lowest first."""
    limb = 10**9
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def times_base(limbs: Column, _step: Column) -> Column:
        def add(done: Column, value: Column) -> Column:
            product = value * base + done["carry"]
            return F.struct(F.floor(product / limb).cast("long").alias("carry"), F.concat(done["limbs"], F.array(product % limb)).alias("limbs"))

        def close(done: Column) -> Column:
            return F.when(done["carry"] > 0, F.concat(done["limbs"], F.array(done["carry"]))).otherwise(done["limbs"])

        return F.aggregate(limbs, F.struct(zero.alias("carry"), none.alias("limbs")), add, close)

    steps = F.when(exponent > 0, F.sequence(F.lit(1), exponent.cast("int"))).otherwise(F.array().cast("array<int>"))
    limbs = F.aggregate(steps, F.array(F.lit(1).cast("long")), times_base)
    text = F.array_join(F.transform(F.reverse(limbs), lambda v: F.lpad(v.cast("string"), 9, "0")), "")
    return F.regexp_replace(text, "^0+(?=.)", "")


def dot_suffixes(name: str) -> Column:
    """Every part of a name that starts at a dot: ``a.b.c`` gives ``.b.c`` and ``.c``."""
    labels = f"split({name}, '[.]')"
    return F.expr(f"transform(slice({labels}, 2, size({labels})), (x, i) -> concat('.', array_join(slice({labels}, i + 2, size({labels})), '.')))")


def present(*parts: Column) -> Column:
    """Array of the parts that are not NULL, in the given order."""
    return F.array_compact(F.array(*parts))
