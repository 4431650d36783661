"""Matching addresses to address ranges by an equi-join, whatever the ranges' sizes.

A range of keys falls apart into aligned blocks: every key that begins with a certain run of hex digits, as a segment tree files an
interval. An address meets a block if one of its own beginnings is that run, so both sides join on the run itself and an address meets
the ranges that hold it and no others, be there one range in a network or a hundred thousand. Addresses are cut only to the lengths
that occur among the blocks, and the event side is reduced to its distinct addresses first, so a busy address costs one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hawkspan.functions.net import cidr_bounds, ip_key


def _digit(key: str, place: str) -> str:
    return f"CAST(conv(substring({key}, {place}, 1), 16, 10) AS INT)"


def _runs(key: str, place: str, low: str, high: str) -> str:
    """Beginnings of ``key`` before ``place``, each continued by one digit from ``low`` to ``high``."""
    return f"IF({low} <= {high}, transform(sequence({low}, {high}), d -> concat(substring({key}, 1, {place} - 1), lower(hex(d)))), array())"


def aligned_blocks(lo: str = "lo", hi: str = "hi") -> Column:
    """Array of the runs of digits that together stand for the keys from ``lo`` to ``hi`` (both included, of one family); NULL for an empty range."""
    same = f"coalesce(nullif(array_position(transform(sequence(1, length({lo})), i -> substring({lo}, i, 1) = substring({hi}, i, 1)), false), 0) - 1, length({lo}))"
    # Beyond these places the lower key has zeros only and the upper one f's only.
    low_end, high_end = f"length(trim(TRAILING '0' FROM {lo}))", f"length(trim(TRAILING 'f' FROM {hi}))"
    first = "(e.same + 1)"
    middle = _runs(lo, first, f"{_digit(lo, first)} + CAST(e.low > {first} AS INT)", f"{_digit(hi, first)} - CAST(e.high > {first} AS INT)")
    left = f"IF(e.low > {first}, concat(flatten(transform(sequence(e.same + 2, e.low), i -> {_runs(lo, 'i', _digit(lo, 'i') + ' + 1', '15')})), array(substring({lo}, 1, e.low))), array())"
    right = f"IF(e.high > {first}, concat(flatten(transform(sequence(e.same + 2, e.high), i -> {_runs(hi, 'i', '0', _digit(hi, 'i') + ' - 1')})), array(substring({hi}, 1, e.high))), array())"
    whole = f"IF(e.low <= e.same AND e.high <= e.same, array(substring({lo}, 1, e.same)), concat({middle}, {left}, {right}))"
    found = f"get(transform(array(named_struct('same', {same}, 'low', {low_end}, 'high', {high_end})), e -> {whole}), 0)"
    return F.expr(f"IF({lo} <= {hi} AND length({lo}) = length({hi}) AND substring({lo}, 1, 1) = substring({hi}, 1, 1), {found}, NULL)")


def explode_blocks(ranges: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """One row per aligned block of a range, as ``block``: at most 30 for each digit of a key, one for a network on a digit's border."""
    return ranges.withColumn("block", F.explode(aligned_blocks(lo, hi)))


def network_blocks(networks: DataFrame, cidr: str) -> DataFrame:
    """The rows with a valid address or network, once per block of it."""
    bounded = networks.withColumn("bounds", cidr_bounds(cidr)).where(F.col("bounds").isNotNull())
    return explode_blocks(bounded.withColumn("lo", F.col("bounds.lo")).withColumn("hi", F.col("bounds.hi"))).drop("bounds")


def distinct_network_blocks(networks: DataFrame, cidr: str) -> DataFrame:
    """The distinct valid networks of a column, once per block, as ``cidr`` names it and ``block``; a network is parsed once, however often it is listed."""
    counted = networks.groupBy(cidr).agg(F.count(F.lit(1)).alias("n"))
    return network_blocks(counted.select(F.when(F.col("n") > 0, F.col(cidr)).alias(cidr)), cidr).select(cidr, "block")


def distinct_addresses(df: DataFrame, ip: str) -> DataFrame:
    """Distinct valid addresses of a column as ``addr, addr_key``. The key hangs on the count, so no test of it moves below the grouping: each address is parsed once."""
    counted = df.groupBy(F.col(ip).alias("addr")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("addr", F.when(F.col("n") > 0, ip_key("addr")).alias("addr_key")).where(F.col("addr_key").isNotNull())


def cut_addresses(addresses: DataFrame, blocks: DataFrame) -> DataFrame:
    """``addresses`` once for each length that a block has (33 at most), with the beginning of that length as ``block``."""
    lengths = blocks.agg(F.collect_set(F.length("block")).alias("n")).scalar()
    usable = F.array_intersect(lengths, F.sequence(F.lit(1), F.length("addr_key")))
    return addresses.withColumn("cut", F.explode(usable)).withColumn("block", F.substring("addr_key", F.lit(1), F.col("cut"))).drop("cut")


def lookup_ranges(df: DataFrame, ip: str, ranges: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``addr`` plus the columns of the range that holds it, for every distinct address with a match; of several the one that begins last.

    Of the ranges that share a block only that one can win, so an address meets one row per length, however often a range is listed.
    """
    blocks = explode_blocks(ranges.select("lo", "hi", *columns).distinct()).groupBy("block").agg(F.max(F.struct("lo", *columns)).alias("best")).select("block", "best.*")
    found = cut_addresses(distinct_addresses(df, ip), blocks).join(blocks, "block")
    return found.groupBy("addr").agg(F.max_by(F.struct(*columns), F.struct("lo", *columns)).alias("found")).select("addr", "found.*")


def covered_addresses(df: DataFrame, ip: str, blocks: DataFrame) -> DataFrame:
    """Distinct addresses of a column that lie in a block, as ``addr``."""
    return cut_addresses(distinct_addresses(df, ip), blocks).join(blocks.select("block"), "block", "left_semi").select("addr").distinct()


def geo_enrich(df: DataFrame, ip: str, countries: DataFrame, networks: DataFrame, prefix: str) -> DataFrame:
    """Adds ``<prefix>country_code, country, asn, as_org``; '' or 0 where nothing is known.

    ``countries``: lo, hi, country_code, country. ``networks``: lo, hi, asn, as_org. Rows without an address, often the most
    frequent value of all, match nothing; they are spread over all tasks.
    """
    country = lookup_ranges(df, ip, countries, ["country_code", "country"])
    network = lookup_ranges(df, ip, networks, ["asn", "as_org"])
    known = country.join(network, "addr", "full_outer")
    spread = F.concat(F.lit("#"), F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind]).cast("string"))
    placed = df.withColumn("addr", F.when(F.coalesce(F.col(ip), F.lit("")) != "", F.col(ip)).otherwise(spread))
    out = placed.join(known, "addr", "left").drop("addr")
    filled = {f"{prefix}{c}": F.coalesce(F.col(c), F.lit("")) for c in ("country_code", "country", "as_org")}
    filled[f"{prefix}asn"] = F.coalesce(F.col("asn").cast("long"), F.lit(0).cast("long"))
    added = [e.alias(n) for n, e in filled.items()]
    return out.select(*[c for c in df.columns if c not in filled], *added)
