"""JA3/JA4 client fingerprints from parsed ClientHello fields, as native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# JA4 two-character codes of protocol versions.
JA4_VERSION_CODES = {
    0x0304: "13", 0x0303: "12", 0x0302: "11", 0x0301: "10", 0x0300: "s3", 0x0002: "s2",
    0xFEFF: "d1", 0xFEFD: "d2", 0xFEFC: "d3",
}
# JA4 leaves SNI and ALPN out of the extension hash and uses this text for an empty list.
SNI_EXTENSION, ALPN_EXTENSION, EMPTY_HASH = 0, 16, "000000000000"


def drop_grease(codes: Column) -> Column:
    """Without RFC 8701 values (two equal bytes whose low nibble is 0xA)."""
    return F.filter(F.coalesce(codes, F.array().cast("array<int>")), lambda c: ~((F.floor(c / 256) == c % 256) & (c % 16 == 10)))


def _decimal(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: c.cast("string")), "-")


def _hex4(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 4, "0"))), ",")


def _short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)


def ja3(version: Column, ciphers: Column, extensions: Column, curves: Column, point_formats: Column) -> Column:
    lists = [_decimal(drop_grease(c)) for c in (ciphers, extensions, curves, point_formats)]
    return F.md5(F.concat_ws(",", version.cast("string"), *lists))


def _version_code(version: Column, supported: Column) -> Column:
    offered = drop_grease(supported)
    best = F.when(F.size(offered) > 0, F.array_max(offered)).otherwise(version)
    code = F.lit("00")
    for number, text in JA4_VERSION_CODES.items():
        code = F.when(best == number, F.lit(text)).otherwise(code)
    return code


def _alpn_code(alpn: Column) -> Column:
    edge = F.concat(F.substring(alpn, 1, 1), F.substring(alpn, -1, 1))
    digits = F.lower(F.hex(F.encode(alpn, "UTF-8")))
    return (
        F.when(F.coalesce(alpn, F.lit("")) == "", F.lit("00"))
        .when(edge.rlike("^[0-9A-Za-z]{2}$"), edge)
        .otherwise(F.concat(F.substring(digits, 1, 1), F.substring(digits, -1, 1)))
    )


def ja4_parts(version: Column, ciphers: Column, extensions: Column, sig_algs: Column, supported: Column, alpn: Column) -> Column:
    """Struct ``ja4, ja4_r``: the hashed and the raw form."""
    lists = F.struct(drop_grease(ciphers).alias("suites"), drop_grease(extensions).alias("exts"), drop_grease(sig_algs).alias("algs"))
    return _let(lists, lambda v: _let(_ja4_texts(v["suites"], v["exts"], v["algs"], _version_code(version, supported), _alpn_code(alpn)), _ja4_forms))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Names an intermediate value, which keeps it from being evaluated wherever it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ja4_texts(suites: Column, exts: Column, algs: Column, version_code: Column, alpn_code: Column) -> Column:
    hashed_exts = F.filter(exts, lambda e: ~e.isin(SNI_EXTENSION, ALPN_EXTENSION))
    head = F.concat(
        F.lit("t"), version_code,
        F.when(F.array_contains(exts, SNI_EXTENSION), "d").otherwise("i"),
        F.lpad(F.least(F.size(suites), F.lit(99)).cast("string"), 2, "0"),
        F.lpad(F.least(F.size(exts), F.lit(99)).cast("string"), 2, "0"),
        alpn_code,
    )
    suite_text = _hex4(F.array_sort(suites))
    ext_text = _hex4(F.array_sort(hashed_exts))
    ext_text = F.when(F.size(algs) > 0, F.concat_ws("_", ext_text, _hex4(algs))).otherwise(ext_text)
    return F.struct(
        head.alias("head"), suite_text.alias("suites"), ext_text.alias("exts"), (F.size(suites) == 0).alias("no_suites"), (F.size(hashed_exts) == 0).alias("no_exts")
    )


def _ja4_forms(v: Column) -> Column:
    suite_hash, ext_hash = [F.when(v[f"no_{c}"], EMPTY_HASH).otherwise(_short_hash(v[c])) for c in ("suites", "exts")]
    return F.struct(F.concat_ws("_", v["head"], suite_hash, ext_hash).alias("ja4"), F.concat_ws("_", v["head"], v["suites"], v["exts"]).alias("ja4_r"))


def tls_fingerprints(hello: DataFrame) -> DataFrame:
    """``uid, ja3, ja4, ja4_r`` from the first ClientHello of each connection (lowest ``seq``)."""
    fields = ("version", "ciphers", "extensions", "curves", "point_formats", "sig_algs", "supported_versions", "alpn")
    first = hello.groupBy("uid").agg(F.min_by(F.struct(*fields), "seq").alias("h"))
    h = {f: F.col(f"h.{f}") for f in fields}
    pair = ja4_parts(h["version"], h["ciphers"], h["extensions"], h["sig_algs"], h["supported_versions"], h["alpn"])
    # A generated row: tests of a fingerprint stay above it, so none is made a second time for them.
    marks = F.struct(ja3(h["version"], h["ciphers"], h["extensions"], h["curves"], h["point_formats"]).alias("ja3"), pair.alias("pair"))
    return first.select("uid", F.inline(F.array(marks))).select("uid", "ja3", "pair.ja4", "pair.ja4_r")
