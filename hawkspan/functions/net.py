"""Addresses as sortable text keys, so range tests are plain string comparisons.

A key is the family digit followed by fixed-width lower-case hex: ``4c0a80001`` or ``6`` plus 32 hex digits.
Keys of one family sort like the addresses and never compare equal across families.

The helpers take the name of a column (or any SQL text) and build one SQL expression. ``get(transform(array(x), v -> ...), 0)``
names an intermediate value, which keeps it from being repeated all over the plan.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = f"'^{_OCTET}([.]{_OCTET}){{3}}$'"
_V4_TAIL = "'([0-9]+([.][0-9]+){3})$'"
_V6_SIDE = "'^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?$'"

# The address blocks Python's ipaddress module (3.13) counts as not globally reachable, and the exceptions.
NOT_GLOBAL_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
)
GLOBAL_EXCEPTIONS_V4 = ("192.0.0.9/32", "192.0.0.10/32")

# Default networks regarded as local by the TLS detections.
LOCAL_NETWORKS = (
    "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "127.0.0.0/8", "fc00::/7", "fe80::/10",
)


def _let(value: str, name: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _v4_hex(ip: str) -> str:
    octets = ", ".join(f"try_cast(split_part({ip}, '.', {i}) AS INT)" for i in range(1, 5))
    return f"format_string('%02x%02x%02x%02x', {octets})"


def _v6_hex(text: str) -> str:
    """32 hex digits of a lower-case IPv6 text (``::`` and a dotted tail allowed); NULL when malformed."""
    dotted = f"concat(regexp_replace({text}, {_V4_TAIL}, ''), substring({_v4_hex('tail')}, 1, 4), ':', substring({_v4_hex('tail')}, 5, 4))"
    flat = _let(f"regexp_extract({text}, {_V4_TAIL}, 1)", "tail", f"IF(tail RLIKE {_V4}, {dotted}, {text})")
    halves = [f"split_part(flat, '::', {i})" for i in (1, 2)]
    groups = ", ".join(f"transform(filter(split({h}, ':'), g -> g <> ''), g -> lpad(g, 4, '0'))" for h in halves)
    given = "(size(halves[0]) + size(halves[1]))"
    joined = f"array_join(concat(halves[0], array_repeat('0000', greatest(8 - {given}, 0)), halves[1]), '')"
    filled = _let(f"array({groups})", "halves", f"IF(IF(contains(flat, '::'), {given} <= 7, {given} = 8), {joined}, NULL)")
    sound = " AND ".join(f"{h} RLIKE {_V6_SIDE}" for h in halves) + " AND size(split(flat, '::')) <= 2"
    return _let(flat, "flat", f"IF({sound}, {filled}, NULL)")


def ip_key_sql(ip: str) -> str:
    return f"CASE WHEN {ip} RLIKE {_V4} THEN concat('4', {_v4_hex(ip)}) WHEN contains({ip}, ':') THEN concat('6', {_v6_hex(f'lower({ip})')}) END"


def ip_key(ip: str) -> Column:
    """Sortable key of an IPv4/IPv6 text address; NULL when the text is not an address."""
    return F.expr(ip_key_sql(ip))


def cidr_bounds(cidr: str) -> Column:
    """Struct ``lo, hi, host_bits`` for a CIDR column; a bare address counts as a single-address block; NULL when malformed."""
    asked = f"split_part({cidr}, '/', 2)"
    width = "IF(startswith(base, '4'), 32, 128)"
    length = f"CASE WHEN NOT contains({cidr}, '/') THEN {width} WHEN {asked} RLIKE '^[0-9]{{1,3}}$' THEN CAST({asked} AS INT) END"
    step = "CAST(pow(2, 4 - n % 4) AS INT)"
    nibble = "coalesce(CAST(conv(substring(base, n div 4 + 2, 1), 16, 10) AS INT), 0)"

    def edge(value: str, filler: str) -> str:
        kept = "substring(base, 1, CAST(n div 4 AS INT) + 1)"
        return f"rpad(IF(n % 4 > 0, concat({kept}, lower(hex({value}))), {kept}), {width} div 4 + 1, '{filler}')"

    low = edge(f"({nibble} - {nibble} % {step})", "0")
    high = edge(f"({nibble} - {nibble} % {step} + {step} - 1)", "f")
    found = f"IF(base IS NOT NULL AND n <= {width}, named_struct('lo', {low}, 'hi', {high}, 'host_bits', {low} <> base), NULL)"
    return F.expr(_let(ip_key_sql(f"split_part({cidr}, '/', 1)"), "base", _let(length, "n", found)))


def network_bounds(cidr: str) -> tuple[str, str]:
    """The same bounds for a parameter value known before the job starts."""
    net = ipaddress.ip_network(cidr)
    digits = 8 if net.version == 4 else 32
    return tuple(f"{net.version}{int(edge):0{digits}x}" for edge in (net.network_address, net.broadcast_address))


def _v4_in(ip: str, network: ipaddress.IPv4Network) -> str:
    """Membership of a valid IPv4 text in a fixed block: a text prefix plus at most one numeric octet test."""
    whole, rest = divmod(network.prefixlen, 8)
    octets = str(network.network_address).split(".")
    if whole == 4:
        return f"{ip} = '{network.network_address}'"
    tests = [f"startswith({ip}, '{'.'.join(octets[:whole])}.')"] if whole else ["true"]
    if rest:
        low = int(octets[whole])
        tests.append(f"try_cast(split_part({ip}, '.', {whole + 1}) AS INT) BETWEEN {low} AND {low + 2 ** (8 - rest) - 1}")
    return f"({' AND '.join(tests)})"


def in_networks_sql(ip: str, networks: Iterable[str]) -> str:
    nets = [ipaddress.ip_network(n) for n in networks]
    old = " OR ".join(_v4_in(ip, n) for n in nets if n.version == 4)
    new = " OR ".join(f"k BETWEEN '{lo}' AND '{hi}'" for lo, hi in (network_bounds(str(n)) for n in nets if n.version == 6))
    tests = []
    if old:
        tests.append(f"({ip} RLIKE {_V4} AND ({old}))")
    if new:
        tests.append(f"(contains({ip}, ':') AND exists(array({ip_key_sql(ip)}), k -> {new}))")
    return f"coalesce({' OR '.join(tests) or 'false'}, false)"


def in_networks(ip: str, networks: Iterable[str]) -> Column:
    """Whether an address lies in any of the given blocks (a parameter list, so literal tests); never NULL."""
    return F.expr(in_networks_sql(ip, networks))


def is_v4(ip: str) -> Column:
    return F.expr(f"coalesce({ip} RLIKE {_V4}, false)")


def is_global_v4(ip: str) -> Column:
    """Publicly reachable IPv4 address."""
    return F.expr(
        f"coalesce({ip} RLIKE {_V4}, false) AND (NOT {in_networks_sql(ip, NOT_GLOBAL_V4)} OR {in_networks_sql(ip, GLOBAL_EXCEPTIONS_V4)})"
    )
