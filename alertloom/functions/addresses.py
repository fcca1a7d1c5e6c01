"""IP address rules as native column expressions (no Python per row).

An IPv4 text is judged by one pattern match. An IPv6 text, which is rare, is
first spelled out as 32 hex digits and then matched in the same way. The
patterns are built from the network tables below when the plan is made.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Networks that are not public, and the public parts inside them.
PRIVATE_IPV4 = [
    ("0.0.0.0", 8),
    ("10.0.0.0", 8),
    ("127.0.0.0", 8),
    ("169.254.0.0", 16),
    ("172.16.0.0", 12),
    ("192.0.0.0", 24),
    ("192.0.2.0", 24),
    ("192.168.0.0", 16),
    ("198.18.0.0", 15),
    ("198.51.100.0", 24),
    ("203.0.113.0", 24),
    ("240.0.0.0", 4),
]
PUBLIC_IPV4 = [("192.0.0.9", 32), ("192.0.0.10", 32)]
PRIVATE_IPV6 = [
    ("::", 128),
    ("::1", 128),
    ("64:ff9b:1::", 48),
    ("100::", 64),
    ("2001::", 23),
    ("2001:db8::", 32),
    ("2002::", 16),
    ("fc00::", 7),
    ("fe80::", 10),
]
PUBLIC_IPV6 = [
    ("2001:1::1", 128),
    ("2001:1::2", 128),
    ("2001:3::", 32),
    ("2001:4:112::", 48),
    ("2001:20::", 28),
    ("2001:30::", 28),
]

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4_BODY = f"{_OCTET}(?:[.]{_OCTET}){{3}}"
IPV4_PATTERN = f"^{_IPV4_BODY}$"
_GROUP = "[0-9a-fA-F]{1,4}"
IPV6_PATTERN = f"^(?:{_GROUP}(?::{_GROUP}){{7}}|(?:{_GROUP}(?::{_GROUP}){{0,6}})?::(?:{_GROUP}(?::{_GROUP}){{0,6}})?)$"


def _digit_prefixes(network: str, bits: int) -> list[str]:
    """Hex prefixes of a network; a part of a digit is listed value by value."""
    address = ipaddress.ip_address(network)
    digits = f"{int(address):0{address.max_prefixlen // 4}x}"
    whole, rest = divmod(bits, 4)
    if not rest:
        return [digits[:whole]]
    first = int(digits[whole], 16)
    return [digits[:whole] + f"{value:x}" for value in range(first, first + 2 ** (4 - rest))]


def _octet_prefixes(network: str, bits: int) -> list[str]:
    """Dotted prefixes of an IPv4 network, as pattern text."""
    octets = network.split(".")
    whole, rest = divmod(bits, 8)
    head = "".join(f"{o}[.]" for o in octets[:whole])
    if bits == 32:
        return [f"{head[:-3]}$"]
    if not rest:
        return [head]
    first = int(octets[whole])
    values = "|".join(str(v) for v in range(first, first + 2 ** (8 - rest)))
    return [f"{head}(?:{values})[.]"]


def _any_of(networks: list[tuple[str, int]], prefixes: Callable[[str, int], list[str]]) -> str:
    return "(?:" + "|".join(p for network, bits in networks for p in prefixes(network, bits)) + ")"


_MAPPED = "0" * 20 + "ffff"
PRIVATE_IPV4_PATTERN = (
    f"^(?!{_any_of(PUBLIC_IPV4, _octet_prefixes)})(?={_any_of(PRIVATE_IPV4, _octet_prefixes)}){_IPV4_BODY}$"
)
# A mapped IPv4 address follows the IPv4 rule.
PRIVATE_DIGITS_PATTERN = (
    f"^(?:(?!{_any_of(PUBLIC_IPV6, _digit_prefixes)}){_any_of(PRIVATE_IPV6, _digit_prefixes)}"
    f"|{_MAPPED}(?!{_any_of(PUBLIC_IPV4, _digit_prefixes)}){_any_of(PRIVATE_IPV4, _digit_prefixes)})"
)


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is named."""
    return F.transform(F.array(value), use).getItem(0)


def _pad_groups(groups: Column) -> Column:
    return F.array_join(F.transform(groups, lambda g: F.lpad(F.lower(g), 4, "0")), "")


def _tail_as_groups(text: Column) -> Column:
    """A dotted IPv4 tail rewritten as two hex groups; other text unchanged."""

    def rewrite(tail: Column) -> Column:
        octets = F.transform(F.split(tail, "[.]"), lambda o: F.lpad(F.lower(F.hex(o.cast("int"))), 2, "0"))
        groups = F.concat(octets.getItem(0), octets.getItem(1), F.lit(":"), octets.getItem(2), octets.getItem(3))
        head = F.substr(text, F.lit(1), F.length(text) - F.length(tail))
        return F.when(tail != "", F.concat(head, groups)).otherwise(text)

    return F.when(text.contains("."), _bind(F.regexp_extract(text, f":({_IPV4_BODY})$", 1), rewrite)).otherwise(text)


def ipv6_digits(ip: Column) -> Column:
    """32 hex digits of a valid IPv6 text, else null. Zone names are dropped."""

    def spell(text: Column) -> Column:
        return _bind(F.split(text, "::"), lambda halves: expand(text, halves))

    def expand(text: Column, halves: Column) -> Column:
        left = F.filter(F.split(halves.getItem(0), ":"), lambda g: g != "")
        right = F.filter(F.split(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit("")), ":"), lambda g: g != "")
        return _bind(F.struct(left.alias("l"), right.alias("r")), lambda s: join(text, s.getField("l"), s.getField("r")))

    def join(text: Column, left: Column, right: Column) -> Column:
        gap = F.lit(8) - F.size(left) - F.size(right)
        short = text.contains("::")
        ok = text.rlike(IPV6_PATTERN) & F.when(short, gap >= 1).otherwise(gap == 0)
        return F.when(ok, F.concat(_pad_groups(left), F.repeat(F.lit("0000"), gap), _pad_groups(right)))

    return _bind(_tail_as_groups(F.regexp_replace(ip, "%[^%]+$", "")), spell)


def _ipv6_private(ip: Column) -> Column:
    """True or false for a readable IPv6 text, null for other text."""
    return ipv6_digits(ip).rlike(PRIVATE_DIGITS_PATTERN)


def is_internal(ip: Column) -> Column:
    """1 for private, loopback and link-local addresses; 0 otherwise or unreadable."""
    inside = F.when(ip.contains(":"), F.coalesce(_ipv6_private(ip), F.lit(False))).otherwise(ip.rlike(PRIVATE_IPV4_PATTERN))
    return F.coalesce(inside, F.lit(False)).cast("int")


def segment(ip: Column) -> Column:
    """Network segment of an address.

    Unknown for missing values; two octets for 10.* and public addresses, three
    for other private ones; text without such parts stays as it is.
    """
    two, three = F.substring_index(ip, ".", 2), F.substring_index(ip, ".", 3)
    dotted_v6 = F.when(_ipv6_private(ip), three).otherwise(two)
    return (
        F.when(ip.isNull() | ip.isin("", "None", "nan", "0.0.0.0"), F.lit("unknown"))
        .when(ip.rlike(IPV4_PATTERN), F.when(ip.rlike(PRIVATE_IPV4_PATTERN) & ~ip.startswith("10."), three).otherwise(two))
        .when(ip.contains(":") & ip.contains("."), F.when(_ipv6_private(ip).isNull(), ip).otherwise(dotted_v6))
        .otherwise(ip)
    )


def same_segment(a: Column, b: Column) -> Column:
    return (a == b).cast("int")
