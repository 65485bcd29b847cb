"""Addresses as comparable values, and membership in a network."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
DOTTED_QUAD = rf"{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}"


def _quad_value(quad: Column) -> Column:
    """A dotted quad known to be well formed, as a number."""
    parts = F.split(quad, r"\.")
    return sum((F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint") * 256 ** (3 - i)
                for i in range(4)), F.lit(0))


def ipv4_value(text: Column) -> Column:
    """The address as a number; NULL when the text is not a dotted quad without leading zeros."""
    return F.when(text.rlike(rf"\A{DOTTED_QUAD}\z"), _quad_value(text))


def ipv6_hex(text: Column) -> Column:
    """The address as 32 hex digits; NULL when the text is not an IPv6 address."""
    plain = F.lower(F.regexp_replace(text, r"%[^%]+\z", ""))
    quad = F.regexp_extract(plain, rf":({DOTTED_QUAD})\z", 1)
    tail = F.lpad(F.lower(F.hex(_quad_value(quad))), 8, "0")
    grouped = F.when(quad != "", F.concat(
        F.regexp_replace(plain, r"[0-9.]+\z", ""), F.substring(tail, 1, 4), F.lit(":"),
        F.substring(tail, 5, 4))).otherwise(plain)
    halves = F.split(grouped, "::", -1)

    def groups(half: Column) -> Column:
        return F.when(F.coalesce(half, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
            F.split(half, ":", -1))

    left = groups(F.try_element_at(halves, F.lit(1)))
    right = groups(F.try_element_at(halves, F.lit(2)))
    given = F.size(left) + F.size(right)
    shortened = F.size(halves) == 2
    sound = (F.forall(F.concat(left, right), lambda g: g.rlike(r"\A[0-9a-f]{1,4}\z"))
             & F.when(shortened, given <= 7).otherwise((F.size(halves) == 1) & (given == 8)))
    filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - given, F.lit(0))), right)
    digits = F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), "")
    return F.when(text.contains(":") & sound, digits)


def in_network(text: Column, network: str) -> Column:
    """Whether the text is an address in the network; host bits of the network are ignored."""
    net = ipaddress.ip_network(network, strict=False)
    low, high = int(net.network_address), int(net.broadcast_address)
    if net.version == 4:
        return F.coalesce(ipv4_value(text).between(low, high), F.lit(False))
    return F.coalesce(ipv6_hex(text).between(f"{low:032x}", f"{high:032x}"), F.lit(False))
