"""Addresses against long lists of networks.

A rule tests a few networks one by one. A list of many thousands is joined instead: each distinct address is masked to every
prefix length that occurs in the list, and meets a network of this length by equality. So the work for an address is the number of
different lengths, at most 162, however long the list is, and neither side must fit into one task. Rows get their answer back
by address; an address that very many rows have is looked up once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchspan.functions.network import ipv4_value, ipv6_hex
from watchspan.sources.lines import once

KEY = ["version", "bits", "high", "low"]


def _half(digits: Column) -> Column:
    return F.conv(digits, 16, -10).cast("bigint")


def with_address(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``_address``: (version, high, low), 128 bits of which an IPv4 address has the first 32; NULL if the text is no address."""
    read = once(df, _four=ipv4_value(text), _six=ipv6_hex(text))
    four, six = F.col("_four"), F.col("_six")
    none = F.lit(0).cast("bigint")
    found = (F.when(four.isNotNull(), F.struct(F.lit(4).alias("version"), F.shiftleft(four, 32).alias("high"), none.alias("low")))
             .when(six.isNotNull(), F.struct(F.lit(6).alias("version"), _half(F.substring(six, 1, 16)).alias("high"), _half(F.substring(six, 17, 16)).alias("low"))))
    return once(read, _address=found).drop("_four", "_six")


def _first_bits(half: Column, count: Column) -> Column:
    """The first ``count`` bits of 64, in place; Java shifts by the number modulo 64."""
    none = F.lit(0).cast("bigint")
    shifted = F.call_function("shiftleft", F.call_function("shiftrightunsigned", half, 64 - count), 64 - count)
    return F.when(count <= 0, none).when(count >= 64, half).otherwise(shifted)


def _masked(address: Column, bits: Column) -> list[Column]:
    return [address["version"].alias("version"), bits.alias("bits"), _first_bits(address["high"], bits).alias("high"), _first_bits(address["low"], bits - 64).alias("low")]


def network_keys(networks: DataFrame, column: str = "network") -> DataFrame:
    """Adds the key of each network; host bits are ignored, an address alone is a network of one. Rows that are no network are left out."""
    text = F.col(column)
    length = F.regexp_extract(text, r"/(\d{1,3})\z", 1)
    keyed = with_address(networks, F.regexp_replace(text, r"/\d{1,3}\z", ""))
    widest = F.when(F.col("_address")["version"] == 4, 32).otherwise(128)
    bits = F.when(length == "", widest).otherwise(length.try_cast("int"))
    keyed = keyed.withColumn("_bits", F.when(bits <= widest, bits)).filter(F.col("_bits").isNotNull() & F.col("_address").isNotNull())
    return keyed.select("*", *_masked(F.col("_address"), F.col("_bits"))).drop("_address", "_bits")


def containing_networks(addresses: DataFrame, networks: DataFrame, column: str = "address", network: str = "network") -> DataFrame:
    """(address, network, bits, and the other columns of ``networks``): all networks of the list that each distinct address is in."""
    keyed = network_keys(networks, network)
    lengths: dict[int, list[int]] = {4: [], 6: []}
    for r in keyed.select("version", "bits").distinct().collect():
        lengths[r.version].append(r.bits)
    listed = {version: F.array(*[F.lit(b) for b in sorted(bits)]).cast("array<int>") for version, bits in lengths.items()}
    distinct = addresses.select(F.col(column).alias("address")).filter(F.col(column).isNotNull()).distinct()
    known = with_address(distinct, F.col("address")).filter(F.col("_address").isNotNull())
    tried = known.withColumn("_bits", F.explode(F.when(F.col("_address")["version"] == 4, listed[4]).otherwise(listed[6])))
    return tried.select("address", *_masked(F.col("_address"), F.col("_bits"))).join(keyed, KEY).drop("version", "high", "low")


def with_network(rows: DataFrame, networks: DataFrame, column: str = "address", network: str = "network") -> DataFrame:
    """``rows`` with the longest network of the list that holds their address, as ``network``; NULL if there is none.

    Of networks that are equal but for their text or host bits, the first text counts.
    """
    found = containing_networks(rows, networks.select(F.col(network).alias("network")), column)
    longest = found.groupBy("address").agg(F.min_by("network", F.struct(-F.col("bits"), "network")).alias("network"))
    return rows.join(longest.withColumnRenamed("address", column), column, "left")
