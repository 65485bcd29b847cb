import ipaddress
import random

from pyspark.sql import functions as F

from watchspan.operators.networks import containing_networks, with_network


def random_network(rng):
    if rng.random() < 0.6:
        return f"{ipaddress.IPv4Address(rng.getrandbits(32) & rng.getrandbits(32))}/{rng.randrange(33)}"
    return f"{ipaddress.IPv6Address((rng.getrandbits(128) & rng.getrandbits(128)) | (1 << 127))}/{rng.randrange(129)}"


def test_long_lists_against_the_standard_library(spark):
    rng = random.Random(8)
    nets = sorted({random_network(rng) for _ in range(1500)} | {"10.0.0.0/8", "10.1.2.3/8", "203.0.113.9", "2001:db8::1", "::/0", "0.0.0.0/1"})
    bad = ["x/8", "1.2.3.4/33", "::1/129", "", None, "1.2.3/8", "/8"]
    addresses = []
    for net in map(ipaddress.ip_interface, nets):
        host = rng.getrandbits(net.max_prefixlen) & int(net.network.hostmask)
        addresses.append(str(net.ip.__class__(int(net.network.network_address) | host)))
    addresses += [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(300)] + ["nonsense", "", None, "1.2.3", "::", "255.255.255.255", "2001:DB8::1"]
    rows = spark.createDataFrame([(a, k, "clash") for k, a in enumerate([*addresses, *addresses[:50]])], "address string, k int, bits string")
    listed = spark.createDataFrame([(n, 7) for n in [*nets, *bad]], "network string, high int")
    found = {}
    for r in containing_networks(rows, listed.drop("high")).collect():
        found.setdefault(r.address, set()).add(r.network)
    parsed = [(n, ipaddress.ip_interface(n).network) for n in nets]

    def expected(text):
        try:
            address = ipaddress.ip_address(text)
        except ValueError:
            return set()
        return {n for n, net in parsed if net.version == address.version and address in net}

    for a in set(addresses):
        assert found.get(a, set()) == expected(a), a
    best = {(r.k, r.address): r.network for r in with_network(rows, listed).collect()}
    assert len(best) == rows.count()
    length = lambda n: ipaddress.ip_interface(n).network.prefixlen
    for (_, a), network in best.items():
        assert network == min(expected(a), key=lambda n: (-length(n), n), default=None), a


def test_a_hundred_thousand_networks(spark):
    """Joined by equality: neither a nested loop nor an expression per network."""
    listed = spark.range(100_000).select(F.concat_ws(".", F.lit("10"), (F.col("id") / 512).cast("int"), (F.col("id") / 2 % 256).cast("int"), F.col("id") % 2 * 128).alias("net"))
    listed = listed.select(F.concat("net", F.lit("/25")).alias("network"))
    rows = spark.range(200_000).select(F.concat_ws(".", F.lit("10"), F.col("id") % 256, F.col("id") * 7 % 256, F.col("id") * 13 % 256).alias("address"))
    done = with_network(rows, listed)
    assert "NestedLoop" not in done._jdf.queryExecution().executedPlan().toString()
    got = done.agg(F.count("network").alias("n"), F.count_if(F.substring_index("network", ".", 3) != F.substring_index("address", ".", 3)).alias("wrong")).first()
    assert got.wrong == 0 and got.n == rows.filter(F.split("address", r"\.")[1].cast("int") * 512 + F.split("address", r"\.")[2].cast("int") * 2
                                                  + (F.split("address", r"\.")[3].cast("int") >= 128).cast("int") < 100_000).count()
