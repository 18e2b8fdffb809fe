"""IP addresses and prefixes as strings of bits, so that a prefix contains an address if it is a prefix of it.

IPv4 has 32 characters 0 or 1, IPv6 128. IPv4 is parsed by Spark's own functions; the rest by Python's ipaddress in Arrow
batches, over distinct addresses only. IPv4-mapped IPv6 addresses count as IPv4.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\z"

#: Ranges that threat feeds say nothing about: private, loopback, link-local, multicast, unspecified (fixed values of the standards).
UNROUTABLE = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "224.0.0.0/4", "0.0.0.0/32", "fc00::/7", "::1/128", "fe80::/10", "ff00::/8", "::/128")


def bits_of(address: ipaddress.IPv4Address | ipaddress.IPv6Address) -> str:
    return f"{int(address):0{address.max_prefixlen}b}"


def parse_address(text: str) -> str | None:
    """Bits of an address, IPv4-mapped ones as IPv4; None if it is none."""
    try:
        address = ipaddress.ip_address(text.split("%")[0] if ":" in text else text)
    except ValueError:
        return None
    mapped = getattr(address, "ipv4_mapped", None)
    return bits_of(mapped or address)


def parse_prefix(text: str) -> tuple[int, str] | None:
    """Family (4 or 6) and bits of the network part of a CIDR; a mapped CIDR stays IPv6. None if it is none."""
    if "/" not in text or "%" in text or not text.split("/")[1].isdigit():
        return None
    try:
        network = ipaddress.ip_network(text, strict=False)
    except ValueError:
        return None
    return network.version, bits_of(network.network_address)[: network.prefixlen]


def bits_v4(ip: Column) -> Column:
    """Bits of a dotted IPv4 address; null if it is none."""
    parts = F.split(ip, r"\.")
    return F.when(ip.rlike(_V4), F.concat(*[F.lpad(F.bin(parts[i].cast("bigint")), 8, "0") for i in range(4)]))


def in_prefix(ip: Column, cidr: str) -> Column:
    """Whether the IPv4 address of a column lies in a prefix given as text; other addresses go through an Arrow function."""
    family, network = parse_prefix(cidr) or (None, None)
    if family is None:
        raise ValueError(f"bad cidr {cidr!r}")
    v4 = F.coalesce(F.startswith(bits_v4(ip), F.lit(network)), F.lit(False)) if family == 4 else F.lit(False)

    @F.pandas_udf("boolean")
    def other(text: pd.Series) -> pd.Series:
        def test(x: str | None) -> bool:
            bits = parse_address(x) if x else None
            return bits is not None and len(bits) == (32 if family == 4 else 128) and bits.startswith(network)

        return text.map(test).astype(bool)

    # only addresses with a colon reach Python values; the rest are passed as null
    return v4 | other(F.when(ip.contains(":"), ip))


def address_bits(addresses: DataFrame) -> DataFrame:
    """(ip, family, bits) of the distinct parseable values of the column `ip`."""
    distinct = addresses.select("ip").filter("ip is not null and ip <> ''").distinct()
    # behind a generator, so that filters on the bits don't repeat their making
    v4 = distinct.select("ip", F.lit(4).alias("family"), F.explode(F.array(bits_v4(F.col("ip")))).alias("bits")).filter("bits is not null")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            bits = f["ip"].map(parse_address)
            found = f.assign(bits=bits)[bits.notna()]
            yield found.assign(family=found["bits"].map(lambda b: 4 if len(b) == 32 else 6).astype("int32"))[["ip", "family", "bits"]]

    v6 = distinct.filter(F.col("ip").contains(":")).mapInPandas(parse, "ip string, family int, bits string")
    return v4.unionByName(v6)


def routable(bits: Column) -> Column:
    """False for addresses in UNROUTABLE."""
    inside = {4: F.lit(False), 6: F.lit(False)}
    for cidr in UNROUTABLE:
        family, network = parse_prefix(cidr)
        inside[family] |= bits.startswith(network)
    return F.when(F.length(bits) == 32, ~inside[4]).otherwise(~inside[6])
