"""Enrichment with threat feeds: the feeds whose prefixes contain an event's source address.

Each distinct address is cut at the prefix lengths that the feeds use (at most 33 + 129), and the pieces are joined with the
prefixes by equality. No range join, and addresses that occur often cost nothing extra.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import address_bits, routable

#: Prefixes below this number are broadcast; more are joined by a shuffle.
BROADCAST_PREFIXES = 200_000


def lookup(addresses: DataFrame, prefixes: DataFrame, public_only: bool = True) -> DataFrame:
    """(ip, lists): for each distinct address of the column `ip` in a feed, the names of its feeds in their order, comma-separated."""
    bits = address_bits(addresses)
    if public_only:
        bits = bits.filter(routable(F.col("bits")))
    side = prefixes.select("feed_idx", "feed", "family", "len", "network")
    kinds = side.groupBy("family", "len").count().collect()  # at most 162 rows
    lengths = {family: sorted(r["len"] for r in kinds if r["family"] == family) for family in (4, 6)}
    pick = F.when(F.col("family") == 4, F.array(*[F.lit(n) for n in lengths[4]]).cast("array<int>")).otherwise(F.array(*[F.lit(n) for n in lengths[6]]).cast("array<int>"))
    pieces = bits.select("ip", "family", "bits", F.explode(pick).alias("len")).withColumn("network", F.expr("substring(bits, 1, len)")).drop("bits")
    if sum(r["count"] for r in kinds) <= BROADCAST_PREFIXES:
        side = F.broadcast(side)
    found = pieces.join(side, ["family", "len", "network"]).select("ip", "feed_idx", "feed").distinct()
    named = found.groupBy("ip").agg(F.array_sort(F.collect_list(F.struct("feed_idx", "feed"))).alias("f"))
    return named.select("ip", F.array_join("f.feed", ",").alias("lists"))


def enrich(events: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Events with fields.ti_lists where a feed has their source address."""
    found = lookup(events.select(F.col("src_ip").alias("ip")), prefixes).withColumnRenamed("ip", "src_ip").withColumnRenamed("lists", "__lists")
    rest = F.map_filter(F.coalesce("fields", F.create_map().cast("map<string,string>")), lambda k, v: k != "ti_lists")
    fields = F.when(F.col("__lists").isNotNull(), F.map_concat(rest, F.create_map(F.lit("ti_lists"), F.col("__lists")))).otherwise(F.col("fields"))
    return events.join(found, "src_ip", "left").withColumn("fields", fields).select(*events.columns)
