"""Threat feeds: lists of addresses and prefixes, read as text and kept as a table (feed_idx, feed, family, len, network)."""

from __future__ import annotations

import ipaddress
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import delete_folder, shared_folder
from ..functions.addresses import bits_of, parse_prefix

PREFIXES = "feed_idx int, feed string, family int, len int, network string"
MOST_BYTES = 64 << 20


@dataclass
class Feed:
    name: str
    path: str = ""
    url: str = ""


def validate_feeds(feeds: list[Feed]) -> None:
    seen = set()
    for f in feeds:
        if not f.name or "," in f.name or any(c.isspace() for c in f.name):
            raise ValueError(f"bad feed name {f.name!r}")
        if bool(f.path) == bool(f.url):
            raise ValueError(f"feed {f.name}: exactly one of path and url")
        if f.name in seen:
            raise ValueError(f"duplicate feed {f.name}")
        seen.add(f.name)


def parse_entry(text: str) -> tuple[int, int, str] | None:
    """Family, length and network bits of an entry; a bare address is a host prefix, IPv4-mapped ones are IPv4."""
    if "/" in text:
        found = parse_prefix(text)
        return found and (found[0], len(found[1]), found[1])
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return None
    address = getattr(address, "ipv4_mapped", None) or address
    return address.version, address.max_prefixlen, bits_of(address)


def parse_feed(lines: DataFrame, index: int, name: str) -> DataFrame:
    """Distinct prefixes of a feed's lines: what stands before # or ;, its first word. Wrong lines are left out."""
    entry = F.split(F.trim(F.regexp_replace("line", r"[#;].*", "")), r"\s+")[0]
    entries = lines.select(entry.alias("entry")).filter("entry <> ''").distinct()

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [x for x in map(parse_entry, f["entry"]) if x]
            yield pd.DataFrame([(index, name, *x) for x in found], columns=["feed_idx", "feed", "family", "len", "network"]).astype({"feed_idx": "int32", "family": "int32", "len": "int32"})

    return entries.mapInPandas(parse, PREFIXES).distinct()


def load_feed(spark: SparkSession, index: int, feed: Feed) -> DataFrame:
    """A feed's prefixes; content without a valid entry is a ValueError."""
    if feed.url:
        from urllib.request import urlopen

        with urlopen(feed.url, timeout=60) as r:
            if r.status != 200:
                raise ValueError(f"feed {feed.name}: status {r.status}")
            text = r.read(MOST_BYTES + 1)
        if len(text) > MOST_BYTES:
            raise ValueError(f"feed {feed.name}: too large")
        lines = spark.createDataFrame([(x,) for x in text.decode("utf-8", "replace").splitlines()] or [("",)], "line string")
    else:
        lines = spark.read.text(feed.path).withColumnRenamed("value", "line")
    out = parse_feed(lines, index, feed.name)
    if not out.limit(1).count() and lines.filter(F.trim("line") != "").limit(1).count():
        raise ValueError(f"feed {feed.name}: no valid entries")
    return out


class FeedSet:
    """Feeds with their last good content: a failed refresh keeps what there was and records the error."""

    def __init__(self, spark: SparkSession, feeds: list[Feed], every: timedelta = timedelta(hours=6), folder: str | None = None):
        validate_feeds(feeds)
        self.spark, self.feeds, self.every = spark, feeds, every
        self.folder = folder or f"{shared_folder(spark)}/feeds-{uuid.uuid4().hex}"
        self.asked: datetime | None = None
        self.paths: dict[str, str] = {}
        self.tables: dict[str, DataFrame] = {}
        self.loaded: dict[str, datetime] = {}
        self.errors: dict[str, str] = {}

    def refresh(self, now: datetime | None = None) -> None:
        """Read all feeds anew. Each version is a table of its own, as files may change or go; the last one is deleted once the new one is there."""
        self.asked = now or datetime.now(timezone.utc)
        for i, f in enumerate(self.feeds):
            path = f"{self.folder}/{f.name}-{uuid.uuid4().hex}"
            try:
                load_feed(self.spark, i, f).write.parquet(path)
            except (OSError, ValueError, Py4JError, PySparkException) as e:  # any failure of one feed leaves the others alone
                delete_folder(self.spark, path)
                self.errors[f.name] = str(e)
                continue
            if f.name in self.paths:
                delete_folder(self.spark, self.paths[f.name])
            self.paths[f.name], self.loaded[f.name] = path, self.asked
            self.tables[f.name] = self.spark.read.schema(PREFIXES).parquet(path)
            self.errors.pop(f.name, None)

    def refresh_if_due(self, now: datetime) -> bool:
        """Refresh once `every` has passed since the last time that was tried; a stream asks before each batch."""
        due = self.asked is None or now - self.asked >= self.every
        if due:
            self.refresh(now)
        return due

    def close(self) -> None:
        """Delete the tables."""
        for path in self.paths.values():
            delete_folder(self.spark, path)
        self.paths, self.tables = {}, {}

    def prefixes(self) -> DataFrame:
        out = self.spark.createDataFrame([], PREFIXES)
        for t in self.tables.values():
            out = out.unionByName(t)
        return out

    def status(self) -> DataFrame:
        rows = [(f.name, self.tables[f.name].count() if f.name in self.tables else 0, self.loaded.get(f.name), self.errors.get(f.name, "")) for f in self.feeds]
        return self.spark.createDataFrame(rows, "feed string, entries bigint, loaded_at timestamp, error string")
