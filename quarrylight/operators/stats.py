"""Dashboard statistics."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durations import parse_duration
from ..functions.fields import severity_rank

TOP, MOST_BUCKETS = 10, 1440
#: Ranges of the dashboard and the width of their timeline's buckets (fixed values).
RANGES = {"15m": "30s", "1h": "1m", "6h": "5m", "24h": "15m"}


def range_preset(name: str = "") -> tuple[timedelta, timedelta]:
    name = name or "1h"
    if name not in RANGES:
        raise ValueError(f"range must be one of {', '.join(RANGES)}")
    return timedelta(microseconds=parse_duration(name)), timedelta(microseconds=parse_duration(RANGES[name]))


def totals(events: DataFrame, since: datetime) -> DataFrame:
    """One row: all events, and those since (without an upper bound)."""
    return events.agg(F.count(F.lit(1)).alias("total_events"), F.count(F.when(F.col("timestamp") >= F.lit(since), 1)).alias("window_events"))


def events_by_type(events: DataFrame, since: datetime) -> DataFrame:
    return events.filter(F.col("timestamp") >= F.lit(since)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def open_by_severity(alerts: DataFrame) -> DataFrame:
    return alerts.filter("status = 'open'").groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def alerts_by_status(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _top(rows: DataFrame, key: str, limit: int) -> DataFrame:
    return rows.filter(F.col(key) != "").groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(limit)


def top_sources(events: DataFrame, since: datetime, limit: int = TOP) -> DataFrame:
    """Most frequent source addresses; ties by address."""
    return _top(events.filter(F.col("timestamp") >= F.lit(since)), "src_ip", limit)


def top_alerted(alerts: DataFrame, since: datetime, limit: int = TOP) -> DataFrame:
    return _top(alerts.filter(F.col("created_at") >= F.lit(since)), "group_key", limit)


def flagged_sources(events: DataFrame, alerts: DataFrame, since: datetime) -> DataFrame:
    """Top sources with their number of alerts, 0 where they aren't among the most alerted."""
    flags = top_alerted(alerts, since).select(F.col("group_key").alias("src_ip"), F.col("n").alias("alerts"))
    return top_sources(events, since).join(F.broadcast(flags), "src_ip", "left").select("src_ip", "n", F.coalesce("alerts", F.lit(0)).alias("alerts"))


def _bucketed(rows: DataFrame, at: Column, start: int, now: int, width: int, name: str) -> DataFrame:
    micros = F.unix_micros(at)
    inside = rows.select(micros.alias("m")).filter(F.col("m").between(start, now))
    return inside.groupBy(F.expr(f"(m - {start}L) div {width}L").alias("bucket")).agg(F.count(F.lit(1)).alias(name))


def timeline(events: DataFrame, alerts: DataFrame, since: datetime, now: datetime, bucket: timedelta = timedelta(0)) -> DataFrame:
    """(start, events, alerts) for every bucket from since to now, empty ones with 0. Alerts count by last_seen; both ends count."""
    width = round((bucket if bucket > timedelta(0) else timedelta(minutes=1)).total_seconds() * 1e6)
    micros = lambda t: round(t.astimezone(timezone.utc).timestamp() * 1e6)
    start = micros(since) // width * width
    n = (micros(now) - start) // width + 1
    if n > MOST_BUCKETS:
        raise ValueError(f"more than {MOST_BUCKETS} buckets")
    grid = events.sparkSession.range(max(n, 0)).withColumnRenamed("id", "bucket")
    for rows, column, name in ((events, "timestamp", "events"), (alerts, "last_seen", "alerts")):
        grid = grid.join(_bucketed(rows, F.col(column), start, micros(now), width, name), "bucket", "left")
    return grid.select(F.timestamp_micros(F.col("bucket") * width + start).alias("start"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("events", "alerts")])


def open_and_high(alerts: DataFrame) -> DataFrame:
    """One row: open alerts, and those of them that are high or critical."""
    is_open = F.col("status") == "open"
    return alerts.agg(F.count(F.when(is_open, 1)).alias("open"), F.count(F.when(is_open & F.col("severity").isin("high", "critical"), 1)).alias("high"))


def search_rules(rules: DataFrame, text: str = "", origin: str = "") -> DataFrame:
    """Rules whose name, id, description or a tag holds the text, most severe first, then by name."""
    if text:
        hay = F.concat_ws("\n", "name", "id", "description", F.array_join("tags", "\n"))
        rules = rules.filter(F.contains(F.lower(hay), F.lit(text.lower())))
    if origin:
        rules = rules.filter(F.col("origin") == origin)
    return rules.orderBy(F.desc(severity_rank(F.col("severity"))), "name")


def rule_counts(rules: DataFrame) -> DataFrame:
    return rules.agg(F.count(F.when(~F.col("disabled"), 1)).alias("active"), F.count(F.when(F.col("origin") == "builtin", 1)).alias("builtin"), F.count(F.when(F.col("origin") == "sigma", 1)).alias("sigma"))
