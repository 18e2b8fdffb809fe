"""Queries over the event and alert tables, and the numbering of their rows.

Filters are plain columns, so they reach the Parquet scan; lists are ordered top-k (limit is a feature of the API: a page).
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..deploy import checkpointed
from ..functions.fields import STATUSES

PAGE, MOST = 100, 1000


class NotFound(LookupError):
    pass


def page_size(limit: int) -> int:
    return PAGE if limit <= 0 else min(limit, MOST)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def message_has(text: str, message: str = "message") -> Column:
    """Substring search that ignores the case of ASCII letters only; the text is literal."""
    return F.contains(ascii_lower(F.col(message)), F.lit("".join(c.lower() if c in string.ascii_uppercase else c for c in text)))


def list_events(events: DataFrame, *, type: str = "", source: str = "", src_ip: str = "", user: str = "", query: str = "", since: datetime | None = None, until: datetime | None = None, before_id: int = 0, limit: int = 0) -> DataFrame:
    """Newest events first. Empty filters are off."""
    for name, want in (("type", type), ("source", source), ("src_ip", src_ip), ("user", user)):
        if want:
            events = events.filter(F.col(name) == want)
    if query:
        events = events.filter(message_has(query))
    if since:
        events = events.filter(F.col("timestamp") >= F.lit(since))
    if until:
        events = events.filter(F.col("timestamp") < F.lit(until))
    if before_id:
        events = events.filter(F.col("id") < before_id)
    return events.orderBy(F.desc("id")).limit(page_size(limit))


def list_alerts(alerts: DataFrame, *, status: str = "", severity: str = "", rule_id: str = "", group_key: str = "", before_id: int = 0, limit: int = 0) -> DataFrame:
    for name, want in (("status", status), ("severity", severity), ("rule_id", rule_id), ("group_key", group_key)):
        if want:
            alerts = alerts.filter(F.col(name) == want)
    if before_id:
        alerts = alerts.filter(F.col("id") < before_id)
    return alerts.orderBy(F.desc("id")).limit(page_size(limit))


def get_events(events: DataFrame, ids: Sequence[int]) -> DataFrame:
    return events.filter(F.col("id").isin(list(ids))).orderBy("id")


def get_alert(alerts: DataFrame, alert_id: int):
    found = alerts.filter(F.col("id") == alert_id).first()
    if found is None:
        raise NotFound(f"alert {alert_id}")
    return found


def alert_events(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """The events of alerts; ids whose events are gone are skipped."""
    ids = alerts.select(F.col("id").alias("alert_id"), F.explode("event_ids").alias("id")).distinct()
    return ids.join(events, "id").select("alert_id", *events.columns)


def with_status(alerts: DataFrame, log: DataFrame) -> DataFrame:
    """Alerts with the latest status of the log (alert_id, status, seq); without an entry their own."""
    latest = log.groupBy(F.col("alert_id").alias("id")).agg(F.max_by("status", "seq").alias("__status"))
    return alerts.join(latest, "id", "left").withColumn("status", F.coalesce("__status", "status")).select(*alerts.columns)


def set_status(alerts: DataFrame, log_path: str, alert_id: int, status: str, seq: int) -> None:
    """Append a change to the status log."""
    if status not in STATUSES:
        raise ValueError(f"status must be one of {', '.join(STATUSES)}")
    get_alert(alerts, alert_id)
    alerts.sparkSession.createDataFrame([(alert_id, status, seq)], "alert_id bigint, status string, seq bigint").write.mode("append").parquet(log_path)


def kept_events(events: DataFrame, now: datetime, retention: timedelta) -> DataFrame:
    """Events that the retention keeps; alerts outlive their events."""
    return events.filter(F.col("timestamp") >= F.lit(now - retention))


#: A partition's rows are numbered in the low bits of what Spark calls monotonically increasing ids.
_ROW_BITS = 33


def with_ids(events: DataFrame, after: int = 0, order: Sequence[str] = ("timestamp",), folder: str | None = None) -> DataFrame:
    """Ids after + 1, after + 2, ... in the given order, without a sort on one task.

    Rows are dealt to ranges, sorted and numbered there; the numbered rows are kept (in `folder`, which is the caller's to delete, or as a
    checkpoint), and both the sizes of the ranges and the ids are read from that, so that they can't differ. Rows that are equal in the order follow a hash of all they hold.
    """
    payload = [c for c in events.columns if c != "id"]
    kinds = dict(events.dtypes)
    tie = F.xxhash64(*[F.to_json(F.struct(c)) if "map" in kinds[c] else F.col(c) for c in payload])
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, "__tie"]
    ranged = events.select(*payload).withColumn("__tie", tie).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    ranged = ranged.withColumn("__row", F.monotonically_increasing_id()).drop("__tie")
    if folder:
        ranged.write.mode("overwrite").parquet(folder)
        ranged = events.sparkSession.read.schema(ranged.schema).parquet(folder)
    else:
        ranged = checkpointed(ranged)
    part, nth = F.shiftright("__row", _ROW_BITS), F.col("__row").bitwiseAND((1 << _ROW_BITS) - 1)
    sizes = ranged.groupBy(part.alias("__part")).agg((F.max(nth) + 1).alias("n"))
    begins = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__begins"))  # a row a partition
    numbered = ranged.withColumn("__part", part).join(F.broadcast(begins), "__part")
    return numbered.select((F.lit(after) + F.col("__begins") + nth + 1).alias("id"), *payload)


def as_alerts(alerts: DataFrame, now: datetime) -> DataFrame:
    """Alerts as they are stored."""
    if "created_at" not in alerts.columns:
        alerts = alerts.withColumn("created_at", F.lit(now).cast("timestamp"))
    return alerts.withColumn("status", F.coalesce("status", F.lit("open")))
