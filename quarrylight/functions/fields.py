"""The event and alert tables, and addressing of event fields by name."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT = "id bigint, timestamp timestamp, source string, host string, type string, src_ip string, user string, message string, fields map<string,string>"
ALERT = "id bigint, rule_id string, rule_name string, severity string, group_key string, count int, description string, first_seen timestamp, last_seen timestamp, event_ids array<bigint>, status string, created_at timestamp"

SEVERITIES = ("low", "medium", "high", "critical")
STATUSES = ("open", "acknowledged", "closed")

_ALWAYS = ("type", "source", "message")
_IF_FILLED = ("host", "src_ip", "user")
_PREFIX = "fields."


class Ref(NamedTuple):
    """An event field: its value, '' where it is missing, and whether the event has it. Neither is ever null."""

    value: Column
    exists: Column


def field_ref(name: str) -> Ref:
    """`type`, `source` and `message` always exist; `host`, `src_ip` and `user` if filled; all else is a key of `fields`."""
    if name in _ALWAYS:
        return Ref(F.coalesce(F.col(name), F.lit("")), F.lit(True))
    if name in _IF_FILLED:
        value = F.coalesce(F.col(name), F.lit(""))
        return Ref(value, value != "")
    key = name[len(_PREFIX) :] if name.startswith(_PREFIX) and len(name) > len(_PREFIX) else name
    found = F.try_element_at(F.col("fields"), F.lit(key))
    return Ref(F.coalesce(found, F.lit("")), F.coalesce(F.map_contains_key("fields", key), F.lit(False)))


def severity_rank(severity: Column) -> Column:
    """low 1 to critical 4, anything else 0."""
    out = F.lit(0)
    for i, name in enumerate(SEVERITIES, 1):
        out = F.when(severity == name, i).otherwise(out)
    return out


def storage_time(events: DataFrame) -> DataFrame:
    """Events as stored: times cut to milliseconds."""
    return events.withColumn("timestamp", F.timestamp_millis(F.unix_millis("timestamp")))
