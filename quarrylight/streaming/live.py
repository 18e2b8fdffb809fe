"""The live path: lines of a folder, parsed, enriched, stored and judged micro-batch by micro-batch.

pipeline_stream does all of it in one stream: a batch is numbered and written before it is judged, so alerts carry the ids under
which their events are stored. Events, alerts and what the rules remember become one page of the store's ledger, so a batch is there once
or not at all, however often it is replayed. Events that can't be written drop their batch; that is logged and counted, and the rules go on
from the last batch that committed. store_stream and alert_stream do one half each. Ids follow the time in a batch. Sinks get every
alert of a batch in order once it is stored; the webhook and the fan-out are best effort, as they are for people.
"""

from __future__ import annotations

import json
import logging
import queue
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from urllib.error import HTTPError
from urllib.request import Request, urlopen

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..deploy import delete_folder
from ..functions.fields import SEVERITIES, storage_time
from ..operators import intel
from ..operators import store as store_ops
from ..operators.detect import alerts_of
from ..operators.ledger import Part, Store
from ..plans.rules import Rule
from ..sources import parsers
from ..sources.feeds import FeedSet
from .detection import JUDGED, STATE, STATE_BUCKETS, judged, live_alerts, touched_buckets

log = logging.getLogger(__name__)


@dataclass
class Counters:
    ingested: int = 0
    alerts: int = 0
    store_failures: int = 0
    engine_state: int = 0  #: groups that the rules remember
    queued: int = 0  #: lines of the batch that is being worked on


@dataclass
class Hub:
    """Live fan-out: every subscriber has a bounded queue; what doesn't fit is lost to it."""

    depth: int = 64
    subscribers: list[queue.Queue] = field(default_factory=list)

    def subscribe(self) -> queue.Queue:
        q: queue.Queue = queue.Queue(self.depth)
        self.subscribers.append(q)
        return q

    def publish(self, message: dict) -> None:
        for q in self.subscribers:
            try:
                q.put_nowait(message)
            except queue.Full:
                pass


class Webhook:
    """Alerts of at least a severity, posted as JSON by one thread: three tries, and answers below 500 are final."""

    def __init__(self, url: str, min_severity: str = "low", depth: int = 256, pauses: tuple[float, ...] = (2, 4), post: Callable[[str, bytes], int] | None = None):
        self.url, self.least, self.pauses = url, SEVERITIES.index(min_severity), pauses
        self.queue: queue.Queue = queue.Queue(depth)
        self.post = post or _post
        threading.Thread(target=self._work, daemon=True).start()

    def notify(self, alert: dict) -> bool:
        """False if the severity is too low or the queue is full."""
        if alert["severity"] not in SEVERITIES or SEVERITIES.index(alert["severity"]) < self.least:
            return False
        try:
            self.queue.put_nowait(alert)
        except queue.Full:
            return False
        return True

    def _work(self) -> None:
        while True:
            alert = self.queue.get()
            text = f"[{alert['severity']}] {alert['rule_name']}: {alert['description']}"
            body = json.dumps({"text": text, "alert": alert}, default=str).encode()
            for pause in (*self.pauses, None):
                try:
                    if self.post(self.url, body) < 500:
                        break
                except OSError:
                    pass
                if pause is not None:
                    time.sleep(pause)
            self.queue.task_done()


def _post(url: str, body: bytes) -> int:
    try:
        with urlopen(Request(url, body, {"Content-Type": "application/json"}), timeout=10) as r:
            return r.status
    except HTTPError as e:
        return e.code


#: Batches from one look at all that the rules remember to the next.
SWEEP = 50
#: Bytes of one request of lines.
MOST_INGEST_BYTES = 10 << 20


def ingest_lines(spark: SparkSession, lines: list[str], parser: str = "json", now: datetime | None = None) -> tuple[DataFrame, dict]:
    """Lines of one request: their events, and a report with the reasons of at most five lines that failed. A request that is too large is a ValueError."""
    if sum(len(x.encode("utf-8", "surrogatepass")) + 1 for x in lines) > MOST_INGEST_BYTES:
        raise ValueError(f"more than {MOST_INGEST_BYTES} bytes")
    frame = spark.createDataFrame([(x,) for x in lines] or [("",)], "line string")
    parsed = parsers.parse_lines(frame, parser, now or datetime.now(timezone.utc))
    return parsers.events_of(parsed), parsers.parse_report(parsed).first().asDict() | {"errors": parsers.failures(parsed)}


def open_store(spark: SparkSession, path: str) -> Store:
    """The store that live streams write."""
    return Store(spark, path, STATE)


def _numbered(batch: DataFrame, batch_id: int, store: Store, parser: str, feeds: FeedSet | None, now: datetime) -> DataFrame:
    """A batch's events with their ids, kept in a folder of the batch until it is done. A batch has its own range of ids."""
    events = parsers.events_of(parsers.parse_lines(batch, parser, now))
    if feeds is not None:
        feeds.refresh_if_due(now)
        events = intel.enrich(events, feeds.prefixes())
    return store_ops.with_ids(events, after=batch_id << 32, order=("timestamp", "source", "message"), folder=f"{store.path}/work/events-{batch_id}")


def _stored(store: Store, events: DataFrame, batch_id: int, counters: Counters) -> list[Part] | None:
    """The files of the batch's events, which no page names yet; None if they can't be written, which drops the batch."""
    try:
        return store.write(storage_time(events), "events", f"batch-{batch_id}", "timestamp")
    except (OSError, Py4JError, PySparkException):
        log.exception("batch %s is dropped: its events can't be written", batch_id)
        counters.store_failures += 1
        return None


def _start(lines: DataFrame, process: Callable[[DataFrame, int], None], store: Store, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    """Batches that have committed are skipped when Spark replays them; what a batch kept for its work goes with it."""

    def once(batch: DataFrame, batch_id: int) -> None:
        if batch_id > store.last_batch():
            try:
                process(batch, batch_id)
            finally:
                delete_folder(store.spark, f"{store.path}/work")

    return lines.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "200 milliseconds"})).start()


def store_stream(lines: DataFrame, parser: str, store: Store, checkpoint: str, feeds: FeedSet | None = None, counters: Counters | None = None, now: datetime | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Parse, enrich, number and store a stream of lines."""
    counters = counters or Counters()

    def process(batch: DataFrame, batch_id: int) -> None:
        events = _numbered(batch, batch_id, store, parser, feeds, now or datetime.now(timezone.utc))
        parts = _stored(store, events, batch_id, counters)
        if parts is not None:
            counters.ingested += store.commit_batch(batch_id, parts=parts)

    return _start(lines, process, store, checkpoint, trigger)


def _announce(alerts: DataFrame, hub: Hub | None, webhook: Webhook | None) -> None:
    if hub or webhook:
        for row in alerts.orderBy("id").toLocalIterator():
            alert = row.asDict()
            if hub:
                hub.publish({"kind": "alert", "alert": alert})
            if webhook:
                webhook.notify(alert)


def pipeline_stream(
    lines: DataFrame, parser: str, rules: list[Rule], store: Store, checkpoint: str, feeds: FeedSet | None = None, hub: Hub | None = None, webhook: Webhook | None = None, counters: Counters | None = None, now: datetime | None = None, trigger: dict | None = None, retention: timedelta | None = None
) -> StreamingQuery:
    """Parse, enrich, number, store and judge a stream of lines. With a retention, older events are removed once an hour."""
    spark, counters = lines.sparkSession, counters or Counters()
    rules = [r for r in rules if not r.disabled]
    cleaned: list[datetime] = []

    def process(batch: DataFrame, batch_id: int) -> None:
        at = now or datetime.now(timezone.utc)
        if retention is not None and (not cleaned or at - cleaned[-1] >= timedelta(hours=1)):
            store.expire(at, retention)
            cleaned[:] = [at]
        events = _numbered(batch, batch_id, store, parser, feeds, at)
        counters.queued = batch.count()
        parts = _stored(store, events, batch_id, counters)
        if parts is None:
            counters.queued = 0
            return
        out_path = f"{store.path}/work/judged-{batch_id}"
        # once in SWEEP batches all groups are looked at, and those that have gone quiet leave
        buckets = list(range(STATE_BUCKETS)) if batch_id % SWEEP == 0 else touched_buckets(events, rules)
        judged(events, store.state(buckets), rules).write.mode("overwrite").parquet(out_path)
        out = spark.read.schema(JUDGED).parquet(out_path)
        found = alerts_of(out.filter("fire is not null").select("fire.*"), rules)
        found = store_ops.with_ids(found, after=batch_id << 32, order=("last_seen", "rule_id", "group_key"), folder=f"{store.path}/work/alerts-{batch_id}")
        counters.ingested += store.commit_batch(batch_id, alerts=store_ops.as_alerts(found, at), state=out.filter("fire is null").drop("fire"), buckets=buckets, parts=parts)
        counters.engine_state = sum(p.rows for p in store.parts("state"))
        counters.alerts += sum(p.rows for p in store.parts("alerts", ids=(batch_id << 32, (batch_id + 1 << 32) - 1)))
        if hub:
            hub.publish({"kind": "events", "count": counters.queued})
        _announce(found, hub, webhook)
        counters.queued = 0

    return _start(lines, process, store, checkpoint, trigger)


def alert_stream(events: DataFrame, rules: list[Rule], store: Store, checkpoint: str, hub: Hub | None = None, webhook: Webhook | None = None, counters: Counters | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Judge a stream of events by Spark's keyed state and store the alerts; sinks hear of each."""
    counters = counters or Counters()

    def process(batch: DataFrame, batch_id: int) -> None:
        found = store_ops.with_ids(batch, after=batch_id << 32, order=("last_seen", "rule_id", "group_key"), folder=f"{store.path}/work/alerts-{batch_id}")
        store.commit_batch(batch_id, alerts=store_ops.as_alerts(found, datetime.now(timezone.utc)))
        counters.alerts += sum(p.rows for p in store.parts("alerts", ids=(batch_id << 32, (batch_id + 1 << 32) - 1)))
        _announce(found, hub, webhook)

    return _start(live_alerts(events, rules), process, store, checkpoint, trigger)
