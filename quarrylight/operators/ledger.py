"""The store: tables of files that a ledger names. What a commit adds or takes away, in all tables, is seen at once or not at all.

A writer puts its files into folders of its batch, which nobody reads yet, and then adds one page to the ledger: a small file that is
written aside and renamed. A page tells which files come and which go, with their rows, ids and times, and the batch that they are of. So

* a batch that is replayed after a crash overwrites its own folders and commits once; if it had committed, it is skipped;
* readers see whole commits only, and open only the files that can hold what they ask for (least and largest id and time);
* rows are removed by pages as well: whole files by their times, without reading them, and the files of the day at the edge by rewriting it.

Every SUMMARY pages are summed up in one, so a reader opens a bounded number. One writer at a time; any number of readers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..deploy import delete_folder
from ..functions.fields import ALERT, EVENT, storage_time

#: Pages after which one sums up all before it, and rows of a file that compaction aims at.
SUMMARY, FILE_ROWS = 20, 1_000_000
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


@dataclass(frozen=True)
class Part:
    """A file of a table. Times are microseconds; files of tables without ids or times have none."""

    table: str
    path: str
    rows: int
    low_id: int | None = None
    high_id: int | None = None
    low_time: int | None = None
    high_time: int | None = None

    @property
    def bucket(self) -> int | None:
        """The bucket of a file of the table of states."""
        found = re.search(r"/of=(\d+)/", self.path)
        return int(found[1]) if found else None


class Ledger:
    """Pages 1, 2, ... in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._seen: tuple[int, list[Part], dict] = (0, [], {})

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _read(self, path: str) -> dict | None:
        fs, at = self._fs(path)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write(self, path: str, page: dict) -> None:
        """Aside first: a page is there as a whole or not at all."""
        fs, at = self._fs(path)
        _, aside = self._fs(f"{self.path}/.{path.rpartition('/')[2]}.writing")
        stream = fs.create(aside, True)
        try:
            stream.write(bytearray(json.dumps(page).encode()))
        finally:
            stream.close()
        if not fs.rename(aside, at):
            raise OSError(f"{path} is there already")

    def _page(self, number: int) -> str:
        return f"{self.path}/{number:012d}.json"

    def _latest_summary(self) -> int:
        fs, at = self._fs(self.path)
        if not fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return max((int(n[:12]) for n in names if n.endswith(".all.json")), default=0)

    def read(self) -> tuple[int, list[Part], dict]:
        """The last page's number, the files that are there, and what the last page that says so tells of each topic (notes)."""
        number, parts, notes = self._seen
        if not number:
            summary = self._latest_summary()
            if summary:
                whole = self._read(f"{self.path}/{summary:012d}.all.json")
                number, parts, notes = summary, [Part(**p) for p in whole["adds"]], whole["notes"]
        while (page := self._read(self._page(number + 1))) is not None:
            gone = set(page["removes"])
            parts = [p for p in parts if p.path not in gone] + [Part(**p) for p in page["adds"]]
            number, notes = number + 1, notes | page["notes"]
        self._seen = number, parts, notes
        return number, list(parts), dict(notes)

    def commit(self, adds: Iterable[Part] = (), removes: Iterable[str] = (), notes: dict | None = None) -> int:
        number, _, _ = self.read()
        self._write(self._page(number + 1), {"adds": [asdict(p) for p in adds], "removes": list(removes), "notes": notes or {}})
        number, parts, all_notes = self.read()
        if number % SUMMARY == 0:
            self._write(f"{self.path}/{number:012d}.all.json", {"adds": [asdict(p) for p in parts], "removes": [], "notes": all_notes})
        return number


#: What each table's files are told apart by: the columns of their ids and times.
_ZONES = {"events": ("id", "timestamp"), "alerts": ("id", "last_seen")}


class Store:
    """Events, alerts and what the rules remember, under one ledger."""

    def __init__(self, spark: SparkSession, path: str, state_schema: str = ""):
        self.spark, self.path = spark, path
        self.ledger = Ledger(spark, f"{path}/ledger")
        self.schemas = {"events": StructType.fromDDL(EVENT), "alerts": StructType.fromDDL(ALERT)}
        if state_schema:
            self.schemas["state"] = StructType.fromDDL(state_schema)

    # -- reading

    def parts(self, table: str, ids: tuple[int, int] | None = None, times: tuple[int, int] | None = None) -> list[Part]:
        """The files of a table that can hold ids and times (microseconds) in these ranges, ends included."""
        found = [p for p in self.ledger.read()[1] if p.table == table]
        if ids:
            found = [p for p in found if p.low_id is None or (p.low_id <= ids[1] and p.high_id >= ids[0])]
        if times:
            found = [p for p in found if p.low_time is None or (p.low_time <= times[1] and p.high_time >= times[0])]
        return found

    def table(self, table: str, parts: list[Part] | None = None) -> DataFrame:
        found = self.parts(table) if parts is None else parts
        if not found:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*[p.path for p in found])

    def state(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """What the rules remember: all, or that of some buckets."""
        wanted = None if buckets is None else set(buckets)
        return self.table("state", [p for p in self.parts("state") if wanted is None or p.bucket in wanted])

    def events(self, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
        """Events, of a time range if one is given; only files that reach into it are opened."""
        low, high = (micros(t) if t else None for t in (since, until))
        bounds = (low if low is not None else -(2**63), high if high is not None else 2**63) if since or until else None
        out = self.table("events", self.parts("events", times=bounds))
        out = out.filter(F.col("timestamp") >= F.lit(since)) if since else out
        return out.filter(F.col("timestamp") < F.lit(until)) if until else out

    def alerts(self) -> DataFrame:
        return self.table("alerts")

    def get_events(self, ids: Iterable[int]) -> DataFrame:
        """Events by their ids, in the order of ids; only files whose ids reach around one of them are opened."""
        ids = sorted(set(ids))
        parts = [p for p in self.parts("events") if any(p.low_id <= i <= p.high_id for i in ids)]
        return self.table("events", parts).filter(F.col("id").isin(ids)).orderBy("id")

    def page(self, limit: int, before_id: int = 0, where: Column | None = None) -> DataFrame:
        """The newest events, by id: files are opened from the newest on until no other can hold a row of the page."""
        rest = sorted(self.parts("events", ids=(0, before_id - 1) if before_id else None), key=lambda p: -p.high_id)
        opened: list[Part] = []
        while True:
            # enough rows as they are counted; a filter may need more of them, so the number doubles
            want, have = max(limit, 2 * sum(p.rows for p in opened)), sum(p.rows for p in opened)
            while rest and (have < want or rest[0].high_id >= min(p.low_id for p in opened)):
                opened.append(rest.pop(0))
                have += opened[-1].rows
            found = self.table("events", opened)
            found = found.filter(F.col("id") < before_id) if before_id else found
            found = (found.filter(where) if where is not None else found).orderBy(F.desc("id")).limit(limit)
            if not rest or found.count() == limit:
                return found

    # -- writing

    def write(self, rows: DataFrame, table: str, folder: str, days: str = "") -> list[Part]:
        """Write rows into a folder that no page names yet, over what an earlier try has left there. `days`: the column by whose days files are parted; states are parted by bucket."""
        path = f"{self.path}/{table}/{folder}"
        writer = rows.withColumn("day", F.to_date(days)).write.partitionBy("day") if days else rows.repartition("bucket").withColumn("of", F.col("bucket")).write.partitionBy("of") if table == "state" else rows.write
        writer.mode("overwrite").parquet(path)
        at, time = _ZONES.get(table, (None, None))
        stats = [F.count(F.lit(1)).alias("rows")]
        if at:
            stats += [F.min(at).alias("low_id"), F.max(at).alias("high_id"), F.min(F.unix_micros(time)).alias("low_time"), F.max(F.unix_micros(time)).alias("high_time")]
        files = self.spark.read.schema(self.schemas[table]).parquet(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(*stats).collect()  # a row a file
        return sorted((Part(table, **f.asDict()) for f in files), key=lambda p: p.path)

    def last_batch(self) -> int:
        """The last batch that committed; -1 before the first."""
        return self.ledger.read()[2].get("batch", -1)

    def commit_batch(self, batch: int, events: DataFrame | None = None, alerts: DataFrame | None = None, state: DataFrame | None = None, buckets: Iterable[int] | None = None, parts: Iterable[Part] = ()) -> int:
        """One page for all that a batch leaves. Tables that are given are written first; a state takes the place of that of its buckets (None: of all). Returns the number of the batch's events."""
        adds = list(parts)
        if events is not None:
            adds += self.write(storage_time(events), "events", f"batch-{batch}", "timestamp")
        if alerts is not None:
            adds += self.write(alerts, "alerts", f"batch-{batch}")
        removes: list[str] = []
        if state is not None:
            replaced = None if buckets is None else set(buckets)
            removes = [p.path for p in self.parts("state") if replaced is None or p.bucket in replaced]
            adds += self.write(state, "state", f"batch-{batch}")
        self.ledger.commit(adds, removes, {"batch": batch})
        self.delete(removes)
        return sum(p.rows for p in adds if p.table == "events")

    def delete(self, paths: Iterable[str]) -> None:
        """Files that no page names any more. A reader that has planned with them fails and reads the ledger anew."""
        for path in paths:
            delete_folder(self.spark, path)

    def expire(self, now: datetime, retention: timedelta) -> dict:
        """Remove events older than the retention; alerts stay. Returns the numbers of files removed and rewritten and of rows that went."""
        edge = micros(now - retention)
        old = self.parts("events", times=(-(2**63), edge - 1))
        whole, cut = [p for p in old if p.high_time < edge], [p for p in old if p.high_time >= edge]
        adds = []
        if cut:
            number = self.ledger.read()[0]
            kept = self.table("events", cut).filter(F.unix_micros("timestamp") >= edge)
            adds = self.write(kept.coalesce(max(1, sum(p.rows for p in cut) // FILE_ROWS)), "events", f"kept-{number}", "timestamp")
        if old:
            self.ledger.commit(adds, [p.path for p in old])
            self.delete(p.path for p in old)
        return {"removed": len(whole), "rewritten": len(cut), "rows": sum(p.rows for p in old) - sum(p.rows for p in adds)}

    def compact(self, least_rows: int = FILE_ROWS) -> int:
        """Merge the small event files of each day; returns how many there were."""
        days: dict[int, list[Part]] = {}
        for p in self.parts("events"):
            if p.rows < least_rows:
                days.setdefault(p.low_time // 86_400_000_000, []).append(p)
        small = [p for parts in days.values() if len(parts) > 1 for p in parts]
        if small:
            n = max(1, sum(p.rows for p in small) // least_rows)
            merged = self.table("events", small).repartitionByRange(n, "id").sortWithinPartitions("id")
            adds = self.write(merged, "events", f"merged-{self.ledger.read()[0]}", "timestamp")
            self.ledger.commit(adds, [p.path for p in small])
            self.delete(p.path for p in small)
        return len(small)


def micros(t: datetime) -> int:
    return (t - _EPOCH) // timedelta(microseconds=1)
