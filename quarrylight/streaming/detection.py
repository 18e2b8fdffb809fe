"""Detection on a stream of events, with a state for each rule and group.

The state is what a rule still remembers of a group: the hits in its window and the time until which it is suppressed.
Rows of a micro-batch are folded in (timestamp, arrival id) order. Late rows are never dropped: a late row is judged by its own
time against what the state still holds. States leave by event time, by timers or with the batch that shows that their window has passed.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.detect import ALERT_IDS, MOST_HITS, Groups, _blocks, _changes, _hits, alerts_of
from ..plans.rules import Rule

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "ts array<bigint>, ids array<bigint>, vals array<string>, quiet_until bigint"
_FIRE = "rule int, grp string, ts bigint, id bigint, ev array<string>, n int, since bigint, ids array<bigint>"
#: What the rules remember of groups is kept in so many parts, of which a batch rewrites those that it has groups of.
STATE_BUCKETS = 64


class Memory:
    """Hits of one group, oldest first, how often each value is among them, and the end of the group's suppression."""

    def __init__(self, hits: Iterable[tuple[int, int, str]] = (), quiet_until: int | None = None, most: int | None = None):
        self.hits, self.quiet_until, self.most = deque(hits), quiet_until, MOST_HITS if most is None else most
        self.values = Counter(h[2] for h in self.hits)

    def drop(self) -> None:
        val = self.hits.popleft()[2]
        self.values[val] -= 1
        if not self.values[val]:
            del self.values[val]

    def prune(self, cutoff: int) -> None:
        while self.hits and self.hits[0][0] <= cutoff:
            self.drop()

    def add(self, hit: tuple[int, int, str], cutoff: int) -> None:
        self.hits.append(hit)
        self.values[hit[2]] += 1
        self.prune(cutoff)
        while len(self.hits) > self.most:
            self.drop()

    def clear(self) -> None:
        self.hits.clear(), self.values.clear()

    def last_ids(self) -> list[int]:
        return [h[1] for h in islice(reversed(self.hits), ALERT_IDS)][::-1]

    def columns(self) -> tuple[list[int], list[int], list[str]]:
        ts, ids, vals = map(list, zip(*self.hits, strict=True)) if self.hits else ([], [], [])
        return ts, ids, vals


def fold(memory: Memory, rule: Rule, row) -> tuple[int, int, list[int]] | None:
    """Take one row (ts, id, first, then, val): count, time of the oldest hit and event ids if the rule fires."""
    quiet = memory.quiet_until is not None and row.ts < memory.quiet_until
    if rule.kind == "match":
        if rule.window and quiet:
            return None
        memory.quiet_until = row.ts + rule.window
        return 1, row.ts, [row.id]
    cutoff, hit, fired = row.ts - rule.window, (row.ts, row.id, row.val), None
    if rule.kind == "sequence":
        if row.then:
            memory.prune(cutoff)
            if len(memory.hits) >= rule.threshold and not quiet:
                fired = len(memory.hits), memory.hits[0][0], [*memory.last_ids(), row.id]
        elif row.first:
            memory.add(hit, cutoff)
            return None
        if fired is None:
            if row.first:
                memory.add(hit, cutoff)
            return None
    else:
        memory.add(hit, cutoff)
        n = len(memory.values) if rule.distinct else len(memory.hits)
        if n < rule.threshold or quiet:
            return None
        fired = n, memory.hits[0][0], memory.last_ids()
    memory.clear()
    memory.quiet_until = row.ts + rule.window
    return fired


class RuleMemory(StatefulProcessor):
    """What a rule remembers of a group, in keyed state: its hits as a list and one row with the end of suppression and the time of the timer.

    A group has one timer. It is set with the group's first hit and looked at when the watermark passes it: if the group has had hits
    since, it is set anew, else the group's state goes. So a hit costs no timer of its own.
    """

    def __init__(self, rules: list[Rule]):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getListState("hits", "ts bigint, id bigint, val string")
        self.times = handle.getValueState("times", "quiet_until bigint, seen bigint, timer bigint")

    def _until(self, rule: Rule, seen: int, quiet_until: int | None) -> int:
        """The first millisecond at which nothing of a group counts any more."""
        return max(seen + rule.window, quiet_until or 0) // 1000 + 1

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rule = self.rules[key[0]]
        if not rule.window:  # each hit is an alert, so there is nothing to remember
            for r in rows:
                yield Row(rule=key[0], grp=key[1], ts=r.ts, id=r.id, ev=list(r.ev), **dict(zip(("n", "since", "ids"), fold(Memory(), rule, r), strict=True)))
            return
        times = self.times.get()
        quiet, seen, timer = times if times else (None, 0, None)
        memory = Memory(map(tuple, self.hits.get()) if times else (), quiet)
        for r in sorted(rows, key=lambda r: (r.ts, r.id)):
            seen = max(seen, r.ts)
            fired = fold(memory, rule, r)
            if fired:
                yield Row(rule=key[0], grp=key[1], ts=r.ts, id=r.id, ev=list(r.ev), **dict(zip(("n", "since", "ids"), fired, strict=True)))
        if memory.hits:
            self.hits.put(list(memory.hits))
        else:
            self.hits.clear()
        if timer is None:
            timer = max(self._until(rule, seen, memory.quiet_until), timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(timer)
        self.times.update((memory.quiet_until, seen, timer))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        quiet, seen, _ = self.times.get()
        until = self._until(self.rules[key[0]], seen, quiet)
        if until > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(until)
            self.times.update((quiet, seen, until))
        else:
            self.hits.clear()
            self.times.clear()
        return iter(())

    def close(self) -> None:
        pass


def live_alerts(events: DataFrame, rules: list[Rule], lateness: str = "1 hour") -> DataFrame:
    """Alerts of a streaming event table (with id), as operators.detect.evaluate gives them for a whole one.

    State leaves by event time, once the watermark, `lateness` behind the latest event, has passed all that a group is remembered for. So rows
    that come at most so late find what they would have found in time; later ones are judged too, against what is left. Events
    whose times lie ahead of the clock don't move the watermark beyond it. Rules with window 0 keep no state. Sets the session's state store to RocksDB, which timers need.
    """
    rules = [r for r in rules if not r.disabled]
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # the rows that are judged don't have the watermark's column, so that Spark drops none as late
    seen = events.withColumn("__seen", F.least("timestamp", F.current_timestamp())).withWatermark("__seen", lateness)
    fires = _hits(seen, rules).groupBy("rule", "grp").transformWithState(RuleMemory(rules), _FIRE, "Append", "EventTime")
    return alerts_of(fires, rules)


#: What rules remember of a group after a batch, and (fire) its alerts.
STATE = f"bucket int, rule int, grp string, {_STATE}, seen bigint"
JUDGED = f"{STATE}, fire struct<rule: int, grp: string, ts: bigint, id: bigint, ev: array<string>, n: int, since: bigint, ids: array<bigint>>"


def bucket_of() -> Column:
    return F.pmod(F.xxhash64("rule", "grp"), F.lit(STATE_BUCKETS)).cast("int").alias("bucket")


def touched_buckets(events: DataFrame, rules: list[Rule]) -> list[int]:
    """The buckets of the groups that a batch has hits of: at most STATE_BUCKETS numbers."""
    return sorted(r["bucket"] for r in _hits(events, rules).select(bucket_of()).distinct().collect())


#: Columns of a row that is judged: the head of a group's state (kind 0), a hit that it remembers (1), a row of the batch (2).
_ROW = ["bucket", "rule", "grp", "kind", "nth", "ts", "id", "first", "then", "val", "ev", "quiet_until"]
_NEVER = -(2**63)


def _remembered(state: DataFrame) -> DataFrame:
    """States as rows: for each group its head, with the time last seen, and its hits in their order."""
    none = F.array().cast("array<string>")

    def row(kind: int, nth: Column, ts: Column, id: Column, val: Column, quiet: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), nth.cast("int").alias("nth"), ts.alias("ts"), id.cast("bigint").alias("id"), F.lit(True).alias("first"), F.lit(False).alias("then"), val.alias("val"), none.alias("ev"), quiet.cast("bigint").alias("quiet_until"))

    head = row(0, F.lit(0), F.col("seen"), F.lit(0), F.lit(""), F.col("quiet_until"))
    hits = F.transform(F.arrays_zip("ts", "ids", "vals"), lambda h, i: row(1, i, h["ts"], h["ids"], h["vals"], F.lit(None)))
    return state.select("bucket", "rule", "grp", F.inline(F.concat(F.array(head), hits))).select(*_ROW)


def _judge(block: pa.Table, rules: list[Rule], key: list[str], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    """The fires in whole groups of sorted rows, and the groups' states after them.

    Groups whose rows come in order of time, after the hits that are remembered, are counted together in columns; those with late rows are folded row by row.
    """
    kind, ts, new = block.column("kind").to_numpy(), block.column("ts").to_numpy(), _changes(block, key)
    group, begins = np.cumsum(new) - 1, np.flatnonzero(new)
    window = np.array([min(r.window, 2**62) for r in rules], np.int64)[block.column("rule").to_numpy()[begins]]
    seen = np.maximum.reduceat(ts, begins)
    quiet = np.full(len(begins), _NEVER)
    heads = np.flatnonzero(kind == 0)
    quiet[group[heads]] = pc.fill_null(block.column("quiet_until").take(pa.array(heads)), _NEVER).to_numpy()
    rows = np.flatnonzero(kind)
    back = (group[rows][1:] == group[rows][:-1]) & (ts[rows][1:] < ts[rows][:-1])
    late = np.zeros(len(begins), bool)
    late[group[rows][1:][back]] = True
    hit_group, hit_row, fires = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []

    ordered = rows[~late[group[rows]]]
    if len(ordered):
        of = group[ordered]
        counted = Groups(block.take(pa.array(ordered)).append_column("halo", pa.array(kind[ordered] == 1)), rules, key, most)
        found = counted.found
        may = counted.ts[found] >= quiet[of[found]]
        entry = may.copy()
        entry[1:] &= ~(may[:-1] & (of[found][1:] == of[found][:-1]))
        firing = counted.firing(np.flatnonzero(entry))
        fires += counted.told(firing)
        at = found[firing]
        last = np.full(len(begins), -1)
        np.maximum.at(last, of[at], at)
        fired = np.flatnonzero(last >= 0)
        quiet[fired] = counted.ts[last[fired]] + window[fired]
        # hits after the last fire that the last row's window holds, as many as a rule remembers
        hits = counted.hits
        latest = np.full(len(begins), _NEVER)
        np.maximum.at(latest, of, counted.ts)
        left = hits[(hits > last[of[hits]]) & (counted.ts[hits] > latest[of[hits]] - window[of[hits]])]
        ends = np.searchsorted(of[left], of[left], "right")
        left = left[ends - np.arange(len(left)) <= most]
        hit_group.append(of[left])
        hit_row.append(ordered[left])

    if late.any():
        ids, kinds = block.column("id").to_numpy(), ("first", "then", "val", "ev")
        for g in np.flatnonzero(late).tolist():
            mine = rows[slice(*np.searchsorted(group[rows], [g, g + 1]))]
            rule = rules[block.column("rule")[int(begins[g])].as_py()]
            part = block.select(kinds).take(pa.array(mine)).to_pylist()
            old = np.flatnonzero(kind[mine] == 1)
            memory = Memory([(int(ts[mine[i]]), int(ids[mine[i]]), part[i]["val"]) for i in old], None if quiet[g] == _NEVER else int(quiet[g]), most)
            held = deque(mine[old].tolist())  # the rows of the memory's hits
            for i in np.flatnonzero(kind[mine] == 2).tolist():
                row = Row(ts=int(ts[mine[i]]), id=int(ids[mine[i]]), **part[i])
                out = fold(memory, rule, row)
                if out:
                    fires.append(_fire_batch(rule_number=block.column("rule")[int(begins[g])].as_py(), grp=block.column("grp")[int(begins[g])].as_py(), row=row, out=out))
                    held.clear()
                elif len(memory.hits) and memory.hits[-1][1] == row.id:
                    held.append(int(mine[i]))
                while len(held) > len(memory.hits):
                    held.popleft()
            quiet[g] = _NEVER if memory.quiet_until is None else memory.quiet_until
            hit_group.append(np.full(len(held), g))
            hit_row.append(np.array(held, np.int64))

    hit_group, hit_row = np.concatenate(hit_group), np.concatenate(hit_row)
    hit_row = hit_row[np.argsort(hit_group, kind="stable")]
    first = pa.array(np.concatenate([[0], np.cumsum(np.bincount(hit_group, minlength=len(begins)))]), pa.int32())
    own, held = block.select(key).take(pa.array(begins)), block.select(["ts", "id", "val"]).take(pa.array(hit_row)).combine_chunks()
    flat = [held.column(c).combine_chunks() if held.num_rows else pa.array([], t) for c, t in (("ts", pa.int64()), ("id", pa.int64()), ("val", pa.string()))]
    columns = [*own.columns, *[pa.ListArray.from_arrays(first, c) for c in flat], pa.array(quiet, mask=quiet == _NEVER), pa.array(seen), pa.nulls(len(begins), schema.field("fire").type)]
    yield from pa.table([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema).to_batches()
    for batch in fires:
        fire = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema.field("fire").type, strict=True)], fields=list(schema.field("fire").type))
        blank = [pa.nulls(batch.num_rows, f.type) for f in schema]
        yield pa.RecordBatch.from_arrays([*blank[:-1], fire], schema=schema)


def _fire_batch(rule_number: int, grp: str, row: Row, out: tuple[int, int, list[int]]) -> pa.RecordBatch:
    """One fire, in the columns that Groups.told gives."""
    columns = [pa.array([x], t) for x, t in ((rule_number, pa.int32()), (grp, pa.string()), (row.ts, pa.int64()), (row.id, pa.int64()), (list(row.ev), pa.list_(pa.string())), (out[0], pa.int32()), (out[1], pa.int64()), (out[2], pa.list_(pa.int64())))]
    return pa.RecordBatch.from_arrays(columns, names=["rule", "grp", "ts", "id", "ev", "n", "since", "ids"])


def judged(events: DataFrame, state: DataFrame, rules: list[Rule]) -> DataFrame:
    """The alerts of one batch of stored events, and what the rules remember after it of the groups in `state` and in the batch.

    Many groups are judged together in Arrow columns, so a group costs no call of its own. Groups leave by event time: once the latest event is
    more than a window after their last one, and they aren't quiet any more.
    """
    key, most, schema = ["bucket", "rule", "grp"], MOST_HITS, to_arrow_schema(StructType.fromDDL(JUDGED))
    ends = [f.agg(F.max(c)).first()[0] for f, c in ((events, F.unix_micros("timestamp")), (state, F.col("seen")))]
    latest = F.lit(max((e for e in ends if e is not None), default=0))
    window = F.element_at(F.array(*[F.lit(r.window) for r in rules]), F.col("rule") + 1)
    gone = F.col("fire").isNull() & (latest - F.col("seen") > window) & (F.coalesce("quiet_until", F.lit(0)) <= latest)
    hits, at_once = _hits(events, rules), [n for n, r in enumerate(rules) if not r.window]
    rows = (hits.filter(~F.col("rule").isin(at_once)) if at_once else hits).select(bucket_of(), "*", F.lit(2).alias("kind"), F.lit(0).alias("nth"), F.lit(None).cast("bigint").alias("quiet_until")).select(*_ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, key):
            yield from _judge(block, rules, key, schema, most)

    found = rows.unionByName(_remembered(state)).repartition(*key).sortWithinPartitions(*key, "kind", "nth", "ts", "id").mapInArrow(run, JUDGED).filter(~F.coalesce(gone, F.lit(False)))
    if at_once:  # each hit is an alert, and nothing is remembered
        fire = F.struct("rule", "grp", "ts", "id", "ev", F.lit(1).alias("n"), F.col("ts").alias("since"), F.array("id").alias("ids")).alias("fire")
        found = found.unionByName(hits.filter(F.col("rule").isin(at_once)).select(fire), allowMissingColumns=True)
    return found
