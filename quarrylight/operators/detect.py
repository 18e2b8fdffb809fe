"""Detection over a table of events, in (timestamp, id) order: match, threshold, distinct and sequence rules.

One scan compiles all rules into an array of the rules that an event concerns; exploding it gives slim hit rows, which are dealt by (rule, group).
A task takes its sorted rows as Arrow columns, many groups at a time, and counts without a loop over rows: how many hits a window holds
comes from a search in the sorted times; how many distinct values, from where each value comes next and when it falls out of the window;
a row at which the count reaches the threshold is a candidate. At most MOST_HITS hits count, as the rules' memory is bounded.

A candidate fires if the last fire of its group is at least a window older: from fire to fire another search leads to the next one. Clearing
the hits when a rule fires needs no work: hits up to the last fire are out of the window by the time the rule may fire again.

A group of more than SLICE_ROWS hits is cut into slices of about that many rows, at quantiles of its times. A slice has as halo the hits
before it that its windows can hold, but not more than its rules can remember, however long the window is. Which candidates
of a slice fire depends on the slices before only by the first of them. So it takes three steps:

1. Each slice tells, for every candidate that may be its first fire, what its last fire would be.
2. These few rows are read in time order group by group, which picks each slice's first fire.
3. Each slice is read again from its first fire on, and gives the fires with their counts and event ids.

Slices of a group that surely fires in its first one can't fire until a window after its first hit; they are left out where no later slice
remembers their rows. A rule that asks for more hits than MOST_HITS never fires and is left out from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..deploy import checkpointed
from ..functions.fields import field_ref
from ..plans.conditions import compile_condition
from ..plans.rules import Rule

MOST_HITS = 10_000
ALERT_IDS = 50
#: Rows of a slice of a large group, slices that a group has at most, and rows that a task looks at together at least.
SLICE_ROWS, MOST_SLICES, BLOCK_ROWS = 200_000, 1000, 100_000
#: Quantiles for each slice that tell where its halo begins.
HALO_STEPS = 16
#: Rows that a fold gives to Spark at a time.
OUT_ROWS = 10_000

_FIRE = "rule int, grp string, ts bigint, id bigint, ev array<string>, n int, since bigint, ids array<bigint>"
_ALERT = "rule_id string, rule_name string, severity string, group_key string, count int, description string, first_seen timestamp, last_seen timestamp, event_ids array<bigint>, status string"


def _hits(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """A row for each event and rule that it concerns: rule, grp, ts, id, first, then, val, ev (event values of the description)."""
    entries = []
    for n, rule in enumerate(rules):
        group = field_ref(rule.group_by) if rule.group_by else None
        grp = group.value if group else F.lit("")
        first, then = rule.matches(), F.lit(False)
        wanted = first
        if rule.kind == "sequence":
            then = compile_condition(rule.then)
            wanted = first | then
        else:
            first = F.lit(True)  # of the hits
        if rule.kind != "match":
            wanted &= group.exists & (group.value != "")
        values = [field_ref(f).value for f in rule.event_fields()]
        entry = F.struct(F.lit(n).alias("rule"), grp.alias("grp"), first.alias("first"), then.alias("then"), (field_ref(rule.distinct).value if rule.distinct else F.lit("")).alias("val"), (F.array(*values) if values else F.array().cast("array<string>")).alias("ev"))
        entries.append(F.when(wanted, entry))
    found = events.select(F.unix_micros("timestamp").alias("ts"), "id", F.explode(F.array(*entries)).alias("h")).filter("h is not null")
    return found.select("h.*", "ts", "id")


def _cuts(hits: DataFrame, rules: list[Rule]) -> DataFrame | None:
    """(rule, grp, cuts, halos) of the groups that are cut: the times at which the further slices begin, and for each the time at which its halo does. None if there are none."""
    sizes = hits.groupBy("rule", "grp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SLICE_ROWS)
    most = sizes.agg(F.max("n")).first()[0]
    if most is None:
        return None
    slices = min(MOST_SLICES, -(-most // SLICE_ROWS))
    steps, accuracy = slices * HALO_STEPS, slices * HALO_STEPS * 10
    large = hits.join(F.broadcast(sizes.select("rule", "grp")), ["rule", "grp"], "left_semi")  # a row for each SLICE_ROWS hits at most
    found = large.groupBy("rule", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("first").alias("m"), F.percentile_approx("ts", [i / slices for i in range(1, slices)], accuracy).alias("at"), F.percentile_approx(F.when(F.col("first"), F.col("ts")), [i / steps for i in range(1, steps)], accuracy).alias("marks")
    )
    # every so many of the quantiles cut the smaller ones of the large groups
    every = F.greatest(F.floor(F.lit(slices) * SLICE_ROWS / F.col("n")), F.lit(1)).cast("int")
    cuts = F.array_distinct(F.filter("at", lambda c, i: (i + 1) % every == 0))
    back = F.lit(2) + F.ceil(F.lit(MOST_HITS * steps) / F.greatest("m", F.lit(1))).cast("int")  # marks between which lie MOST_HITS hits, whatever the quantiles' error

    def halo(cut: Column) -> Column:
        mark = F.size(F.filter(F.coalesce("marks", F.array().cast("array<bigint>")), lambda m: m < cut)) - back
        return F.when(mark >= 0, F.get("marks", mark)).otherwise(F.lit(-(2**63)).cast("long"))

    return checkpointed(found.select("rule", "grp", cuts.alias("cuts"), F.transform(cuts, halo).alias("halos")))


def _quiet(hits: DataFrame, cuts: DataFrame, rules: list[Rule]) -> dict[tuple[int, str], int]:
    """For groups that surely fire in their first slice: up to which slice none from the second on can fire, as they end within a window of the group's first hit.

    Sure are match rules, and threshold rules that count hits if the first slice is no longer than the window and has enough of them.
    """
    least = {n: max(r.threshold, 1) for n, r in enumerate(rules) if r.kind == "match" or (r.kind == "threshold" and not r.distinct)}
    cuts = cuts.filter(F.col("rule").isin(list(least)) & (F.size("cuts") > 0))
    of = {(r["rule"], r["grp"]): r["cuts"] for r in cuts.collect()}
    if not of:
        return {}
    found = hits.join(F.broadcast(cuts.select("rule", "grp", F.element_at("cuts", 1).alias("cut"))), ["rule", "grp"])
    found = found.groupBy("rule", "grp").agg(F.count_if(F.col("ts") < F.col("cut")).alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high"))
    out = {}
    for r in found.collect():
        at, rule = of[r["rule"], r["grp"]], rules[r["rule"]]
        end = r["low"] + rule.window
        if r["n"] >= least[r["rule"]] and (rule.kind == "match" or at[0] <= end):
            upto = len(at) if r["high"] < end else sum(c <= end for c in at) - 1
            if upto > 0:
                out[r["rule"], r["grp"]] = upto
    return out


def _sliced(hits: DataFrame, cuts: DataFrame, rules: list[Rule], quiet: dict[tuple[int, str], int] | None = None) -> DataFrame:
    """The hits of large groups by slice; those that a later slice can remember are in it too, as halo. `begin` is the time at which the slice begins (null: the first).

    `quiet`: of groups in it the slices from the second to that one are left out.
    A row's slices are searched in its group's sorted cuts, so a row costs the same however many slices a group has. The driver holds the cuts: a number for each SLICE_ROWS rows.
    """
    spark, names, windows = hits.sparkSession, hits.columns, [min(r.window, 2**62) for r in rules]
    remembers = np.array([r.kind != "match" for r in rules])
    found = cuts.collect()
    held = spark.sparkContext.broadcast([(np.array(r["cuts"], np.int64), np.array(r["halos"], np.int64), windows[r["rule"]]) for r in found])
    upto_quiet = np.array([(quiet or {}).get((r["rule"], r["grp"]), 0) for r in found], np.int64)
    numbers = []
    for n, (r, last) in enumerate(zip(found, upto_quiet.tolist(), strict=True)):
        later = max(r["halos"][last], r["cuts"][last] - windows[r["rule"]]) if last < len(r["cuts"]) else None  # from then on hits are in the slices after the quiet ones
        numbers.append((r["rule"], r["grp"], n, r["cuts"][0] if last else None, later))
    numbers = spark.createDataFrame(numbers, "rule int, grp string, nth int, quiet long, later long")
    joined = hits.join(F.broadcast(numbers), ["rule", "grp"])
    if upto_quiet.any():
        joined = joined.filter(F.col("quiet").isNull() | (F.col("ts") < F.col("quiet")) | F.coalesce(F.col("ts") >= F.col("later"), F.lit(False)))
    joined = joined.select(*names, "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nth, ts = batch.column("nth").to_numpy(), batch.column("ts").to_numpy()
            by = np.argsort(nth, kind="stable")
            numbers, at = np.unique(nth[by], return_index=True)
            own, upto = np.zeros(len(ts), np.int64), np.zeros(len(ts), np.int64)
            for n, rows in zip(numbers.tolist(), np.split(by, at[1:]), strict=True):
                cut, halo, window = held.value[n]
                own[rows] = np.searchsorted(cut, ts[rows], "right")
                upto[rows] = np.minimum(np.searchsorted(halo, ts[rows], "right"), np.searchsorted(cut - window, ts[rows], "left"))
            halos = batch.column("first").to_numpy(zero_copy_only=False).astype(bool) & remembers[batch.column("rule").to_numpy()]
            places = np.where(halos, np.maximum(upto - own, 0), 0) + 1
            row = np.repeat(np.arange(len(ts)), places)
            further = np.arange(len(row)) - np.repeat(np.cumsum(places) - places, places)
            slice_ = own[row] + further
            if upto_quiet.any():
                open_ = (slice_ == 0) | (slice_ > upto_quiet[nth[row]])
                row, further, slice_ = row[open_], further[open_], slice_[open_]
            begin = np.zeros(len(row), np.int64)
            later = np.flatnonzero(slice_)
            for n in numbers.tolist():
                mine = later[nth[row[later]] == n] if len(numbers) > 1 else later
                begin[mine] = held.value[n][0][slice_[mine] - 1]
            out = batch.select(names).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(slice_, pa.int32()), pa.array(further > 0), pa.array(begin, mask=slice_ == 0)], names=[*names, "slice", "halo", "begin"])

    return joined.mapInArrow(run, StructType([*hits.schema, *StructType.fromDDL("slice int, halo boolean, begin bigint")])).repartition("rule", "grp", "slice")


def _blocks(batches: Iterator[pa.RecordBatch], key: list[str], rows: int | None = None) -> Iterator[pa.Table]:
    """Runs of whole groups of sorted rows, of `rows` or more each but the last."""
    held: list[pa.RecordBatch] = []
    rows = wanted = rows or BLOCK_ROWS
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= wanted:
            table = pa.Table.from_batches(held).combine_chunks()
            last = int(np.flatnonzero(_changes(table, key))[-1])
            if last:
                yield table.slice(0, last)
            table = table.slice(last)
            held, wanted = table.to_batches(), max(rows, 2 * table.num_rows)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _changes(table: pa.Table, key: list[str]) -> np.ndarray:
    """Whether a row begins another group than the one before."""
    out = np.zeros(table.num_rows, bool)
    out[:1] = True
    for name in key:
        c = table.column(name)
        out[1:] |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, table.num_rows - 1)), False).to_numpy()
    return out


class Groups:
    """A block of sorted hits of whole groups, and what rules count at each of them."""

    def __init__(self, table: pa.Table, rules: list[Rule], key: list[str], most: int = MOST_HITS):
        self.table, n = table, table.num_rows
        self.ts, self.ids = table.column("ts").to_numpy(), table.column("id").to_numpy()
        self.rule = table.column("rule").to_numpy()
        self.first, then = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("first", "then"))
        self.seg = np.cumsum(_changes(table, key)) - 1
        self.window = np.array([r.window for r in rules], np.int64)[self.rule]
        kinds = np.array([{"match": 0, "threshold": 1, "sequence": 2}[r.kind] for r in rules])[self.rule]
        least = np.array([r.threshold for r in rules])[self.rule]
        distinct = np.array([bool(r.distinct) for r in rules])[self.rule]
        self.kinds = kinds
        # one number for group and time, with more than a window between groups
        self.order = self._order()
        at = np.arange(n)
        # hits: all rows of a threshold rule, the first condition's of a sequence
        self.hits = np.flatnonzero(self.first & (kinds > 0))
        before = np.searchsorted(self.hits, at)  # hits before each row
        oldest = self._search(self.order[self.hits], self.order, self.window)
        upto = before + (kinds == 1)
        self.oldest, self.upto = np.maximum(oldest, upto - most), upto
        self.n = np.where(kinds == 0, 1, upto - self.oldest)
        if distinct.any():
            self.n = np.where(distinct, self._distinct(), self.n)
        fits = np.where(kinds == 0, True, (self.n >= least) & ((kinds == 1) | then))
        if "halo" in table.column_names:
            fits &= ~table.column("halo").to_numpy(zero_copy_only=False).astype(bool)
        found = np.flatnonzero(fits)
        again = np.zeros(len(found), bool)  # of one time the first
        again[1:] = self.order[found[1:]] == self.order[found[:-1]]
        self.found = found[~again]

    def _order(self) -> np.ndarray:
        low = self.ts.min()
        span = int(self.ts.max() - low) + int(self.window.max()) + 2
        if span * (int(self.seg[-1]) + 1) < 2**62:
            return self.seg * span + (self.ts - low)
        # times too far apart for one number: distances from each group's first row, cut where they exceed its window and so can't matter
        gap = np.diff(self.ts, prepend=self.ts[0])
        new = np.concatenate([[True], np.diff(self.seg) > 0])
        gap = np.where(new, self.window + 2, np.minimum(gap, self.window + 2))
        return np.cumsum(gap)

    @staticmethod
    def _search(times: np.ndarray, order: np.ndarray, window: np.ndarray) -> np.ndarray:
        """The first of the times that is less than a window before each row."""
        return np.searchsorted(times, order - window, side="right")

    def _distinct(self) -> np.ndarray:
        """Distinct values among the hits up to each row: a hit counts from its place to where its value comes again or it falls out of the window."""
        hits = self.hits
        if not len(hits):
            return np.zeros(len(self.ts), np.int64)
        value = self.table.column("val").combine_chunks().dictionary_encode()
        value = (value.chunk(0) if isinstance(value, pa.ChunkedArray) else value).indices.to_numpy(zero_copy_only=False)[hits]
        by = np.lexsort((np.arange(len(hits)), value, self.seg[hits]))
        again = np.full(len(hits), len(hits))
        same = (value[by][1:] == value[by][:-1]) & (self.seg[hits][by][1:] == self.seg[hits][by][:-1])
        again[by[:-1][same]] = by[1:][same]
        gone = np.searchsorted(np.maximum.accumulate(self.oldest[hits]), np.arange(len(hits)), side="right")
        count = np.cumsum(1 - np.bincount(np.minimum(again, gone), minlength=len(hits) + 1)[: len(hits)])
        out = np.zeros(len(self.ts), np.int64)
        out[hits] = count
        return out

    def chains(self) -> np.ndarray:
        """For each candidate the place of the next one that may fire after it; past the end where its group has none."""
        order = self.order[self.found]
        follow = np.searchsorted(order, order + self.window[self.found], side="left")
        inside = follow < len(order)
        inside[inside] = self.seg[self.found][follow[inside]] == self.seg[self.found][inside]
        return np.where(inside, follow, len(order))

    def firing(self, first: np.ndarray) -> np.ndarray:
        """All candidates that fire, from those of each group that fire first."""
        follow, out = self.chains(), [first]
        while len(first):
            first = follow[first]
            first = first[first < len(self.found)]
            out.append(first)
        return np.sort(np.concatenate(out))

    def group_starts(self) -> np.ndarray:
        """Each group's first candidate."""
        seg = self.seg[self.found]
        return np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]])) if len(seg) else np.zeros(0, np.int64)

    def told(self, which: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The fires at these candidates: rule, grp, ts, id, ev, n, since, ids."""
        for lo in range(0, len(which), OUT_ROWS):
            at = self.found[which[lo : lo + OUT_ROWS]]
            since, ids = self.ts[at].copy(), []
            for i, row in enumerate(at):  # a fire
                own = self.ids[row : row + 1]
                if self.kinds[row]:
                    a, b = self.oldest[row], self.upto[row]
                    since[i] = self.ts[self.hits[a]]
                    last = self.ids[self.hits[max(a, b - ALERT_IDS) : b]]
                    own = np.append(last, own) if self.kinds[row] == 2 else last
                ids.append(own)
            rows = self.table.take(pa.array(at))
            taken = [rows.column(c).combine_chunks().cast(t) for c, t in (("rule", pa.int32()), ("grp", pa.string()), ("ts", pa.int64()), ("id", pa.int64()), ("ev", pa.list_(pa.string())))]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids), pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken, pa.array(self.n[at], pa.int32()), pa.array(since, pa.int64()), lists], names=["rule", "grp", "ts", "id", "ev", "n", "since", "ids"])


def suppressed(hits: DataFrame, rules: list[Rule], events: int | None = None) -> DataFrame:
    """The fires among the hits of rules with a window: rule, grp, ts, id, ev, n, since, ids. `events`: how many events there are, if that is known; few can't make a large group."""
    cuts = None if events is not None and events <= SLICE_ROWS else _cuts(hits, rules)
    key, most = ["rule", "grp"], MOST_HITS
    whole = hits if cuts is None else hits.join(F.broadcast(cuts.select(*key)), key, "left_anti")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, key):
            groups = Groups(block, rules, key, most)
            yield from groups.told(groups.firing(groups.group_starts()))

    out = whole.repartition(*key).sortWithinPartitions(*key, "ts", "id").mapInArrow(fold, _FIRE)
    return out if cuts is None else out.unionByName(_of_slices(_sliced(hits, cuts, rules, _quiet(hits, cuts, rules)), rules))


def _of_slices(sliced: DataFrame, rules: list[Rule]) -> DataFrame:
    """The fires of groups that are cut into slices."""
    key, most = ["rule", "grp", "slice"], MOST_HITS

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every candidate that may be a slice's first fire, with the last fire that follows: those of its first window and the one after, as a fire before it ends its quiet by then."""
        for block in _blocks(batches, key):
            groups = Groups(block, rules, key, most)
            begin = block.column("begin").to_numpy(zero_copy_only=False).astype(float)[groups.found]
            ts = groups.ts[groups.found]
            early = ts < np.where(np.isnan(begin), -np.inf, begin + groups.window[groups.found])
            starts = np.zeros(len(ts), bool)
            starts[groups.group_starts()] = True
            may = early | starts | np.concatenate([[False], early[:-1]])
            follow = groups.chains()
            last = np.where(follow < len(ts), follow, np.arange(len(ts)))
            while not np.array_equal(jump := last[last], last):
                last = jump
            at = groups.found[may]
            rows = block.select(key).take(pa.array(at)).append_column("entry", pa.array(groups.ts[at])).append_column("last", pa.array(ts[last[may]], pa.int64()))
            yield from rows.to_batches()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each slice's first fire: from the last one before it a search leads to the first entry that is no longer quiet."""
        group, chosen, free = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            slices, entry, last = (batch.column(c).to_numpy() for c in ("slice", "entry", "last"))
            begins = [*np.flatnonzero(_changes(pa.Table.from_batches([batch]), ["rule", "grp"])).tolist(), batch.num_rows]
            out = []
            for at, end in zip(begins, begins[1:], strict=False):
                own = batch.column("rule")[at].as_py(), batch.column("grp")[at].as_py()
                if group != own:
                    group, chosen, free = own, None, None
                while True:
                    if chosen is not None:
                        at += max(int(np.searchsorted(slices[at:end], chosen, "right")), int(np.searchsorted(entry[at:end], free, "left")))
                    if at >= end:
                        break
                    out.append(at)
                    chosen, free = int(slices[at]), int(last[at]) + rules[own[0]].window
            if out:
                yield batch.select([*key, "entry"]).take(pa.array(out))

    def fires(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = (b.filter(b.column("entry").is_valid()) for b in batches)  # slices in which nothing fires have no entry
        for block in _blocks(some, key):
            groups = Groups(block, rules, key, most)
            entry = block.column("entry").to_numpy()[groups.found]
            yield from groups.told(groups.firing(np.flatnonzero(groups.ts[groups.found] == entry)))

    order = [*key, "ts", "id"]
    ends = sliced.sortWithinPartitions(*order).mapInArrow(entries, "rule int, grp string, slice int, entry long, last long")
    first = ends.repartition("rule", "grp").sortWithinPartitions("rule", "grp", "slice", "entry").mapInArrow(pick, "rule int, grp string, slice int, entry long")
    # a left join, as an inner one would filter its sides and so shuffle the hits a second time
    return sliced.join(first, key, "left").sortWithinPartitions(*order).mapInArrow(fires, _FIRE)


def evaluate(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """All alerts of the rules over the events: rule_id, rule_name, severity, group_key, count, description, first_seen, last_seen, event_ids, status."""
    rules = [r for r in rules if not r.disabled and (r.kind == "match" or r.threshold <= MOST_HITS)]
    if not rules:
        return events.sparkSession.createDataFrame([], _ALERT)
    hits = _hits(events, rules)
    at_once = [n for n, r in enumerate(rules) if r.window == 0]  # match rules that fire on every event
    found = None
    if len(at_once) < len(rules):
        found = suppressed(hits.filter(~F.col("rule").isin(at_once)) if at_once else hits, rules, events.count())  # of a stored table the footers tell
    if at_once:
        every = hits.filter(F.col("rule").isin(at_once)).select("rule", "grp", "ts", "id", "ev", F.lit(1).alias("n"), F.col("ts").alias("since"), F.array("id").alias("ids"))
        found = every if found is None else found.unionByName(every)
    return alerts_of(found, rules)


def alerts_of(fires: DataFrame, rules: list[Rule]) -> DataFrame:
    """Alert rows of fired candidates."""

    def by_rule(value) -> Column:
        out = F.lit(None)
        for n, r in enumerate(rules):
            out = F.when(F.col("rule") == n, value(r)).otherwise(out)
        return out

    def description(r: Rule) -> Column:
        names = r.event_fields()
        return r.describe(F.col("grp"), F.col("n"), lambda f: F.col("ev")[names.index(f)])

    return fires.select(
        by_rule(lambda r: F.lit(r.id)).alias("rule_id"), by_rule(lambda r: F.lit(r.name)).alias("rule_name"), by_rule(lambda r: F.lit(r.severity)).alias("severity"), F.col("grp").alias("group_key"), F.col("n").alias("count"), by_rule(description).alias("description"),
        F.timestamp_micros("since").alias("first_seen"), F.timestamp_micros("ts").alias("last_seen"), F.col("ids").alias("event_ids"), F.lit("open").alias("status"),
    )
