import queue
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quarrylight.plans.rules import Rule
from quarrylight.sources.feeds import Feed, FeedSet
from quarrylight.sources.parsers import stream_lines
from quarrylight.streaming import live
from quarrylight.streaming.detection import Memory, fold, live_alerts
from quarrylight.streaming.live import Counters, Hub, Webhook, alert_stream, ingest_lines, open_store, pipeline_stream, store_stream

from .test_parsers import NOW
from .test_rules import EVENT, T0


def test_store_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.log").write_text("".join(f'{{"ts":{1741942800 + i},"type":"t","ip":"203.0.113.{i}","n":{i}}}\n' for i in range(5)) + "bad\n")
    feed = tmp_path / "feed.txt"
    feed.write_text("203.0.113.0/31\n")
    feeds = FeedSet(spark, [Feed("local", str(feed))])
    feeds.refresh()
    counters = Counters()
    lines = spark.readStream.text(str(inbox)).withColumnRenamed("value", "line")
    held = open_store(spark, str(tmp_path / "store"))
    store_stream(lines, "json", held, str(tmp_path / "cp"), feeds, counters, NOW, {"availableNow": True}).awaitTermination(120)
    rows = held.events().orderBy("id").collect()
    assert [r.id for r in rows] == [1, 2, 3, 4, 5] and counters.ingested == 5 and counters.store_failures == 0
    assert [r.fields.get("ti_lists") for r in rows] == ["local", "local", None, None, None]


def test_alert_stream(spark, tmp_path):
    rows = [(i, T0 + timedelta(seconds=s), "door", "", "refused", "192.0.2.1", "u", "m", {}) for i, s in enumerate([40, 52, 77, 99, 137, 138, 140], 1)]
    source = str(tmp_path / "events")
    spark.createDataFrame(rows[:4], EVENT).coalesce(1).write.parquet(source)
    rule = Rule(id="r", severity="high", kind="threshold", where={"type": "refused"}, group_by="src_ip", threshold=3, window=60_000_000).validate()
    hub, sent = Hub(), []
    heard = hub.subscribe()
    hook = Webhook("http://x", "medium", post=lambda url, body: sent.append(body) or 200)
    stream = spark.readStream.schema(EVENT).parquet(source)
    held = open_store(spark, str(tmp_path / "store"))
    run = lambda: alert_stream(stream, [rule], held, str(tmp_path / "cp"), hub, hook, trigger={"availableNow": True}).awaitTermination(120)
    run()
    spark.createDataFrame(rows[4:], EVENT).coalesce(1).write.mode("append").parquet(source)
    run()  # the state of the first run goes on
    got = held.alerts().orderBy("last_seen").select(F.unix_seconds("last_seen").alias("s"), "count", "event_ids", "status").collect()
    base = int(T0.timestamp())
    assert [(r.s - base, r["count"], r.event_ids) for r in got] == [(77, 3, [1, 2, 3]), (138, 3, [4, 5, 6])]
    hook.queue.join()
    assert len(sent) == 2 and heard.qsize() == 2 and heard.get()["alert"]["rule_id"] == "r"


def test_pipeline_stream(spark, tmp_path, monkeypatch):
    """One stream parses, stores and judges: alerts carry the ids of stored events, state goes on from batch to batch and leaves by event time."""
    import random

    from quarrylight.operators.detect import evaluate

    rng, base = random.Random(5), 1741942800
    made = [(base + 7 * i + rng.randrange(7), f"192.0.2.{rng.randrange(4)}", rng.choice(["login", "fail", "fail", "other"])) for i in range(240)]
    rules = [
        Rule(id="many", severity="high", kind="threshold", where={"type": "fail"}, group_by="src_ip", threshold=3, window=90_000_000), Rule(id="kinds", severity="low", kind="threshold", group_by="src_ip", distinct="type", threshold=3, window=60_000_000),
        Rule(id="then", severity="critical", kind="sequence", where={"type": "fail"}, then={"type": "login"}, group_by="src_ip", threshold=2, window=60_000_000), Rule(id="seen", severity="low", kind="match", where={"type": "other"}, group_by="src_ip", window=120_000_000),
        Rule(id="every", severity="low", kind="match", where={"type": "login"}),
    ]
    rules = [r.validate() for r in rules]
    inbox = tmp_path / "in"
    inbox.mkdir()
    counters, hub = Counters(), Hub(depth=10_000)
    heard = hub.subscribe()
    held = open_store(spark, str(tmp_path / "store"))
    run = lambda: pipeline_stream(stream_lines(spark, str(inbox)), "json", rules, held, str(tmp_path / "cp"), hub=hub, counters=counters, now=NOW, trigger={"availableNow": True}).awaitTermination(120)
    for n in range(3):
        (inbox / f"{n}.log").write_text("".join(f'{{"ts":{t},"ip":"{ip}","type":"{kind}"}}\n' for t, ip, kind in made[80 * n : 80 * n + 80]) + "bad\n")
        run()
    events = held.events()
    key = lambda df: sorted((r.rule_id, r.group_key, str(r.last_seen), r["count"], r.description, tuple(r.event_ids)) for r in df.collect())
    stored = key(held.alerts())
    assert stored == key(evaluate(events, rules)) and len({s[0] for s in stored}) == 5
    assert counters.ingested == 240 == events.select("id").distinct().count() and counters.alerts == len(stored) and counters.queued == 0 and 0 < counters.engine_state <= 16
    assert heard.qsize() == len(stored) + 3
    (inbox / "late.log").write_text(f'{{"ts":{base + 86_400},"ip":"198.51.100.1","type":"fail"}}\n')
    monkeypatch.setattr(live, "SWEEP", 1)
    run()
    assert counters.engine_state == 3  # a day later only the new address is remembered, by the three rules that it concerns
    assert not (tmp_path / "store" / "work").exists()


def test_crashes_and_failed_writes(spark, tmp_path, monkeypatch):
    """A process that dies before or after a commit leaves each event once; batches whose events can't be written are dropped, and the rules remember what they knew before, however many fail in a row."""
    rule = Rule(id="r", severity="high", kind="threshold", group_by="user", threshold=3, window=10**10).validate()
    inbox = tmp_path / "in"
    inbox.mkdir()
    counters = Counters()

    def run(n, user="u", store=None):
        if n:
            (inbox / f"{time.time_ns()}.log").write_text("".join(f'{{"ts":{1741942800 + i},"user":"{user}","type":"t"}}\n' for i in range(n)))
        held = store or open_store(spark, str(tmp_path / "store"))
        pipeline_stream(stream_lines(spark, str(inbox)), "json", [rule], held, str(tmp_path / "cp"), counters=counters, now=NOW, trigger={"availableNow": True}).awaitTermination(120)
        return held

    assert run(2).alerts().count() == 0
    broken = open_store(spark, str(tmp_path / "store"))
    monkeypatch.setattr(broken, "write", lambda *a, **k: (_ for _ in ()).throw(OSError("disk full")))
    for _ in range(3):
        run(5, store=broken)
    assert counters.store_failures == 3
    held = run(1)  # the third hit: the two of the first batch are still known
    assert [r["count"] for r in held.alerts().collect()] == [3] and held.events().count() == 3
    for point in ("before", "after"):
        dying = open_store(spark, str(tmp_path / "store"))
        commit = dying.ledger.commit

        def die(*a, point=point, commit=commit, **k):
            if point == "after":
                commit(*a, **k)
            raise RuntimeError("killed")

        monkeypatch.setattr(dying.ledger, "commit", die)
        with pytest.raises(StreamingQueryException):
            run(4, f"user-{point}", dying)
        held = run(0)  # Spark replays the batch
        mine = held.events().filter(F.col("user") == f"user-{point}")
        assert mine.count() == 4 == mine.select("id").distinct().count()
        assert [(r["count"], len(r.event_ids)) for r in held.alerts().filter(F.col("group_key") == f"user-{point}").collect()] == [(3, 3)]


def test_late_rows_count(spark):
    """A row that comes late is judged by its own time against what is remembered, and never dropped."""
    rule = Rule(id="r", severity="high", kind="threshold", group_by="user", distinct="type", threshold=3, window=60_000_000).validate()
    memory, row = Memory(), lambda s, val: type("Row", (), {"ts": s * 1_000_000, "id": s, "first": True, "then": False, "val": val})
    assert [fold(memory, rule, row(s, v)) for s, v in [(100, "a"), (130, "b"), (110, "b")]] == [None] * 3
    assert fold(memory, rule, row(90, "c")) == (3, 100_000_000, [100, 130, 110, 90]) and not memory.values


def test_distinct_values_in_constant_time():
    """Rows of one group cost the same however many hits the window holds."""
    rule = Rule(id="r", severity="high", kind="threshold", group_by="user", distinct="type", threshold=9_000, window=10**12)
    memory, began = Memory(), time.perf_counter()
    for i in range(60_000):
        fold(memory, rule, type("Row", (), {"ts": i, "id": i, "first": True, "then": False, "val": str(i % 8_000)}))
    assert len(memory.hits) == 10_000 and len(memory.values) == 8_000 and time.perf_counter() - began < 5


def test_sinks():
    hub = Hub(depth=1)
    q = hub.subscribe()
    hub.publish({"a": 1})
    hub.publish({"a": 2})
    assert q.get_nowait() == {"a": 1} and q.empty()
    tries: list[int] = []
    answers = iter([503, 503, 200, 400])
    hook = Webhook("http://x", "high", pauses=(0, 0), post=lambda u, b: tries.append(1) or next(answers))
    assert not hook.notify({"severity": "low"}) and hook.notify({"severity": "high", "rule_name": "n", "description": "d"})
    hook.queue.join()
    assert len(tries) == 3
    hook.notify({"severity": "critical", "rule_name": "n", "description": "d"})
    hook.queue.join()
    assert len(tries) == 4  # an answer below 500 is final
    blocked = Webhook("http://x", depth=1, post=lambda u, b: time.sleep(60) or 200)
    assert [blocked.notify({"severity": "low", "rule_name": "n", "description": "d"}) for _ in range(9)].count(False) >= 7
    assert isinstance(blocked.queue, queue.Queue)


def test_ingest(spark):
    events, report = ingest_lines(spark, ['{"type":"a"}', "bad", "", '{"type":"b"}'], "json", NOW)
    assert events.count() == 2 and {k: v for k, v in report.items() if k != "errors"} == {"accepted": 2, "skipped": 0, "failed": 1}
    assert len(report["errors"]) == 1 and report["errors"][0].startswith("json: ")
    with pytest.raises(ValueError, match="bytes"):
        ingest_lines(spark, ["x" * (1 << 20)] * 11, "json", NOW)
    with pytest.raises(ValueError, match="unknown parser"):
        ingest_lines(spark, ["x"], "csv", NOW)


def test_keyed_state_leaves_by_event_time(spark, tmp_path):
    """A group's state goes once the watermark has passed its window; events ahead of the clock don't hurry it, and late rows are still judged."""
    rule = Rule(id="r", severity="high", kind="threshold", where={"type": "refused"}, group_by="user", threshold=2, window=60_000_000).validate()
    every = Rule(id="e", severity="low", kind="match", where={"type": "refused"}).validate()
    source = str(tmp_path / "events")

    def run(*hits):
        rows = [(i, at if isinstance(at, datetime) else T0 + timedelta(seconds=at), "door", "", kind, "192.0.2.1", user, "m", {}) for i, at, user, kind in hits]
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(source)
        live = live_alerts(spark.readStream.schema(EVENT).parquet(source), [rule, every], lateness="10 seconds")
        query = live.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        found = sorted((r.rule_id, r.group_key, r["count"], r.event_ids) for r in spark.read.parquet(f"{tmp_path}/out/*").filter("rule_id = 'r'").collect())
        return found, query.lastProgress["stateOperators"][0]["numRowsTotal"]

    found, alone = run((1, 0, "a", "refused"))
    assert found == [] and alone > 0
    ahead = datetime.now(timezone.utc) + timedelta(days=400)
    found, _ = run((2, 65, "b", "other"), (3, 1, "c", "refused"))
    assert found == []
    found, held = run((4, 50, "a", "refused"), (5, -5, "c", "refused"))  # within the lateness, and beyond it
    assert found == [("r", "a", 2, [1, 4]), ("r", "c", 2, [3, 5])] and held == 2 == alone  # one row of times for each group that is quiet now; before, one and a hit
    found, held = run((6, 86_400, "b", "other"))
    assert len(found) == 2 and held == 0
    found, held = run((7, 86_401, "d", "refused"), (8, ahead, "b", "other"))
    assert held == 0  # the watermark stands at the clock, long after
    assert spark.read.parquet(f"{tmp_path}/out/*").filter("rule_id = 'e'").count() == 5


@pytest.mark.parametrize("seed", range(2))
def test_judged_in_columns_equals_fold(spark, monkeypatch, seed):
    """Batches with late rows, equal times and a small memory: fires and states are the fold's, and no group costs a call of its own."""
    import random

    from quarrylight.streaming import detection

    monkeypatch.setattr(detection, "MOST_HITS", 6)
    rng = random.Random(seed)
    make = lambda **k: Rule(severity="low", group_by="user", **k).validate()
    rules = [
        make(id="t", kind="threshold", where={"type": "a"}, threshold=3, window=9_000_000), make(id="d", kind="threshold", distinct="type", threshold=3, window=15_000_000),
        make(id="s", kind="sequence", where={"type": {"in": ["a", "b"]}}, then={"type": {"in": ["b", "c"]}}, threshold=2, window=12_000_000), make(id="m", kind="match", where={"type": "c"}, window=20_000_000), Rule(id="e", severity="low", kind="match", where={"type": "b"}).validate(),
    ]
    kinds = {0: ("a",), 1: ("a", "b", "c", "d"), 3: ("c",), 4: ("b",)}
    state, memories, seen = spark.createDataFrame([], detection.STATE), {}, {}
    for n in range(3):
        rows = [(100 * n + i, T0 + timedelta(seconds=25 * n + rng.randrange(-12 if rng.random() < 0.1 else 0, 25)), "x", "", rng.choice("abcd"), "192.0.2.1", f"u{rng.randrange(5)}", "m", {}) for i in range(90)]
        want = []
        for id_, at, *_, kind, _, user, _, _ in sorted(rows, key=lambda r: (r[1], r[0])):
            ts = round(at.timestamp() * 1_000_000)
            for r, rule in enumerate(rules):
                first, then = (kind in "ab", kind in "bc") if r == 2 else (True, False)
                if kind in kinds[r] if r != 2 else first or then:
                    grp = "" if r == 4 else user
                    out = fold(memories.setdefault((r, grp), Memory()), rule, type("Row", (), {"ts": ts, "id": id_, "first": first, "then": then, "val": kind if r == 1 else ""}))
                    seen[r, grp] = max(seen.get((r, grp), 0), ts)
                    if out:
                        want.append((r, grp, ts, id_, *out))
        found = detection.judged(spark.createDataFrame(rows, EVENT), state, rules)
        assert "CoGroup" not in found._jdf.queryExecution().toString()
        found = found.collect()
        assert sorted((*(f[k] for k in ("rule", "grp", "ts", "id", "n", "since")), f["ids"]) for f in (r.fire for r in found) if f) == sorted(want) and len(want) > 20
        held = [r for r in found if not r.fire]
        latest = max(seen.values())
        stay = {k: m for k, m in memories.items() if k[0] != 4 and not (latest - seen[k] > rules[k[0]].window and (m.quiet_until or 0) <= latest)}
        assert {(r.rule, r.grp): (r.ts, r.ids, r.vals, r.quiet_until, r.seen) for r in held} == {k: (*m.columns(), m.quiet_until, seen[k]) for k, m in stay.items()}
        memories = stay
        state = spark.createDataFrame([tuple(r)[:-1] for r in held], detection.STATE)
