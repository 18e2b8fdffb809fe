import time
from datetime import datetime, timedelta, timezone

import pytest

from quarrylight.operators.detect import evaluate
from quarrylight.plans.conditions import compile_condition
from quarrylight.plans.rules import Rule, parse_rules, render, rule_table
from quarrylight.streaming.detection import Memory, fold

T0 = datetime(2025, 3, 14, 9, 30, tzinfo=timezone.utc)
EVENT = "id bigint, timestamp timestamp, source string, host string, type string, src_ip string, user string, message string, fields map<string,string>"


def events(spark, rows):
    """rows: (seconds, src_ip, type, user, fields)."""
    data = [(i, T0 + timedelta(seconds=s), "door", "", kind, ip, user, "m", fields) for i, (s, ip, kind, user, fields) in enumerate(rows, 1)]
    return spark.createDataFrame(data, EVENT)


def fired(spark, rule, rows):
    out = evaluate(events(spark, rows), [rule.validate()]).orderBy("last_seen", "group_key").collect()
    return [(r.group_key, (r.last_seen.replace(tzinfo=timezone.utc) - T0).total_seconds() if r.last_seen.tzinfo is None else (r.last_seen - T0).total_seconds(), r["count"], len(r.event_ids), r) for r in out]


def rule(**kw):
    return Rule(**({"id": "r", "severity": "low", "kind": "threshold", "where": {"type": "refused"}, "group_by": "src_ip", "threshold": 3, "window": 60_000_000} | kw))


@pytest.fixture(autouse=True)
def utc(monkeypatch):
    monkeypatch.setenv("TZ", "UTC")
    time.tzset()


def test_threshold(spark):
    # hits of the quiet minute don't fire, but count once it is over
    swipes = [(s, "192.0.2.1", "refused", "u", {}) for s in (101, 145, 160, 204, 205, 219, 220, 226)] + [(s, "192.0.2.2", "refused", "u", {}) for s in (100, 131, 161, 192)]
    got = fired(spark, rule(description="{count} of {group} in {window}, {threshold} allowed"), sorted(swipes, key=lambda r: r[0]))
    assert [g[:4] for g in got] == [("192.0.2.1", 160, 3, 3), ("192.0.2.1", 220, 4, 4)]
    assert got[0][4].description == "3 of 192.0.2.1 in 1m0s, 3 allowed"
    assert fired(spark, rule(threshold=5), [(7, f"192.0.2.{i % 3}", "refused", "u", {}) for i in range(12)]) == []


def test_distinct(spark):
    badges = [(s, "192.0.2.5", "refused", user, {}) for s, user in [(5, "ines"), (6, "ines"), (7, "ole"), (8, "ines"), (70, "pia"), (71, "ole"), (72, "ines"), (73, "ines")]]
    # at 70 two of the three are out of the window; at 72 all three are in it again
    assert [g[:3] for g in fired(spark, rule(distinct="user"), badges)] == [("192.0.2.5", 72, 3)]


def test_sequence(spark):
    no, yes = "refused", "opened"
    doors = [(s, "192.0.2.1", no) for s in (1, 2)] + [(3, "192.0.2.1", yes)]  # one too few
    doors += [(s, "192.0.2.2", no) for s in (10, 20, 30, 40)] + [(41, "192.0.2.2", yes), (42, "192.0.2.2", yes)]  # the second is in the quiet time
    doors += [(s, "192.0.2.3", no) for s in (0, 5, 9)] + [(66, "192.0.2.3", yes), (4, "192.0.2.4", yes)]  # of three hits one is left
    doors += [(50, "192.0.2.5", no)] * 3 + [(50, "192.0.2.5", yes)]  # at one time, in the order of ids
    got = fired(spark, rule(kind="sequence", then={"type": yes}), [(*r, "u", {}) for r in doors])
    assert [g[:4] for g in got] == [("192.0.2.2", 41, 4, 5), ("192.0.2.5", 50, 3, 4)]


def test_match(spark):
    r = rule(kind="match", where={"zone": {"regex": "^vault-[0-9]$"}}, threshold=0)
    zones = [(0, "a", "vault-1"), (0, "b", "lobby"), (59, "a", "vault-2"), (59, "b", "vault-1"), (60, "a", "vault-1"), (61, "a", "vault-10"), (119, "a", "vault-3"), (120, "a", "vault-3")]
    assert [g[:2] for g in fired(spark, r, [(s, ip, "x", "", {"zone": z}) for s, ip, z in zones])] == [("a", 0), ("b", 59), ("a", 60), ("a", 120)]


@pytest.mark.parametrize("kind,distinct", [("threshold", ""), ("threshold", "user"), ("sequence", ""), ("match", "")])
def test_batch_equals_fold(spark, kind, distinct):
    """The window plan against the row-by-row fold, over random streams with ties and slice borders."""
    import random

    rng = random.Random(7)
    rows = sorted((rng.randrange(0, 9000), f"192.0.2.{rng.randrange(3)}", rng.choice(["refused", "opened", "x"]), rng.choice("abc"), {}) for _ in range(1500))
    r = rule(kind=kind, distinct=distinct, then={"type": "opened"} if kind == "sequence" else {}, threshold=0 if kind == "match" else 3).validate()
    memory, want = {}, []
    for i, (s, ip, t, user, _) in enumerate(rows, 1):
        row = type("Row", (), {"ts": s * 1_000_000, "id": i, "first": t == "refused", "then": t == "opened", "val": user if distinct else ""})
        if row.first or (kind == "sequence" and row.then):
            out = fold(memory.setdefault(ip, Memory()), r, row)
            if out:
                want.append((ip, s, out[0], out[2]))
    got = [(g[0], g[1], g[2], g[4].event_ids) for g in fired(spark, r, rows)]
    assert sorted(got) == sorted(want) and len(want) > 10


def test_matchers(spark):
    cond = {"status": {"gte": 500, "lte": 599}, "method": {"not_in": ["GET"]}, "agent": {"exists": False}, "message": {"contains": "m", "prefix": "m"}}
    fields = [{"status": "503", "method": "POST"}, {"status": "404", "method": "POST"}, {"status": "600"}, {"status": "x"}, {"status": "503", "method": "GET"}, {"status": "503", "agent": ""}, {"method": "POST"}]
    got = events(spark, [(0, "", "t", "", f) for f in fields]).select(compile_condition(cond)).collect()
    assert [r[0] for r in got] == [True] + [False] * 6
    nothing = events(spark, [(0, "", "t", "", {})])
    assert nothing.select(compile_condition({"a": {"not": "x"}}), compile_condition({"a": {"in": []}}), compile_condition({}), compile_condition({"a": ""})).first()[:] == (True, False, True, True)
    nan = events(spark, [(0, "", "t", "", {"a": "NaN"})])
    assert nan.select(compile_condition({"a": {"gte": 5}})).first()[0]


@pytest.mark.parametrize(
    "text",
    [
        "{severity: low, type: match}", "{id: a, severity: bad, type: match}", "{id: a, severity: low, type: odd}", "{id: a, severity: low, type: threshold, threshold: 1, window: 1m}",
        "{id: a, severity: low, type: threshold, group_by: user, window: 1m}", "{id: a, severity: low, type: threshold, group_by: user, threshold: 1}", "{id: a, severity: low, type: sequence, group_by: user, threshold: 1, window: 1m}",
        "{id: a, severity: low, type: match, then: {type: x}}", "{id: a, severity: low, type: match, distinct: user}", "{id: a, severity: low, type: match, where: {type: {regex: '('}}}", "{id: a, severity: low, type: match, window: xx}", "{id: a, severity: low, type: match, bogus: 1}",
    ],
)
def test_wrong_rules(spark, text):
    with pytest.raises(ValueError):
        parse_rules(f"rules:\n  - {text}\n")


def test_rules_file(spark):
    rules = parse_rules("rules:\n  - {id: off, severity: low, type: match, disabled: true, where: {type: {in: [a, b]}, user: {exists: true}}}\n")
    assert rules[0].id == "off" and rules[0].name == "off" and rules[0].disabled
    assert render(rules[0].where) == "type in a, b and user exists"
    assert rule_table(spark, rules).count() == 1
    assert evaluate(events(spark, []), rules).count() == 0
    with pytest.raises(ValueError, match="duplicate"):
        parse_rules("rules:\n  - {id: a, severity: low, type: match}\n  - {id: a, severity: low, type: match}\n")


def test_descriptions(spark):
    r = rule(kind="match", threshold=0, description="{group}: {event.path}/{event.none}", where={}, group_by="user")
    (got,) = fired(spark, r, [(0, "192.0.2.1", "x", "", {"path": "{count}"})])
    assert got[4].description == "{count}/"


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("kind,distinct", [("threshold", ""), ("threshold", "user"), ("sequence", ""), ("match", "")])
def test_slices_equal_fold(spark, monkeypatch, kind, distinct, seed):
    """Large groups in many slices, some shorter than a window, with a memory that is smaller than a window's hits."""
    import random

    from quarrylight.operators import detect
    from quarrylight.streaming import detection

    monkeypatch.setattr(detect, "SLICE_ROWS", 60)
    monkeypatch.setattr(detect, "MOST_HITS", 25)
    monkeypatch.setattr(detection, "MOST_HITS", 25)
    rng = random.Random(seed)
    rows = sorted((rng.randrange(0, 3000), f"192.0.2.{min(rng.randrange(9), 3)}", rng.choice(["refused", "opened", "x"]), rng.choice("abcdefgh"), {}) for _ in range(2500))
    window = rng.choice((20, 90, 400)) * 1_000_000
    r = rule(kind=kind, distinct=distinct, window=window, then={"type": "opened"} if kind == "sequence" else {}, threshold={"match": 0, "sequence": 6}.get(kind, 7)).validate()
    memory, want = {}, []
    for i, (s, ip, t, user, _) in enumerate(rows, 1):
        row = type("Row", (), {"ts": s * 1_000_000, "id": i, "first": t == "refused", "then": t == "opened", "val": user if distinct else ""})
        if row.first or (kind == "sequence" and row.then):
            out = fold(memory.setdefault(ip, Memory()), r, row)
            if out:
                want.append((ip, s, out[0], out[2]))
    got = [(g[0], g[1], g[2], g[4].event_ids) for g in fired(spark, r, rows)]
    assert sorted(got) == sorted(want) and len(want) > 2
    cuts = detect._cuts(detect._hits(events(spark, rows), [r]), [r])
    assert cuts.count() == 4 and cuts.selectExpr("max(size(cuts))").first()[0] >= 5


def test_times_too_far_apart(spark):
    """Groups whose times don't fit one number together."""
    far = [(i, T0 + timedelta(days=300 * i), "door", "", "refused", f"192.0.2.{i % 2}", "u", "m", {}) for i in range(0, 7000, 7) if i < 6000]
    near = [(10_000 + i, T0 + timedelta(seconds=i), "door", "", "refused", "192.0.2.9", "u", "m", {}) for i in range(3)]
    rules = [rule().validate(), rule(id="long", window=10**17).validate()]
    got = sorted((r.rule_id, r.group_key, r["count"]) for r in evaluate(spark.createDataFrame(far + near, EVENT), rules).collect())
    # a window of 10**17 microseconds holds 276 of the times, which are 4,200 days apart in a group
    assert got == [("long", "192.0.2.0", 3), ("long", "192.0.2.0", 276), ("long", "192.0.2.1", 3), ("long", "192.0.2.1", 276), ("long", "192.0.2.9", 3), ("r", "192.0.2.9", 3)]


def test_hot_group(spark):
    """A million events of one group in one window spread over tasks, without a loop over rows."""
    from quarrylight.operators import detect

    hot = spark.range(1_000_000).selectExpr("id", "timestamp_micros(id * 50) AS timestamp", "'x' AS source", "'' AS host", "CASE WHEN id % 1000 = 999 THEN 'opened' ELSE 'refused' END AS type", "'192.0.2.77' AS src_ip", "'u' AS user", "'' AS message", "cast(map() AS map<string,string>) AS fields")
    rules = [rule(id="t", threshold=9_000), rule(id="s", kind="sequence", then={"type": "opened"}, threshold=9_000), rule(id="m", kind="match", threshold=0, group_by="")]
    rules = [r.validate() for r in rules]
    began = time.perf_counter()
    got = {r.rule_id: r for r in evaluate(hot, rules).collect()}
    assert set(got) == {"t", "s", "m"} and got["t"]["count"] == 9_000 and got["s"]["count"] == 9_990 and got["m"].event_ids == [0]
    assert len(got["t"].event_ids) == 50 and got["t"].event_ids[-1] == 9_008 and len(got["s"].event_ids) == 51 and got["s"].event_ids[-1] == 9_999
    assert time.perf_counter() - began < 120
    hits = detect._hits(hot, rules)
    sizes = [r["count"] for r in detect._sliced(hits, detect._cuts(hits, rules), rules).groupBy("rule", "grp", "slice").count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 1.4 * detect.SLICE_ROWS and sum(sizes) < 1.3 * hits.count()


def test_slices_are_searched(spark, monkeypatch):
    """A row costs the same however many slices its group has: no row carries its group's cuts or tests each of them. With a window longer than all slices only the first candidate fires."""
    from quarrylight.operators import detect

    monkeypatch.setattr(detect, "SLICE_ROWS", 50)
    monkeypatch.setattr(detect, "MOST_HITS", 20)
    r = [rule(threshold=20, window=10**15).validate(), rule(id="never", threshold=21, window=10**15).validate()]
    e = events(spark, [(i // 3, "192.0.2.1", "refused", "", {}) for i in range(3000)])
    hits = detect._hits(e, r)
    cuts = detect._cuts(hits, r)
    assert cuts.selectExpr("min(size(cuts))").first()[0] > 40
    sliced = detect._sliced(hits, cuts, r)
    assert "lambda" not in sliced._jdf.queryExecution().optimizedPlan().toString()
    assert [(a.rule_id, a["count"], a.event_ids) for a in detect.evaluate(e, r).collect()] == [(r[0].id, 20, list(range(1, 21)))]


@pytest.mark.parametrize("window", [40, 700, 10**9])
@pytest.mark.parametrize("kind", ["threshold", "match"])
def test_quiet_slices_are_left_out(spark, monkeypatch, kind, window):
    """Slices within a window of a fire that is sure are neither dealt nor read, but remembered where a later slice needs their hits."""
    import random

    from quarrylight.operators import detect

    rng = random.Random(window)
    rows = sorted((rng.randrange(0, 3000), f"192.0.2.{i % 2}", "refused", "", {}) for i in range(4000))
    r = rule(kind=kind, threshold=12 if kind == "threshold" else 0, window=window * 1_000_000).validate()
    whole = [(g[0], g[1], g[2], g[4].event_ids) for g in fired(spark, r, rows)]
    monkeypatch.setattr(detect, "SLICE_ROWS", 60)
    assert [(g[0], g[1], g[2], g[4].event_ids) for g in fired(spark, r, rows)] == whole and len(whole) >= 2
    hits = detect._hits(events(spark, rows), [r])
    cuts = detect._cuts(hits, [r])
    dealt = detect._sliced(hits, cuts, [r], detect._quiet(hits, cuts, [r]))
    slices = dealt.groupBy("grp", "slice").count().count()
    if window == 10**9:
        assert slices == 2
    if window > 40:
        assert slices < detect._sliced(hits, cuts, [r]).groupBy("grp", "slice").count().count()


def test_rules_that_never_fire_give_no_hits(spark, monkeypatch):
    from quarrylight.operators import detect

    asked, hits = [], detect._hits
    monkeypatch.setattr(detect, "_hits", lambda e, rules: asked.extend(r.id for r in rules) or hits(e, rules))
    rules = [rule(id="fires", threshold=detect.MOST_HITS).validate(), rule(id="never", threshold=detect.MOST_HITS + 1).validate(), rule(id="match", kind="match", threshold=0).validate()]
    got = evaluate(events(spark, [(1, "192.0.2.1", "refused", "", {})]), rules).collect()
    assert asked == ["fires", "match"] and [a.rule_id for a in got] == ["match"]
