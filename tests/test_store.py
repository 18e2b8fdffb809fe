from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quarrylight.functions.fields import ALERT
from quarrylight.operators import intel, stats, store
from quarrylight.sources.feeds import Feed, FeedSet, parse_entry, parse_feed, validate_feeds

from .test_rules import EVENT

T0 = datetime(2025, 3, 14, 9, 30, tzinfo=timezone.utc)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def events(spark):
    """Six events of a mail gateway and a proxy, ten minutes apart; ids grow with the times."""
    rows = [
        (11, at(0), "mail", "gw1", "delivery", "198.51.100.20", "amara", "queued 50% of _list_ mails", {"size": "900"}), (12, at(10), "mail", "gw1", "bounce", "198.51.100.20", "amara", "Mailbox FULL at Zoë", {}), (13, at(20), "proxy", "", "fetch", "192.0.2.7", "", "CONNECT a.example:443", {}),
        (14, at(30), "proxy", "", "fetch", "192.0.2.8", "bo", "connect b.example:443", {"bytes": "7"}), (15, at(40), "mail", "gw2", "bounce", "192.0.2.7", "bo", "mailbox full at zoE", {}), (16, at(50), "proxy", "", "denied", "", "", "no rule for c.example", {}),
    ]
    return spark.createDataFrame(rows, EVENT)


@pytest.fixture(scope="module")
def alerts(spark):
    rows = [(1, "bounces", "Bounces", "medium", "amara", 2, "d", at(0), at(10), [11, 12, 500], "open", at(11)), (2, "denied", "Denied", "critical", "", 1, "d", at(50), at(50), [16], "open", at(51)), (3, "bounces", "Bounces", "medium", "bo", 1, "d", at(40), at(40), [15], "closed", at(41))]
    return spark.createDataFrame(rows, ALERT)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_lists(events):
    assert ids(store.list_events(events)) == [16, 15, 14, 13, 12, 11]
    assert ids(store.list_events(events, source="proxy", limit=2)) == [16, 14] and ids(store.list_events(events, src_ip="192.0.2.7", type="bounce")) == [15]
    assert ids(store.list_events(events, query="CONNECT ")) == [14, 13] and ids(store.list_events(events, query="mailbox full")) == [15, 12]
    # neither sign stands for other characters, and only ASCII letters ignore case
    assert ids(store.list_events(events, query="50%")) == [11] and ids(store.list_events(events, query="5%m")) == [] and ids(store.list_events(events, query="_LIST_")) == [11] and ids(store.list_events(events, query="c_example")) == []
    assert ids(store.list_events(events, query="zoë")) == [12] and ids(store.list_events(events, query="ZOË")) == []
    assert ids(store.list_events(events, since=at(10), until=at(30))) == [13, 12]
    assert ids(store.list_events(events, before_id=14, user="amara")) == [12, 11]
    assert ids(store.get_events(events, [15, 11, 99, 15])) == [11, 15]
    assert [store.page_size(n) for n in (0, -7, 1, 1000, 1001)] == [100, 100, 1, 1000, 1000]


def test_alerts(spark, events, alerts, tmp_path):
    assert ids(store.list_alerts(alerts, rule_id="bounces")) == [3, 1] and ids(store.list_alerts(alerts, severity="medium", status="open", group_key="amara")) == [1] and ids(store.list_alerts(alerts, before_id=3, limit=1)) == [2]
    assert sorted((r.alert_id, r.id) for r in store.alert_events(alerts, events).collect()) == [(1, 11), (1, 12), (2, 16), (3, 15)]
    assert store.get_alert(alerts, 3).status == "closed"
    with pytest.raises(store.NotFound):
        store.get_alert(alerts, 4)
    log = str(tmp_path / "log")
    for seq, (alert, status) in enumerate([(2, "closed"), (3, "open"), (2, "acknowledged")]):
        store.set_status(alerts, log, alert, status, seq)
    for wrong, error in (((1, "done"), ValueError), ((44, "open"), store.NotFound)):
        with pytest.raises(error):
            store.set_status(alerts, log, *wrong, 9)
    assert sorted((r.id, r.status) for r in store.with_status(alerts, spark.read.parquet(log)).collect()) == [(1, "open"), (2, "acknowledged"), (3, "open")]
    assert store.as_alerts(alerts.drop("created_at").withColumn("status", F.lit(None)), T0).filter("created_at is not null and status = 'open'").count() == 3


def test_numbers(spark, events, tmp_path):
    for folder in (None, str(tmp_path / "numbered")):
        numbered = store.with_ids(events.withColumn("old", F.col("id")), after=1000, folder=folder)
        assert sorted((r.old, r.id) for r in numbered.collect()) == [(i, 990 + i) for i in range(11, 17)]
    assert ids(store.kept_events(events, at(45), timedelta(minutes=15)).orderBy("id")) == [14, 15, 16]


def test_stats(events, alerts):
    assert stats.totals(events, at(20)).first()[:] == (6, 4)
    assert {r.type: r.n for r in stats.events_by_type(events, at(10)).collect()} == {"bounce": 2, "fetch": 2, "denied": 1}
    assert [(r.src_ip, r.n) for r in stats.top_sources(events, T0).collect()] == [("192.0.2.7", 2), ("198.51.100.20", 2), ("192.0.2.8", 1)]
    assert [(r.group_key, r.n) for r in stats.top_alerted(alerts, at(30)).collect()] == [("bo", 1)]
    assert {r.severity: r.n for r in stats.open_by_severity(alerts).collect()} == {"medium": 1, "critical": 1} and {r.status: r.n for r in stats.alerts_by_status(alerts).collect()} == {"open": 2, "closed": 1}
    assert stats.open_and_high(alerts).first()[:] == (2, 1)
    grouped = alerts.withColumn("group_key", F.lit("192.0.2.7"))
    assert {(r.src_ip, r.alerts) for r in stats.flagged_sources(events, grouped, T0).collect()} == {("192.0.2.7", 3), ("198.51.100.20", 0), ("192.0.2.8", 0)}
    line = stats.timeline(events, alerts, at(7), at(52), timedelta(minutes=15)).orderBy("start").collect()
    assert [(r.start.minute, r.events, r.alerts) for r in line] == [(30, 2, 1), (45, 1, 0), (0, 2, 1), (15, 1, 1)]
    with pytest.raises(ValueError):
        stats.timeline(events, alerts, T0, T0 + timedelta(days=2))
    assert stats.range_preset() == (timedelta(hours=1), timedelta(minutes=1))
    with pytest.raises(ValueError):
        stats.range_preset("2h")


FEEDS = {"local": ["# list", "203.0.113.0/25", "192.0.2.66 ; one", "192.0.2.64/31", "::ffff:192.0.2.66", "2001:db8:bad::/48", "junk", ""], "drop": ["198.51.100.0/24 # SBL", "::ffff:203.0.113.0/120"]}


def test_lookup(spark):
    prefixes = None
    for i, (name, lines) in enumerate(FEEDS.items()):
        t = parse_feed(spark.createDataFrame([(x,) for x in lines], "line string"), i, name)
        prefixes = t if prefixes is None else prefixes.unionByName(t)
    assert prefixes.count() == 6
    asked = ["203.0.113.5", "203.0.113.200", "198.51.100.1", "192.0.2.66", "192.0.2.77", "2001:db8:bad:1::1", "2001:db8:900d::1", "::ffff:203.0.113.10", "10.1.2.3", "not-an-ip", ""]
    found = {r.ip: r.lists for r in intel.lookup(spark.createDataFrame([(x,) for x in asked], "ip string"), prefixes).collect()}
    assert found == {"203.0.113.5": "local", "198.51.100.1": "drop", "192.0.2.66": "local", "2001:db8:bad:1::1": "local", "::ffff:203.0.113.10": "local"}
    events = spark.createDataFrame([(i, T0, "ssh", "", "t", x, "", "", {"ti_lists": "old"}) for i, x in enumerate(asked)], EVENT)
    rows = {r.src_ip: r.fields["ti_lists"] for r in intel.enrich(events, prefixes).collect()}
    assert len(rows) == len(asked) and rows["192.0.2.66"] == "local" and rows["10.1.2.3"] == "old"
    assert parse_entry("10.0.0.1") == (4, 32, f"{10 << 24 | 1:032b}") and parse_entry("x/8") is None


def test_feed_set(spark, tmp_path):
    good = tmp_path / "good.txt"
    good.write_text("198.51.100.0/25\n198.51.100.129\n")
    folder = tmp_path / "tables"
    feeds = FeedSet(spark, [Feed("good", str(good)), Feed("gone", str(tmp_path / "none.txt"))], timedelta(hours=1), str(folder))
    assert feeds.refresh_if_due(T0) and not feeds.refresh_if_due(at(59))
    good.write_text("nothing here\n")
    assert feeds.refresh_if_due(at(60)) and feeds.errors["good"].endswith("no valid entries")
    rows = {r.feed: (r.entries, r.loaded_at is not None, bool(r.error)) for r in feeds.status().collect()}
    assert rows == {"good": (2, True, True), "gone": (0, False, True)}
    good.write_text("203.0.113.9\n")
    feeds.refresh(at(61))
    assert feeds.prefixes().count() == 1 and len(list(folder.iterdir())) == 1  # older versions are gone
    feeds.close()
    assert not list(folder.iterdir())
    for wrong in ([Feed("", "x")], [Feed("a b", "x")], [Feed("a")], [Feed("a", "x", "y")], [Feed("a", "x"), Feed("a", "y")]):
        with pytest.raises(ValueError):
            validate_feeds(wrong)


def test_rule_search(spark):
    from quarrylight.plans.rules import parse_rules, rule_table

    table = rule_table(spark, parse_rules("rules:\n  - {id: b, name: Beta, severity: low, type: match, tags: [SSH]}\n  - {id: a, name: Alpha ssh, severity: high, type: match}\n  - {id: c, severity: high, type: match}\n"))
    assert [r.id for r in stats.search_rules(table, "ssh", "builtin").collect()] == ["a", "b"]
    assert stats.rule_counts(table).first()[:] == (3, 3, 0)
