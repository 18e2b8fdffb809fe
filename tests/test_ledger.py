from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import ledger
from quarrylight.operators.ledger import Ledger, Part, Store

DAY = datetime(2025, 6, 1, tzinfo=timezone.utc)


def rows(spark, ids, hours, **columns):
    """Events with these ids, `hours` after DAY each."""
    made = spark.createDataFrame([(i, DAY + timedelta(hours=h)) for i, h in zip(ids, hours, strict=True)], "id bigint, timestamp timestamp")
    return made.withColumns({c: F.lit(columns.get(c, "x")) for c in ("source", "host", "type", "src_ip", "user", "message")}).withColumn("fields", F.create_map(F.lit("k"), F.col("id").cast("string")))


def files(path, suffix=".parquet"):
    return sorted(str(p) for p in path.rglob(f"*{suffix}"))


def test_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "SUMMARY", 3)
    one, other = Ledger(spark, str(tmp_path / "l")), Ledger(spark, str(tmp_path / "l"))
    assert one.read() == (0, [], {})
    for n in range(7):
        one.commit([Part("t", f"f{n}", n)], [f"f{n - 2}"] if n > 1 else [], {"batch": n})
    assert [p.path for p in one.read()[1]] == ["f5", "f6"] and other.read()[::2] == (7, {"batch": 6})
    assert sorted(p.name for p in (tmp_path / "l").glob("*.all.json")) == ["000000000003.all.json", "000000000006.all.json"]
    (tmp_path / "l" / ".000000000008.json.writing").write_text("{")  # what a dead writer leaves isn't read
    assert Ledger(spark, str(tmp_path / "l")).read()[1] == one.read()[1]


def test_readers_see_whole_commits(spark, tmp_path):
    held = Store(spark, str(tmp_path))
    assert held.events().count() == 0 and held.last_batch() == -1
    held.write(rows(spark, [1, 2], [0, 1]), "events", "batch-0", "timestamp")  # written, not committed
    assert held.events().count() == 0
    held.commit_batch(0, events=rows(spark, [3], [2]))  # over it
    assert [(r.id, r.fields["k"]) for r in Store(spark, str(tmp_path)).events().collect()] == [(3, "3")] and held.last_batch() == 0


def test_zones(spark, tmp_path):
    held = Store(spark, str(tmp_path))
    for n in range(6):
        held.commit_batch(n, events=rows(spark, range(10 * n, 10 * n + 10), [24 * n + i for i in range(10)]).coalesce(1))
    assert len(held.parts("events")) == 6 and len(held.parts("events", ids=(9, 10))) == 2 and len(held.parts("events", ids=(100, 200))) == 0
    opened = []
    table = held.table
    held.table = lambda name, parts=None: opened.append(len(parts)) or table(name, parts)
    assert [r.id for r in held.get_events([55, 3, 3, 77]).collect()] == [3, 55] and opened == [2]
    assert [r.id for r in held.page(12).collect()] == list(range(59, 47, -1)) and opened[1:] == [2]
    assert [r.id for r in held.page(3, before_id=21).collect()] == [20, 19, 18] and opened[2:] == [1, 2]
    opened.clear()
    assert [r.id for r in held.page(3, where=F.col("id") % 20 == 0).collect()] == [40, 20, 0] and opened[0] == 1 and opened[-1] == 6
    assert held.page(5, where=F.col("id") > 1000).count() == 0
    assert [r.id for r in held.events(DAY + timedelta(hours=26), DAY + timedelta(hours=28)).orderBy("id").collect()] == [12, 13] and opened[-1] == 1


def test_retention(spark, tmp_path):
    held = Store(spark, str(tmp_path))
    for n in range(4):
        held.commit_batch(n, events=rows(spark, range(10 * n, 10 * n + 10), [24 * n + i for i in range(10)]).coalesce(1))
    before = files(tmp_path / "events")
    now = DAY + timedelta(days=8, hours=4)
    assert held.expire(now, timedelta(days=6)) == {"removed": 2, "rewritten": 1, "rows": 24}
    assert sorted(r.id for r in held.events().collect()) == list(range(24, 40))
    after = files(tmp_path / "events")
    assert len(set(before) & set(after)) == 1 and len(after) == 2  # the files are gone
    assert held.expire(now, timedelta(days=6)) == {"removed": 0, "rewritten": 0, "rows": 0}
    assert sum(p.rows for p in held.parts("events")) == 16


def test_compaction(spark, tmp_path):
    held = Store(spark, str(tmp_path))
    for n in range(6):
        held.commit_batch(n, events=rows(spark, range(5 * n, 5 * n + 5), [12 * n] * 5))
    many = len(held.parts("events"))
    assert held.compact(1000) == many and len(held.parts("events")) == 3 == len(files(tmp_path / "events"))
    assert sorted(r.id for r in held.events().collect()) == list(range(30)) and held.compact(1000) == 0


def test_states_by_bucket(spark, tmp_path):
    held = Store(spark, str(tmp_path), "bucket int, rule int, grp string")
    state = lambda *r: spark.createDataFrame(list(r), "bucket int, rule int, grp string")
    held.commit_batch(0, state=state((1, 0, "a"), (2, 0, "b"), (2, 1, "c")))
    held.commit_batch(1, state=state((2, 0, "d")), buckets=[2, 7])
    assert sorted(map(tuple, held.state().collect())) == [(1, 0, "a"), (2, 0, "d")] and held.state([7]).count() == 0 and held.state([2]).count() == 1
    assert len(files(tmp_path / "state")) == 2


def test_one_writer(spark, tmp_path):
    log = Ledger(spark, str(tmp_path))
    log.commit(notes={"batch": 0})
    with pytest.raises(TypeError):
        log.commit(notes={"batch": {1}})
    assert log.commit(notes={"batch": 1}) == 2
