import importlib
import sys

import pytest

import __spark_entry__ as entry
from quarrylight.plans import queries as engine


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(engine.QUERIES) <= set(entry.queries()) and set(engine.QUERIES) == set(engine.ORACLE_SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(engine.QUERIES))
def test_against_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    got = engine.QUERIES[name](spark, sf_dir).toPandas()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    want = db.sql(engine.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda f: sorted(map(tuple, f[columns].astype(str).values.tolist()))
    assert rows(got) == rows(want)


def test_without_training_data_parts(monkeypatch):
    """The entry module works where the training-data parts are missing."""
    for name in [m for m in sys.modules if m.startswith("quarrylight.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "quarrylight.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import quarrylight

    monkeypatch.delattr(quarrylight, "llm", raising=False)
    alone = importlib.reload(entry)
    assert set(alone.queries()) == set(engine.QUERIES)
    monkeypatch.undo()
    importlib.reload(entry)
