"""The registered queries against their SQL, their contracts, and the pipeline's stages against brute force."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrylight.llm import queries

from .test_operators import SCHEMA, brute_components, brute_leaks, brute_removal

CONTRACTS = {
    "op1_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op2_decontamination": ["doc_id", "contaminated", "item_ids"],
    "op3_sentencepiece": ["doc_id", "n_pieces", "best_score", "nbest_scores", "ids_sha256", "round_trip"],
    "op4_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op5_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op6_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_importance_resampling": ["doc_id", "log_weight", "selected"],
    "op8_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op9_kd_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op10_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op13_order_minhash": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
}
#: Operators whose rows aren't documents.
OTHER_ROWS = {
    "op11_prefix_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op12_spelling_variants": ["word", "form", "root", "n", "n_near", "form_n"],
}


@pytest.mark.parametrize("name", list(OTHER_ROWS))
def test_other_rows(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert list(got.columns) == OTHER_ROWS[name] and len(got) > 10
    db = duckdb.connect()
    for table in ("documents", "conversations"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = db.sql(queries.ORACLE_SQL[name]).df()
    plain = lambda f: sorted(tuple("" if pd.isna(x) else str(int(x)) if isinstance(x, float) else str(x) for x in row) for row in f[OTHER_ROWS[name]].itertuples(index=False))
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", list(CONTRACTS))
def test_contract(spark, sf_dir, name):
    """A row for each document with the promised columns; the rows of the SQL where there is one."""
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert set(CONTRACTS[name]) <= set(got.columns) and len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    if name in queries.ORACLE_SQL:
        db = duckdb.connect()
        for table in ("documents", "benchmark"):
            db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
        want = db.sql(queries.ORACLE_SQL[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = lambda f: sorted(map(tuple, f[columns].astype(str).values.tolist()))
        assert rows(got) == rows(want)


def test_held_out_quality(spark):
    """Accuracy on the folds that training never saw."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    found = queries.QUERIES["op6_language_id"](spark, sf_dir).filter("held_out").join(docs, "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # the network needs some hundreds of toxic rows, which the tenth scale has (this scale has 44)
    large = "/root/testdata/sf0.1"
    found = queries.QUERIES["op10_toxicity"](spark, large).filter("held_out")
    tox = found.join(spark.read.parquet(f"{large}/labels.parquet").filter("toxic is not null"), "doc_id").toPandas()
    assert (tox[tox.toxic == 1].predicted == 1).mean() >= 0.9 and (tox[tox.toxic == 0].predicted == 0).mean() > 0.98
    quality = queries.QUERIES["op7_importance_resampling"](spark, sf_dir).join(labels, "doc_id").toPandas()
    assert quality[quality.quality == 1].selected.mean() > 0.95 and quality[quality.quality == 0].selected.mean() < 0.5


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Documents in two made-up languages with odd rows, and a benchmark."""
    rng = random.Random(11)
    tongues = {"xx": ["ka", "to", "mi", "ro", "ne"], "yy": ["sch", "ung", "ein", "ver", "lich"]}
    word = lambda lang: "".join(rng.choice(tongues[lang]) for _ in range(rng.randint(1, 4)))
    say = lambda lang, n: " ".join(word(lang) for _ in range(n))
    texts = [(say(lang, rng.randint(30, 120)), lang) for lang in ["xx", "yy"] * 30]
    leak, passage = say("xx", 20), say("yy", 60)
    texts += [(texts[0][0], "xx"), (texts[1][0] + " ka", "yy"), (say("xx", 40) + " " + leak + " " + say("xx", 9), "xx"), *[(say("yy", 70) + " " + passage + " " + say("yy", 70), "yy") for _ in range(3)], (None, "xx"), ("", None), ("123 + 4", "xx")]
    rows = [(i, t, lang, None, 0, 0.5, "r", "p") for i, (t, lang) in enumerate(texts)]
    rows += [rows[4], (None, say("xx", 50), None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sf = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, leak), (1, None)], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, rows, leak


def test_stages(spark, made):
    sf, rows, leak = made
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    by = lambda df: sorted((r.doc_id if r.doc_id is not None else 10**6, r.text or "") for r in df.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, columns = by(docs), docs.columns
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs = corpus_pipeline.written(docs, "test")
        after = by(docs)
        if name == "language":  # what has no letters goes, the rest is sure
            assert after == [x for x in before if any(c.isalpha() for c in x[1])]
        elif name == "near_duplicates":
            ids, texts = zip(*sorted(set(before)), strict=True)
            _, root = brute_components(texts, 5, 80, 100)
            keep = sorted((ids[i], texts[i]) for i, r in enumerate(root) if i == r)
            assert after == keep and len(keep) < len(before) - 2
        elif name == "repeated_passages":
            want = brute_removal([t for _, t in before], 200)
            assert after == sorted((i, w[4].decode("utf-8", "ignore")) for (i, _), w in zip(before, want, strict=True)) and after != before
            assert docs.filter("n_chars <> length(text)").count() == 0
        else:
            leaks = brute_leaks([t for _, t in before], [(0, leak)])
            assert after == [x for x, found in zip(before, leaks, strict=True) if not found] and len(after) == len(before) - 1
    out = corpus_pipeline.run(spark, sf).collect()
    assert len(out) == len(after) and all(r.round_trip for r in out)


def test_near_duplicates_without_telling_ids(spark):
    """Near copies that all have a null doc_id, or share the smallest: one of each group stays."""
    rng = random.Random(12)
    groups = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(5)]
    ids = [(None, None, None), (None, None, None), (7, 7, 8), (None, 3, 3), (4, 4, None)]
    rows = [(i, f"{g} {end}") for g, own in zip(groups, ids, strict=True) for i, end in zip(own, ("", "x", "y"), strict=True)]
    rows += [rows[0], rows[6], (None, "a text of its own"), (7, "another text of its own")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    kept = [[x for x in got if x[1].startswith(g)] for g in groups]
    assert [[i for i, _ in k] for k in kept] == [[None], [None], [7], [3], [4]] and set(got) <= set(rows)
    assert len(got) == 7 and set(rows[-2:]) <= set(got)


def test_any_column_names(spark, made):
    """Columns named like an operator's own, and `text` in other case, neither clash nor change."""
    sf, _, _ = made
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    names = ["t", "__t", "__tid", "__kept", "id", "tid", "kept_text", "row", "rows", "node", "g", "item_ids", "score", "a.b"]
    wide = docs.withColumnRenamed("text", "Text").withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in names})
    for stage in (corpus_pipeline.language, corpus_pipeline.near_duplicates, corpus_pipeline.repeated_passages, corpus_pipeline.decontamination):
        want = sorted(map(str, stage(spark, docs, sf).collect()))
        got = stage(spark, wide, sf)
        assert got.columns == wide.columns
        rows = got.collect()
        assert all(r[n] == f"{n}{'-' if r.doc_id is None else r.doc_id}" for r in rows for n in names)
        assert sorted(map(str, got.select("doc_id", F.col("Text").alias("text"), "lang").collect())) == want


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_are_the_ordered_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "decontamination", "pieces"]
