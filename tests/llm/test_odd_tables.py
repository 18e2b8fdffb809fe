"""Every operator on tables with repeated rows, clashing column names and texts longer than what numpy takes at a time."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quarrylight.llm import bpe_counts, decontaminate, jaccard_join, lang_id, piece_lattice, quality_rules, resample, sharding, suffix_dedup, toxicity
from quarrylight.llm.common import CHUNK_BYTES

from .test_operators import MODEL, brute_base, brute_leaks, brute_removal

NAMES = ["t", "tid", "rep", "node", "g", "part", "h", "near", "place", "words", "item_ids", "key", "toxic", "usable", "slot", "shard", "cell", "weight", "k0", "d1", "at", "c1", "spans", "copies", "rows", "row", "score", "__t", "Doc"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(21)
    voc = [f"{a}{b}" for a in ("ka", "to", "mi", "Ro", "ung") for b in ("n", "st", "la", "9", "é")]
    say = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    shared, leak = say(90), " ".join(f"leak{i}" for i in range(20))
    long = say(250_000) + " " + shared + "\n" + leak + " end"
    out = [say(rng.randint(20, 90)) for _ in range(30)] + [None, "", shared + " x", long, "z" * 1_200_000, say(60) + " " + leak]
    assert len(long) > CHUNK_BYTES
    return [*out, out[0], out[33]], [*range(36), 0, 33], leak


@pytest.fixture(scope="module")
def models(spark, texts):
    docs = spark.createDataFrame([(i, t, "xy"[n % 2]) for n, (i, t) in enumerate(zip(texts[1][:30], texts[0][:30], strict=True))], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(30)], "doc_id bigint, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    return lang_id.fit(docs, F.lit(True)), toxicity.fit(docs, labels, F.lit(True)), labels


def operators(models, bench):
    languages, network, labels = models
    return {
        "rules": quality_rules.apply_rules,
        "leaks": lambda d: decontaminate.find_leaks(d, bench),
        "leaks_joined": lambda d: decontaminate.find_leaks(d, bench, block_bytes=1),
        "pieces": lambda d: piece_lattice.encode(d, MODEL, with_ids=False),
        "removal": suffix_dedup.removal_digest,
        "removal_refined": lambda d: suffix_dedup.removal_digest(d, hot_contexts=1),
        "jaccard": lambda d: jaccard_join.jaccard_components(d, 4, 85, 100).drop("t", "component_t"),
        "language": lambda d: lang_id.predict(d, languages),
        "drawn": lambda d: resample.resample(d, labels, share=0.5),
        "tokens": lambda d: bpe_counts.token_counts(d, MODEL),
        "shards": lambda d: sharding.kd_shards(d, shards=4),
        "toxicity": lambda d: toxicity.predict(d, network),
    }


@pytest.mark.parametrize("name", ["rules", "leaks", "leaks_joined", "pieces", "removal", "removal_refined", "jaccard", "language", "drawn", "tokens", "shards", "toxicity"])
def test_odd_tables(spark, texts, models, name):
    rows, ids, leak = texts
    bench = spark.createDataFrame([(7, leak), (8, leak.upper()), (9, None)], "item_id bigint, text string")
    operator = operators(models, bench)[name]
    plain = spark.createDataFrame([(i, t, "x", "s") for i, t in zip(ids, rows, strict=True)], "doc_id bigint, text string, lang string, source string").repartition(3, "doc_id")
    wide = plain.withColumns({n: F.lit("zz") for n in NAMES if n not in plain.columns})
    got = operator(plain).toPandas()
    assert len(got) == len(rows) and sorted(got.doc_id) == sorted(ids)
    fixed = [c for c in got.columns if c not in ("slot", "rejected_by")]
    as_text = lambda f: sorted(map(str, f[fixed].astype(str).values.tolist()))
    assert as_text(got) == as_text(operator(wide).toPandas())
    for i in (0, 33):  # repeated rows get equal results
        assert len({str(r) for r in got[got.doc_id == i][fixed].astype(str).values.tolist()}) == 1
    one = got.drop_duplicates("doc_id").set_index("doc_id").sort_index()
    raw = [(t or "").encode() for t in rows]
    if name == "rules":
        for i in (0, 33, 34):
            assert tuple(one.loc[i, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == brute_base(rows[i])
    elif name.startswith("leaks"):
        assert [i for i in range(36) if one.contaminated[i]] == [33, 35] and list(one.item_ids[33]) == [7, 8] and set(one.matched_words[[33, 35]]) == {20}
        assert brute_leaks([rows[35]], [(7, leak)]) == [[7]]
    elif name == "pieces":
        assert one.round_trip.all()
    elif name.startswith("removal"):
        short = [i for i in range(len(rows)) if len(raw[i]) < 10_000]
        assert one.n_removed[33] == len(raw[33]) and one.n_removed[34] == len(raw[34])
        want = brute_removal([rows[i] for i in short] + [rows[33][-3000:]], 200)
        assert [(one.n_removed[ids[i]], one.kept_sha256[ids[i]]) for i in short] == [(w[1], w[3]) for w in want[:-1]]
    elif name == "jaccard":
        assert list(one.component_id) == list(range(36)) and one.n_shingles[34] == 1 and one.n_shingles[30] == 0
        w = rows[33].translate(str.maketrans("R", "r")).split()
        assert one.n_shingles[33] == len({tuple(w[k : k + 4]) for k in range(len(w) - 3)})
    elif name == "language":
        assert list(one.lang_pred[[30, 31]]) == ["und"] * 2 and one.score.between(0, 1).all()
    elif name == "drawn":
        assert one.n_grams[33] == 2 * len(rows[33].split()) - 1 and got.selected.sum() >= len(rows) // 2
    elif name == "tokens":
        lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=__import__("public_tokenizers").path(MODEL))
        assert [one.n_tokens[i] for i in (0, 33, 34)] == [len(lib.encode(rows[i])) for i in (0, 33, 34)]
    elif name == "shards":
        assert [(one["size"][i], one.text_crc32[i]) for i in range(36)] == [(len(raw[i]) + 16, zlib.crc32(raw[i])) for i in range(36)]
        assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard")) and hashlib.sha256(b"").digest_size == 32
    else:
        assert one.score.between(0, 1).all()
