"""Order MinHash fingerprints against plain Python, which ranks the elements of each component anew."""

import hashlib
import re
import struct

import pandas as pd
import xxhash

from quarrylight.llm import order_minhash as om

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANK, LEAST = -(1 << 31), -(2**63)


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def chain(*longs):
    seed = 42
    for x in longs:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", x), seed=seed)
    return signed(seed)


def occurrence_rank(kmer, c):
    seed = xxhash.xxh64_intdigest(struct.pack("<q", kmer), seed=42)
    return signed(xxhash.xxh64_intdigest(struct.pack("<i", c), seed=seed)) & RANK


def signature(text):
    words = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in WORD.findall(text)]
    kmers = [chain(*words[i : i + om.K]) & RANK for i in range(max(1, len(words) - om.K + 1))] if words else []
    seen, elements = {}, []
    for at, h in enumerate(kmers):
        c = seen.get(h, 0)
        seen[h] = c + 1
        elements.append((occurrence_rank(h, c - 1) if c else h, at))
    out = []
    for j in range(om.M):
        begin = LEAST + j * 2**64 // om.M
        least = sorted(elements, key=lambda e: ((e[0] - begin) % 2**64, e[1]))[:2]
        if len(least) == 1:
            least *= 2
        out.append(chain(*[e[0] for e in sorted(least, key=lambda e: e[1])]) >> 32)
    return out


def spelled(sig):
    return "".join(f"{c % 2**32:08X}" for c in sig)


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest((r[1] or "").encode(), seed=42))), reverse=True)
    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, changed, other = signature(text), signature(edited), signature(after)
        like = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / om.M
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), spelled(own), spelled(changed), like(own, changed), like(own, other)))
    return sorted(out, key=repr)


def found(spark, rows, blocks=None, schema="doc_id bigint, text string"):
    return sorted(map(tuple, om.fingerprints(spark.createDataFrame(rows, schema), blocks).collect()), key=repr)


def test_table(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    rows = [(int(d), t) for d, t in zip(docs.doc_id, docs.text, strict=True)]
    assert found(spark, rows) == expected(rows) == found(spark, rows, 1)


def test_odd_rows(spark):
    words = [f"w{i % 7}" for i in range(400)]
    rows = [(5, None), (4, ""), (None, "of no id"), (9, "a b c d e f g " * 30), (9, "a b c d e f g " * 30), (9, " ".join(words)), (7, "one"), (6, "één twee\x0bdrie vier"), (3, "x" * 100_000), (2, "\t \n"), (1, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich 𝄞𝄞𝄞")]
    for blocks in (1, 3, 50):
        assert found(spark, rows, blocks) == expected(rows)
    assert found(spark, []) == [] and found(spark, [(3, "a b")]) == expected([(3, "a b")])
    clash = spark.createDataFrame([(1, "a b c", "s", 2), (0, None, "s", 2)], "doc_id bigint, text string, signature string, block int")
    assert sorted(map(tuple, om.fingerprints(clash).collect()), key=repr) == expected([(1, "a b c"), (0, None)])


def test_an_id_of_a_third_of_all_rows(spark):
    """It is dealt to several blocks, in the order of the texts' hashes."""
    rows = [(50, f"some text of number {i} in a row of texts") for i in range(100)] + [(i, f"text {i}") for i in range(200)]
    assert found(spark, rows, 16) == expected(rows)
    dealt = om.dealt_in_blocks(spark.createDataFrame(rows, "doc_id bigint, text string"), 16).filter("not _halo")
    assert dealt.filter("doc_id = 50").select("_block").distinct().count() >= 4


def test_order_and_edits_count(spark):
    """A plain set of k-mers hardly tells halves that changed places; order MinHash does, and likeness falls with the edits."""
    words = [f"word{i * i % 997}x{i}" for i in range(600)]
    edits = lambda every: " ".join("new" if i % every == 0 else w for i, w in enumerate(words))
    texts = [" ".join(words), " ".join(words[300:] + words[:300]), edits(200), edits(60), edits(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    sig = {r[0]: r[1] for r in om.with_signature(df, "text", "s").select("doc_id", "s").collect()}
    like = [sum(a == b for a, b in zip(sig[0], sig[i], strict=True)) / om.M for i in range(5)]
    assert like[0] == 1 and like[1] < 0.75 and like[2] > like[3] > like[4] and like[2] > 0.85 and like[4] < 0.75


def test_native(spark, sf_dir):
    plan = om.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
