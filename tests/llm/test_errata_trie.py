"""Spelling variants against all pairs in plain Python."""

import random
import re
import zlib
from collections import Counter

import pandas as pd

from quarrylight.llm import errata_trie as et
from quarrylight.llm.common import Scratch

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    n = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def deletions(w):
    return {w[:i] + w[i + 1 :] for i in range(len(w))}


def near(words):
    """Pairs by shared patterns: one wildcard, or one character less."""
    out, patterns = {w: set() for w in words}, {}
    for w in words:
        for i in range(len(w)):
            patterns.setdefault((i, w[:i], w[i + 1 :]), []).append(w)
        for d in deletions(w) & out.keys():
            out[w].add(d), out[d].add(w)
    for group in patterns.values():
        for a in group:
            out[a].update(b for b in group if b != a)
    return out


def expected(n):
    by, forms = near(n), {}
    for w in n:
        best = min(by[w], key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while forms[w] is not None:
            w = forms[w]
        return w

    return {w: (forms[w], root(w), n[w], len(by[w]), forms[w] and n[forms[w]]) for w in n}


def rows_of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def found(spark, rows):
    return rows_of(et.spelling_variants(spark.createDataFrame(rows, "doc_id bigint, text string")))


def test_table(spark):
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(int(d), t) for d, t in zip(docs.doc_id, docs.text, strict=True)]
    got = found(spark, rows)
    assert got == expected(counted(rows)) and sum(1 for x in got.values() if x[0]) > 20


def test_dense_words_in_many_ranges(spark, monkeypatch):
    """Nearly all spellings over three letters: places part and words end on the paths between ranges."""
    monkeypatch.setattr(et, "RANGE_CHARS", 900)
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.choice((7, 8, 9)))): rng.choice((2, 2, 3, 40, 500, 70_000)) for _ in range(2500)}
    words |= {"a" * n: 2 for n in range(7, 60)} | {"b" * 3000: 5, "b" * 3001: 60}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    with Scratch(spark) as scratch:
        got = scratch.written(et.near_words(scratch.written(df, "w"), scratch), "f")
        assert rows_of(et.with_roots(got, scratch)) == expected(words)


def test_pairs_come_once_and_copies_are_few(spark):
    """Every near pair is found once (n_near counts meetings, so a second one would show), by fewer copies than one a character."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdefghij") for _ in range(10)) for _ in range(4000)})
    made = Counter()
    for place, hi in et.places(words):
        runs = list(zip(place.starts, [*place.starts[1:], hi], strict=False))
        if runs:
            top = max(runs, key=lambda r: r[1] - r[0])
            made["light"] += sum(b - a for a, b in runs if (a, b) != top)
    assert made["light"] / len(words) < 5 < 10


def test_odd_rows(spark):
    assert found(spark, []) == {} and found(spark, [(1, None), (2, "")]) == {}
    rows = [(1, "Planets planets PLANETS ÉTOILES étoiles ÉTOILES"), (None, "planets planets"), (3, None), (4, "short " * 9), (5, "x" * 40_000 + " " + "x" * 40_000), (6, "plan-ets a×b÷cdefgh a×b÷cdefgh"), (1, "Planets planets PLANETS ÉTOILES étoiles ÉTOILES")]
    rows += [(i, "letters " * 60 + "lettrs lettrs letterss letterss") for i in range(7, 11)]
    got = found(spark, rows)
    assert got == expected(counted(rows)) and got["lettrs" if "lettrs" in got else "letterss"][0] == "letters"
    clash = spark.createDataFrame([(1, "letters letters", 3, "k")], "doc_id bigint, text string, n int, word string")
    assert rows_of(et.spelling_variants(clash)) == expected(counted([(1, "letters letters")]))
