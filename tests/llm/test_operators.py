"""Each operator against a brute-force version on small tables with odd rows."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import bpe_counts, bwt_merge, components, decontaminate, jaccard_join, lang_id, piece_lattice, quality_rules, resample, sharding, suffix_dedup, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, row string, lang_pred string"
MODEL = "piece_bpe_32k.model"


def table(spark, texts, ids=None):
    """A documents table with further columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, ["en", "de", None][n % 3], f"s{n % 4}" if n % 5 else None, None if t is None else len(t), 1.0, "x", "y") for n, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = say(120)
    out = [None, "", "   \n\t", "one", "One two", base, base, base.replace("w1 ", "w2 "), base.upper(), "ÄÖ ß é \U0001f984 x", "a" * 3000, "be " * 900, say(3000), base + " " + say(60), say(60) + " " + base, "#*$% " * 60, "x\n" * 30, say(80) + "\n" + say(80)]
    out += [say(rng.randrange(1, 200)) for _ in range(40)]
    for _ in range(12):  # a chain of near copies
        w = base.split()
        w[rng.randrange(len(w))] = "zz"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return df.toPandas().sort_values("doc_id").reset_index(drop=True)


# -- quality rules


def brute_base(t):
    w = WORD.findall(t or "")
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(marked)


def test_quality_rules(spark, odd_texts, empty):
    got = rows_of(quality_rules.apply_rules(table(spark, odd_texts)))
    assert len(got) == len(odd_texts)
    for r, t in zip(got.itertuples(), odd_texts, strict=True):
        want = brute_base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed and r.rejected_by is None)
    # the order of the rules changes nothing but the work
    raw = [(t or "").encode() for t in odd_texts]
    texts = quality_rules.Texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    names = list(quality_rules.RULES)
    alone = np.array([quality_rules.RULES[n](texts) for n in names]).any(0)
    for order in (names, names[::-1]):
        assert ((quality_rules.cascade(texts, order) >= 0) == alone).all()
    # what is set apart for a rule is what a fresh look at those texts gives
    rows = np.array([5, 0, 17, 16, 3])
    part, fresh = texts.subset(rows), quality_rules.Texts(np.frombuffer(b"".join(raw[i] for i in rows), np.uint8), np.concatenate([[0], np.cumsum([len(raw[i]) for i in rows])]))
    assert all((getattr(part, k) == getattr(fresh, k)).all() for k in ("data", "off", "starts", "ends", "first", "n_words"))
    assert set(part.known) == {"word_chars", "symbols", "lines", "dup_lines"} and all((a == b).all() for a, b in zip(quality_rules.base_figures(part), quality_rules.base_figures(fresh), strict=True))
    assert quality_rules.rule_order([{"rule": "shouting", "rejected": 9, "texts": 10, "seconds": 1, "bytes": 1}, {"rule": "exclaiming", "rejected": 9, "texts": 10, "seconds": 0.1, "bytes": 1}])[:2] == ["exclaiming", "shouting"]
    assert quality_rules.apply_rules(empty).count() == 0


# -- decontamination


def brute_leaks(texts, items):
    def toks(t):
        return WORD.findall(re.sub(r"[!-/:-@\[-`{-\x7f]", "", (t or "").translate(LOWER)))

    out = []
    for t in texts:
        d, found = toks(t), set()
        for i, x in items:
            b = toks(x)
            n = min(13, len(b))
            need = 11 if n == 13 else n
            if n and any(sum(p == q for p, q in zip(d[s : s + n], b[o : o + n], strict=True)) >= need for o in range(len(b) - n + 1) for s in range(len(d) - n + 1)):
                found.add(i)
        out.append(sorted(found))
    return out


def test_masks_are_lossless():
    from itertools import combinations

    masks = [[i for i, c in enumerate(m) if c == "1"] for m in decontaminate.MASKS]
    for gone in combinations(range(decontaminate.WINDOW), decontaminate.WINDOW - decontaminate.MATCHES):
        assert any(not set(gone) & {s + i for i in m} for m in masks for s in range(decontaminate.WINDOW - 7))


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination(spark, odd_texts, empty, block):
    rng = random.Random(3)
    voc = [f"b{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(voc) for _ in range(n))) for i, n in enumerate([30, 20, 14, 13, 12, 9, 7, 1, 40])] + [(9, None), (10, ""), (11, "b1 b1"), (0, "again b2 b3 b4")]
    texts = list(odd_texts)
    for k in range(30):
        w = rng.choice(items[:9])[1].split()
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = "zz"
        texts.append("some words before " + " ".join(w[k % 3 :]).upper().replace(" ", rng.choice([" ", ", ", "\n"])) + ". and after")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = rows_of(decontaminate.find_leaks(table(spark, texts), bench, block_bytes=block))
    want = brute_leaks(texts, [(i, t) for i, t in items])
    assert [list(x) for x in got.item_ids] == want and list(got.contaminated) == [bool(w) for w in want]
    assert 10 < sum(map(bool, want)) < len(texts)
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert not decontaminate.find_leaks(table(spark, texts[:3]), bench.limit(0)).toPandas().contaminated.any()


# -- sentencepiece


def test_n_best_against_all_paths():
    v = piece_lattice.pieces(MODEL)

    def all_paths(t):
        out = []

        def go(i, score, ids, key):
            if i == len(t):
                out.append((-score, tuple(reversed(key)), ids))
            for j in range(i + 1, min(len(t), i + v.longest) + 1):
                at = v.id.get(t[i:j])
                if at is not None:
                    go(j, score + int(v.score[at]), [*ids, at], [*key, at])
                elif j == i + 1:
                    go(j, score + v.unknown, ids + [v.byte[b] for b in t[i].encode()], [*key, -1])

        go(0, 0, [], [])
        return [(-a, c) for a, _, c in sorted(out)]

    rng = random.Random(0)
    for _ in range(150):
        t = "".join(rng.choice(["a", "the", "er", "▁", "in", "é", "\U0001f984", "n", " ", "9", "\n"]) for _ in range(rng.randint(1, 7)))[:11]
        every = all_paths("▁" + t.replace(" ", "▁"))
        found = piece_lattice.n_best(v, "▁" + t.replace(" ", "▁"), 5)
        assert [s for s, _ in found] == [s for s, _ in every[:5]]
        assert all(p in every for p in found) and len({tuple(ids) for _, ids in found}) == len(found)
        data = np.frombuffer(t.encode(), np.uint8)
        b = piece_lattice.Batch(v, data, np.array([0, 0, len(data)]), 4)
        assert b.scores == [[0], [s for s, _ in every[:4]]] and b.ids.tolist() == every[0][1]
        paths = [(s, p.tolist()) for s, p in zip(b.scores[1], b.n_best[1], strict=True)]
        assert all(p in every for p in paths) and paths[0] == every[0] and len({tuple(ids) for _, ids in paths}) == len(paths)


def test_long_segments(monkeypatch):
    """A segment by itself gets what the recursions over many give, in time that grows with its length."""
    v = piece_lattice.pieces(MODEL)
    rng = random.Random(5)
    text = "".join(rng.choice(["the", "er", "a", "in", "é", "st", "\U0001f984"]) for _ in range(900)) + " ab" + "a" * 2000
    data = np.frombuffer(text.encode(), np.uint8)
    found = []
    for long in (1, 5, 10**9):
        monkeypatch.setattr(piece_lattice, "LONG", long)
        b = piece_lattice.Batch(v, data, np.array([0, len(data)]), 4)
        found.append((b.scores, [p.tolist() for p in b.n_best[0]][0]))
    assert found[0] == found[1] == found[2]
    monkeypatch.undo()
    began = time.perf_counter()
    data = np.frombuffer(b"a" * 100_000, np.uint8)
    b = piece_lattice.Batch(v, data, np.array([0, len(data)]), 4)
    assert len(b.scores[0]) == 4 and time.perf_counter() - began < 30


def test_encode_and_decode(spark, odd_texts, empty):
    sp = pytest.importorskip("sentencepiece")
    import public_tokenizers

    lib = sp.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    docs, v = table(spark, odd_texts), piece_lattice.pieces(MODEL)
    out = piece_lattice.encode(docs, MODEL)
    got = rows_of(out)
    for r, t in zip(got.itertuples(), odd_texts, strict=True):
        ids = list(r.ids)
        assert r.round_trip and r.n_pieces == len(ids) and lib.decode([int(i) for i in ids]) == (t or "")
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()
        scores = list(r.nbest_scores)
        assert scores[0] == r.best_score and scores == sorted(scores, reverse=True)
        assert r.nbest_sha256[0] == r.ids_sha256 and len(r.nbest_sha256) == len(scores) == len(set(r.nbest_sha256))
    many = rows_of(piece_lattice.encode(docs, MODEL, with_ids=False, with_n_best=True))
    for r, t in zip(many.itertuples(), odd_texts, strict=True):
        assert [hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest() for ids in r.nbest_ids] == list(r.nbest_sha256)
        assert all(lib.decode([int(i) for i in ids]) == (t or "") for ids in r.nbest_ids)
        worth = [sum(int(v.score[i]) if v.kind[i] == 1 else 0 for i in ids) for ids in r.nbest_ids]
        if all(v.kind[i] == 1 for ids in r.nbest_ids for i in ids):
            assert worth == list(r.nbest_scores)
    back = rows_of(piece_lattice.decode(out, MODEL))
    assert list(back.text) == [t or "" for t in odd_texts]
    assert piece_lattice.encode(empty, MODEL).count() == 0
    v = piece_lattice.pieces(MODEL)
    assert v.decode([v.byte[0xFF], v.byte[0xC3], v.byte[0xA9]]) == "�é"


# -- suffix-array dedup


def test_merged_transforms():
    rng = np.random.default_rng(0)
    for _ in range(60):
        step, depth = int(rng.integers(1, 4)), int(rng.choice([1, 2, 4, 8]))
        size = step * depth
        strings = [rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(size, size + 30))).astype(np.uint8) for _ in range(int(rng.integers(1, 8)))]
        off = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        data = np.concatenate(strings)
        starts = [(p, bytes(data[p : p + size])) for a, b in zip(off, off[1:], strict=False) for p in range(a, b - size + 1)]
        n = Counter(k for _, k in starts)
        want = np.zeros(len(data), bool)
        want[[p for p, k in starts if n[k] > 1]] = True
        got = bwt_merge.repeated_places(data, off, step, depth, shard_size=int(rng.choice([20, 50, 1000])))
        if len(strings) > 1:
            assert (got == want).all()


def test_common_prefixes():
    data = np.frombuffer(b"abcabdabcabe", np.uint8)
    s = bwt_merge.Symbols.of(data, np.array([0, 6, 12]), 1)
    a, b = bwt_merge.shard(s, 0, 7, 6), bwt_merge.shard(s, 7, 14, 6)
    merged, common = bwt_merge.merge(a, b, 6)
    text = b"abcabd$abcabe$"
    suffixes = [text[p:].split(b"$")[0] for p in merged.suffixes]
    for x, y, n in zip(suffixes, suffixes[1:], common[1:], strict=False):
        shared = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        assert n == shared


def brute_removal(texts, length):
    raw = [(t or "").encode() for t in texts]
    n = Counter(r[p : p + length] for r in raw for p in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if n[r[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("length,anchor,depth,hot", [(200, 32, 4, 20_000), (200, 32, 8, 20_000), (40, 8, 4, 20_000), (40, 8, 4, 2)])
def test_suffix_dedup(spark, odd_texts, empty, length, anchor, depth, hot):
    docs = table(spark, odd_texts)
    got = rows_of(suffix_dedup.removal_digest(docs, length, anchor, depth, hot))
    want = brute_removal(odd_texts, length)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.itertuples()] == [w[:4] for w in want]
    if depth == 4:
        texts = rows_of(suffix_dedup.without_repeats(docs, length, anchor, depth))
        assert list(texts.columns) == docs.columns
        assert [t or "" for t in texts.text] == [w[4].decode("utf-8", "ignore") for w in want]
    if length == 200:
        assert suffix_dedup.removal_digest(empty).count() == 0
        twice = rows_of(suffix_dedup.removal_digest(table(spark, ["q " * 150] * 2, [7, 7])))
        assert list(twice.n_removed) == [300, 300] and list(twice.n_spans) == [1, 1]


# -- Jaccard join


def brute_components(texts, k, num, den):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(sets)))
    changed = True
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(root[i], root[j])
            changed |= root[i] != low or root[j] != low
            root[i] = root[j] = low
    return [len(s) for s in sets], root


@pytest.mark.parametrize("k,num,den,meeting,held,hot", [(4, 85, 100, 20_000, 2_000_000, 0), (5, 80, 100, 20_000, 2_000_000, 0), (2, 60, 100, 20_000, 2_000_000, 0), (4, 85, 100, 3, 500, 0), (2, 60, 100, 2, 200, 0), (4, 85, 100, 2, 300, 1), (2, 60, 100, 20_000, 1, 1)])
def test_jaccard(spark, odd_texts, empty, k, num, den, meeting, held, hot):
    """Small bounds send meetings and candidate groups to parts; hot shingles are dealt before they are gathered."""
    chosen = None
    if hot:
        raw = [(t or "").encode() for t in odd_texts]
        h = jaccard_join.sets_of(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), k)[0]
        chosen = np.unique(h)[::3].view(np.int64).tolist()
    got = rows_of(jaccard_join.jaccard_components(table(spark, odd_texts), k, num, den, meeting, held, chosen))
    sizes, root = brute_components(odd_texts, k, num, den)
    assert list(got.n_shingles) == sizes and list(got.component_id) == root
    assert len(set(root)) < len(root) - 5
    if held == 2_000_000:
        assert jaccard_join.jaccard_components(empty, k, num, den).count() == 0


def test_bounds_never_lose_a_link():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, int(n), dtype=np.uint64)) for n in (10, 40, 600, 640, 5000)]
    sets += [s[rng.random(len(s)) < 0.93] for s in sets for _ in range(3)]
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    points = jaccard_join.Points(*jaccard_join.points_of(np.concatenate(sets), first))
    tree = jaccard_join.RTree(points)
    for i, a in enumerate(sets):
        found = set(tree.search(i, np.ones(len(sets), bool), 85, 100).tolist())
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                assert j in found


def test_chance_meetings_end_before_points(spark, monkeypatch):
    """Texts that share frequent phrases, but don't link, leave no rows to join points to; near copies among them stay linked."""
    rng = random.Random(8)
    words = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(4000)]
    phrases = [[rng.choice(words) for _ in range(5)] for _ in range(60)]
    texts = []
    for _ in range(300):
        parts = [[rng.choice(words) for _ in range(rng.randint(4, 9))] + (rng.choice(phrases) if rng.random() < 0.5 else []) for _ in range(rng.randint(8, 60))]
        texts.append(" ".join(w for p in parts for w in p))
    for i in range(0, 30, 3):
        near = texts[i].split()
        for at in rng.sample(range(len(near)), max(1, len(near) // 90)):
            near[at] = rng.choice(words)
        texts.append(" ".join(near))
    counts, grouped = [], jaccard_join._grouped

    def counted(rows, *args):
        counts.append(rows.count())
        return grouped(rows, *args)

    monkeypatch.setattr(jaccard_join, "_grouped", counted)
    for k, num in ((4, 85), (2, 60)):
        del counts[:]
        got = rows_of(jaccard_join.jaccard_components(table(spark, texts), k, num, 100, hot=[]))
        assert list(got.component_id) == brute_components(texts, k, num, 100)[1]
        assert len(set(got.component_id)) < len(texts)
        assert counts[0] < 100


def test_least_shared_never_loses_a_link():
    rng = np.random.default_rng(6)
    for num, den in ((85, 100), (80, 100), (60, 100)):
        for _ in range(2000):
            n, both = rng.integers(1, 60, 2)
            a = np.sort(rng.choice(200, n, replace=False))
            b = np.union1d(rng.choice(a, min(n, both), replace=False), rng.choice(200, rng.integers(0, 8)))
            common = np.intersect1d(a, b)
            if den * len(common) < num * (len(a) + len(b) - len(common)):
                continue
            least = int(jaccard_join.least_shared(num, den, np.array([len(a)]), np.array([len(b)]))[0])
            need = int(jaccard_join.needed(num, den, np.array([len(a) + len(b)]))[0])
            assert least > 0 and len(np.intersect1d(a[: len(a) - need + least], b[: len(b) - need + least])) >= least
            assert all(len(x) - need + least <= len(x) - -(-num * len(x) // den) + 1 for x in (a, b))


def test_repeated_rows_and_components(spark):
    got = jaccard_join.jaccard_components(table(spark, ["a b c d e"] * 3 + ["x"], [5, 5, None, 9]), 4, 85, 100).toPandas()
    assert sorted(got.component_id.fillna(-1)) == [5, 5, 5, 9]
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    found = {r.node: r.root for r in components.components(edges).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# -- language ID


def speak(rng, lang, n):
    syllables = {"xx": ["ka", "to", "mi", "ro"], "yy": ["sch", "ung", "ein", "ö"], "zz": ["ñ", "ción", "el", "os"]}[lang]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_id(spark, empty):
    rng = random.Random(2)
    rows = [(i, speak(rng, lang, 40), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = lang_id.fit(docs, F.col("doc_id") % 4 != 2)
    got = rows_of(lang_id.predict(docs.drop("lang"), model))
    held = [i for i, *_ in rows if i % 4 == 2]
    assert np.mean([got.lang_pred[i] == rows[i][2] for i in held]) > 0.95 and got.score.between(0, 1).all()
    odd = spark.createDataFrame([(0, None), (1, ""), (2, "12 + ?!"), (3, speak(rng, "zz", 5000)), (4, "é"), (5, "字")], "doc_id bigint, text string")
    out = rows_of(lang_id.predict(odd, model))
    assert list(out.lang_pred[:3]) == ["und"] * 3 and out.lang_pred[3] == "zz" and "und" not in list(out.lang_pred[3:])
    assert lang_id.predict(empty.select("doc_id", "text"), model).count() == 0
    nothing = lang_id.fit(docs, F.lit(False))
    assert set(lang_id.predict(odd, nothing).toPandas().lang_pred) == {"und"}


def test_convolution_by_lookup():
    """The table form of the network gives what the plain convolution gives."""
    model = lang_id.ByteCNN(["a", "b"])
    model.bias += 0.1
    data = np.random.default_rng(0).integers(1, 256, 700).astype(np.uint8)
    rows, _ = lang_id.windows(data, np.array([0, 300, 300, 700]))
    e = model.embed[rows]
    pooled = [np.concatenate([e[:, j : j + lang_id.WINDOW] for j in range(w)], 2) @ k for w, k in zip(lang_id.WIDTHS, model.filters, strict=True)]
    s = np.maximum(np.concatenate([p.max(1) for p in pooled], 1) + model.bias, 0) @ model.out + model.out_bias
    want = np.exp(s) / np.exp(s).sum(1, keepdims=True)
    assert np.allclose(model.probabilities(rows), want, atol=1e-4)


# -- resampling


def test_resampling(spark, odd_texts, empty):
    docs = table(spark, odd_texts)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 50)] + [(3, None, 0), (999, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = rows_of(resample.resample(docs, labels, share=0.4))
    grams = []
    for t in odd_texts:
        w = WORD.findall((t or "").translate(LOWER))
        grams.append(len(w) + max(0, len(w) - 1))
    assert list(got.n_grams) == grams and (got.log_weight[got.n_grams == 0] == 0).all()
    k = int(0.4 * len(got))
    least = sorted(got.drawn_value, reverse=True)[k - 1]
    assert list(got.selected) == list(got.drawn_value >= least) and got.selected.sum() == k
    raw = resample.bucket_counts(docs)
    assert raw.sum() == sum(grams)
    # everything again, a word at a time
    import math

    import xxhash

    def buckets(t):
        w = [int(quality_rules.Texts(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())])).word_hash()[0]) for x in WORD.findall((t or "").translate(LOWER))]
        two = [int(resample.mix(np.array([(a * 0x9E3779B97F4A7C15 + b) % 2**64], np.uint64))[0]) for a, b in zip(w, w[1:], strict=False)]
        return [x % resample.BUCKETS for x in w + two]

    every = [buckets(t) for t in odd_texts]
    all_, good_ = Counter(b for x in every for b in x), Counter(b for i in range(1, 50, 2) for b in every[i])
    n_all, n_good = sum(all_.values()), sum(good_.values())
    weight = [sum(math.log((good_[b] + 1) / (n_good + resample.BUCKETS)) - math.log((all_[b] + 1) / (n_all + resample.BUCKETS)) for b in x) for x in every]
    assert np.allclose(got.log_weight, weight)
    for i, (value, w) in enumerate(zip(got.drawn_value, weight, strict=True)):
        uniform = ((xxhash.xxh64_intdigest((1).to_bytes(4, "little"), xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42)) & ((1 << 52) - 1)) + 0.5) / (1 << 52)
        assert abs(value - (w - math.log(-math.log(uniform))) * resample.SCALE) <= 2, i
    bucket, text = resample.ngram_buckets(np.frombuffer(b"a b a", np.uint8), np.array([0, 5]))
    assert len(bucket) == 5 and set(text) == {0} and bucket[0] == bucket[2]
    ratio = resample.log_ratio(np.eye(1, resample.BUCKETS, 3)[0] * 50, raw)
    assert ratio.argmax() == 3
    assert resample.resample(empty, labels).count() == 0
    assert resample.kth_largest(spark.createDataFrame([(x,) for x in (5, -7, 5, 2, 10**12)], "v bigint"), 3) == 5


def test_kth_largest_of_many(spark):
    """A third of the rows near one value: as many rows reach the k-th as with a sort."""
    noise = -F.log(-F.log((F.pmod(F.xxhash64("id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)))
    weight = F.when(F.col("id") % 3 == 0, 0.0).otherwise((F.pmod(F.xxhash64("id", F.lit(7)), F.lit(40_000)) - 20_000) / 100.0)
    values = spark.range(100_000).select(((weight + noise) * resample.SCALE).cast("long").alias("v")).cache()
    v = np.sort(values.toPandas().v.to_numpy())[::-1]
    for k in (1, 1_000, 30_000, 50_000, 60_000, 100_000):
        last = resample.kth_largest(values, k)
        assert last == v[k - 1] and (v >= last).sum() == (v >= v[k - 1]).sum(), k
    values.unpersist()


# -- token counts


def test_token_counts(spark, odd_texts, empty):
    sp = pytest.importorskip("sentencepiece")
    import public_tokenizers

    lib = sp.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    rng = random.Random(4)
    texts = [*odd_texts, "<s> </s> <unk> <0x41>", " " * 5000, "=" * 4001, "é" * 999, "a\x00b", "▁x ▁▁y", "1234567890 " * 300, "".join(chr(rng.choice([65, 97, 0x4E00, 0x1F600, 0x301, 10])) for _ in range(3000))]
    got = rows_of(bpe_counts.token_counts(table(spark, texts), MODEL))
    assert list(got.n_tokens) == [len(lib.encode(t)) if t else 0 for t in texts]
    assert list(got.n_bytes) == [len((t or "").encode()) for t in texts] and list(got.over_limit) == [n > 4096 for n in got.n_tokens]
    assert bpe_counts.token_counts(empty, MODEL).count() == 0
    v = bpe_counts.vocabulary(public_tokenizers.path(MODEL))
    sequences = [v.symbols(t) for t in ("banana" * 40, "the▁the", "aaaaaaaaaaaaaaaaab", "▁" * 70, "a", "\U0001f984", "".join(rng.choice("thesinat") for _ in range(700)))]
    want = [int(bpe_counts.merge_rows(v, np.array([s], np.int32))[0]) for s in sequences]
    for block in (1, 2, 16, 1000):
        assert bpe_counts.merge_blocks(v, sequences, block).tolist() == want


# -- sharding


def test_sharding(spark, empty):
    rng = random.Random(6)
    texts = ["hot text " * 20] * 300 + ["hotter text " * 40] * 600 + [" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 300))) for _ in range(600)] + [None, "", "é"]
    docs = table(spark, texts, list(range(len(texts) - 1)) + [0])
    got = sharding.kd_shards(docs, shards=8).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(got) == len(texts) and list(size.index) == list(range(8))
    # the copies of a hot text are a shard of their own where they exceed an even share; the other shards are near equal
    assert size[7] == 600 * (len("hotter text " * 40) + 16) and size[:7].max() < 1.1 * size[:7].mean() and size[:7].min() > 0.9 * size[:7].mean()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert (got.groupby("text_crc32").shard.nunique() == 1).all()
    import zlib

    assert Counter(zip(got["size"], got.text_crc32, strict=True)) == Counter((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in texts)
    by_bytes = sharding.kd_shards(docs, target_bytes=int(got["size"].sum() / 3) + 1).toPandas()
    assert by_bytes.shard.nunique() == 3
    assert sharding.kd_shards(empty, shards=4).count() == 0
    plan = sharding.kd_shards(docs, shards=2)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- toxicity


def test_gradients():
    model = toxicity.BiGRU()
    raw = b"aa bb cc dd aa ee ff gg"
    v = toxicity.Vocabulary(np.frombuffer(raw, np.uint8), np.array([0, 11, len(raw)]))
    ids, _ = v.windows()
    target = np.array([1, 0], np.float32)
    model.p = {k: x.astype(np.float64) for k, x in model.p.items()}

    def loss():
        logit = model.forward(model.inputs(v).astype(np.float64), ids)
        return float(np.mean(np.log1p(np.exp(logit)) - target * logit))

    g = model.gradients(v, model.inputs(v).astype(np.float64), ids, target)
    rng = np.random.default_rng(0)
    for name in ("fw", "fu", "fc", "bw", "bu", "att", "query", "out", "bias"):
        x = model.p[name]
        at = tuple(rng.integers(0, n) for n in x.shape)
        keep, eps = x[at], 1e-3
        x[at] = keep + eps
        up = loss()
        x[at] = keep - eps
        down = loss()
        x[at] = keep
        assert abs((up - down) / (2 * eps) - g[name][at]) < 2e-3 * max(1, abs(g[name][at])), name


def test_toxicity(spark, empty):
    rng = random.Random(8)
    bad = ["vile", "nasty", "rotten"]
    rows = []
    for i in range(400):
        w = [f"w{rng.randrange(200)}" for _ in range(rng.randint(20, 150))]
        if i % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(bad).upper() + "!"
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows] + [(5, 1, None), (9999, 0, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0)
    got = rows_of(toxicity.predict(docs, model))
    held = [r for r in rows if r[0] % 5 == 0]
    assert np.mean([(got.score[i] >= 0.5) == bool(t) for i, _, t in held]) > 0.95
    odd = spark.createDataFrame([(0, None), (1, ""), (2, "?!"), (3, "w1 " * 5000 + "vile w2")], "doc_id bigint, text string")
    out = rows_of(toxicity.predict(odd, model))
    assert out.score.between(0, 1).all() and out.score[3] > 0.5 and out.score[0] == out.score[1]
    assert toxicity.predict(empty.select("doc_id", "text"), model).count() == 0
    assert set(toxicity.predict(odd, toxicity.fit(docs, labels, F.lit(False))).toPandas().score) == {0.0}


def test_toxicity_late_in_texts(spark):
    """Whole texts are read, in training and in scoring: in every other text what tells toxic ones apart comes after 1,600 words."""
    rng = random.Random(9)
    rows = []
    for i in range(400):
        w = [f"w{rng.randrange(200)}" for _ in range(rng.randint(1600, 1700) if i % 2 else 60)]
        rows.append((i, " ".join([*w, "vile!" if i % 3 == 0 else "kind!", *w[:10]]), int(i % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0)
    got = rows_of(toxicity.predict(docs, model))
    assert np.mean([(got.score[i] >= 0.5) == bool(t) for i, _, t in rows if i % 5 == 0]) > 0.9
    texts = docs.filter("doc_id % 6 = 3").selectExpr("doc_id AS key", "1 AS toxic", "text")
    windows, target = toxicity.windows_of(texts, model, toxicity.WARM_EPOCHS)
    assert len(windows) == 2 * texts.count() and target.all()
    assert np.mean([b"vile" in w.split() for w in windows]) > 0.95


def test_toxicity_held_out():
    """Recall and false positives of the network alone on labelled rows that training never saw. The tables are the tenth scale's."""
    import zlib

    docs, labels = (pd.read_parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    rows = labels[labels.toxic.notna()].merge(docs, on="doc_id")
    rows = rows[rows.text.notna()]
    held = rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0).to_numpy()
    pack = lambda texts: (np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64))
    known = rows[~held].groupby("text").toxic.max()
    data, off = pack(known.index)
    toxic, key = known.to_numpy().astype(int), np.arange(len(known), dtype=np.uint64)
    n = np.bincount(toxicity.Vocabulary(data, off).windows()[1], minlength=len(toxic))
    shares = min(1, toxicity.WARM_WINDOWS / n.sum()), min(1, toxicity.CLEAN_WINDOWS / n[toxic == 0].sum())
    for seed in (5, 6, 7):
        model = toxicity.BiGRU(seed)
        model.start(toxic.sum(), (toxic == 0).sum())

        def rounds(model=model):
            for epoch in range(toxicity.EPOCHS):
                windows = model.pick(data, off, key, toxic, epoch, shares)
                yield [w for own in windows for w in own], np.repeat(toxic, [len(own) for own in windows])

        model.train(rounds(), seed=seed - 2)
        found, want = model.score(*pack(rows[held].text)) >= 0.5, rows[held].toxic.to_numpy() == 1
        assert found[want].mean() >= 0.9 and found[~want].mean() <= 0.015, seed


def test_picked_windows_are_the_texts_own():
    texts = [b"", b"?!", b"One two!  " * 40, b"a b"]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    model = toxicity.BiGRU()
    for epoch in (0, toxicity.WARM_EPOCHS):
        got = model.pick(data, off, np.arange(4, dtype=np.uint64), np.array([0, 1, 1, 0]), epoch)
        pairs = lambda n: b" ".join([b"one two"] * n)
        for own, want in zip(got, [{b""}, {b""}, {pairs(24), pairs(16)}, {b"a b"}], strict=True):
            assert set(own) <= want and len(own) == (2 if epoch else 3 if len(want) > 1 else 1)
    assert [len(x) for x in model.pick(data, off, np.arange(4, dtype=np.uint64), np.zeros(4, int), 1, (0.3, 1.0))] == [1] * 4


def test_sparse_words_keep_windows():
    v = toxicity.Vocabulary(np.frombuffer(b"a " * 70, np.uint8), np.array([0, 140, 140]))
    ids, text = v.windows()
    assert list(text) == [0, 0, 1] and (ids[-1] == 1).all() and isinstance(pd.Series(text).max(), (int, np.integer))
