"""The prefix trie against a plain one built turn by turn."""

import hashlib
import re
import zlib

import pandas as pd
import pytest

from quarrylight.llm import prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = own.get(c - int(pd.Series([c]).mod(20).iloc[0]), [])[:h] + turns[h:]
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    below = {p: [] for p in nodes}
    for p in nodes:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    out = []
    for p, members in nodes.items():
        children = [q for q in below[p] if len(q) == len(p) + 1]
        saved = sum((len(nodes[q]) - 1) * len(WORD.findall(q[-1][1])) for q in below[p] if q)
        leaves = sum(1 for q in below[p] if len(below[q]) == 1)
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def trie(spark, rows):
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted((tuple(r) for r in found), key=lambda r: (r[1], r[0]))


def test_tables(spark):
    docs = pd.read_parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [(int(r.conv_id), int(r.turn), r.role, r.text) for r in docs.itertuples()]
    assert trie(spark, rows) == plain(rows)


def test_copies_ends_and_missing(spark):
    """Few distinct turns, so that prefixes branch, end and repeat everywhere, over all ranges; ids without a family's first one; null turns, roles and texts."""
    rows, state = [], 7
    for c in list(range(0, 900)) + [1021, 1022, 5003, 70001]:
        state = (state * 1103515245 + 12345) % 2**31
        n, seed = state % 7 + 1, state // 7 % 40
        for t in range(n):
            same = c % 3 == 0  # a third are copies
            rows.append((c, None if t == 0 else t, None if (t + seed) % 9 == 0 else "ab"[t % 2], None if (t * seed) % 11 == 10 else f"w {0 if same else (seed >> t) % 2}" + " x" * (t % 3)))
    assert trie(spark, rows) == plain(rows)


def test_one_conversation_many_times(spark, monkeypatch):
    """Lists of ends that cross ranges, cut in small pieces; a root with many children under shared keys."""
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 50)
    monkeypatch.setattr(prefix_trie, "CHILDREN", 3)
    rows = [(20 * c + 10**6, 1, "u", "same words here") for c in range(400)] + [(20 * c, 1, "u", f"other {c}") for c in range(300)] + [(20 * c, 2, "u", "tail") for c in range(0, 300, 2)]
    assert trie(spark, rows) == plain(rows)


def test_long_conversation(spark):
    rows = [(c, t, "u", f"turn {t}" if t < 1500 or c < 40 else f"{c} {t}") for c in (0, 20, 40, 60) for t in range(3000)]
    found = trie(spark, rows)
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in (0, 20, 40, 60)}
    assert h and len(found) == 1 + 1500 + 3 * 1500 and found[0][3:6] == (4, 1, 3)
    assert found[1500][4] == 3 and found[0][6] == sum(2 for t in range(1500)) * 3 + 1500 * 2


def test_odd_rows(spark):
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "a", "b")]) == []
    rows = [(21, 0, "u", "a")] * 2 + [(-3, None, None, None), (-3, 5, "u", ""), (0, 0, "u", " \t\n")]
    assert trie(spark, [*rows]) == [*plain_signed(rows)]
    clash = spark.createDataFrame([(1, 0, "u", "x y", "k", 3)], SCHEMA + ", key string, depth int")
    assert [r["depth"] for r in prefix_trie.prefix_trie(clash).orderBy("depth").collect()][0] == 0


def plain_signed(rows):
    """The family of a negative id is by the remainder's sign, as SQL has it."""
    shifted = [(c, t, r, x) for c, t, r, x in rows]
    real = pd.Series.mod
    try:
        pd.Series.mod = lambda s, n: s.map(lambda v: int(abs(v) % n * (1 if v >= 0 else -1)))
        return plain(shifted)
    finally:
        pd.Series.mod = real


@pytest.mark.parametrize("a, b, n", [(b"", b"", 0), (b"x" * 48, b"x" * 32, 2), (b"a" * 16 + b"b" * 16, b"a" * 16 + b"c" * 32, 1), (b"a" * 16, b"b" * 16, 0)])
def test_shared(a, b, n):
    assert prefix_trie.shared(a, b) == n
