"""Spelling variants: all pairs of a corpus's words at one edit, by merging an errata trie along heavy paths.

In the trie of the words each place's heaviest child (most words; ties: least character) continues its heavy path, and the other children are light. Two
words at one edit part at one place, and at least one of them goes on there by a light child or ends. So only light
subtrees are copied, small to large: every word below a light child is copied with the next character replaced by the heavy one, and with that
character skipped; and with the heavy character put before it, as are words that end at the place. Where a copy coincides with a word or, replaced at one
place, with another copy, the two words are near. A word lies in at most log2(words) light subtrees, so this makes fewer copies than one for
each of its characters, and every near pair is found exactly once.

Words are counted with a combine in each task, and dealt in sorted ranges of bounded size, each of which is a part of the trie. Only places on the path of a range's first or last
word reach into other ranges: their children are counted over all ranges, which agree on the heavy one by a table of a few rows a range. Copies meet by a shuffle on
the spelling. What meets there is bounded by the alphabet and the word's length, and is summed up in place: no pairs are made. Forms are followed by doubling:
counts grow tenfold a step, so a chain has at most 19 steps.

Defined cases: a null text has no words; a null id counts as an empty one; ties of forms go to the least word in code-point order; repeated
rows count as often as they occur; texts and words of any length are taken whole; other columns, whatever their names, are left out; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship, tasks_for, written

#: Shortest word, least number of occurrences, share of runs that lose a character, how much commoner a form is (fixed by the contract).
LEAST_LENGTH, LEAST_COUNT, DELETED, COMMONER = 7, 2, 31, 10
#: Words that a task counts before it hands the counts on.
HELD_WORDS = 200_000
#: Code points of the words of one range of the trie.
RANGE_CHARS = 2_000_000
OUT_ROWS = 20_000

#: Maximal runs that are long enough to give a word.
_RUN = re.compile("[a-z\u00c0-\u00ff]{%d,}" % LEAST_LENGTH)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts. A run loses the character that the CRC-32 of id and run tells if DELETED divides that; runs are maximal, so shorter ones than a word's least length can't give words."""
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return found

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            raw = text.as_buffer()
            if raw is None:
                continue
            begin = zlib.crc32(f"{doc}:".encode())
            for run, n in Counter(_RUN.findall(raw.to_pybytes().lower().decode())).items():  # bytes know ASCII letters only
                h = zlib.crc32(run.encode(), begin)
                if h % DELETED == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < LEAST_LENGTH:
                        continue
                held[run] += n
            if len(held) >= HELD_WORDS:
                yield out()
    if held:
        yield out()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): the words that occur often enough."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    return rows.mapInArrow(_counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    at, n = 0, min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    while n - at > 1:
        mid = (at + n) // 2
        if a[at:mid] == b[at:mid]:
            at = mid
        else:
            n = mid
    return at


@dataclass
class Place:
    """A place of the trie of one range's sorted words: its words begin at lo, its children at `starts`."""

    depth: int
    lo: int
    starts: list[int] = field(default_factory=list)
    ends: bool = False  #: word lo ends here


def places(words: list[str]) -> Iterator[tuple[Place, int]]:
    """Every place where words end or part, with the end of its words; children before their parents."""
    stack = [Place(0, 0)]
    for i, word in enumerate(words):
        depth = _shared(words[i - 1], word) if i else 0
        while stack[-1].depth > depth:
            done = stack.pop()
            yield done, i
            if stack[-1].depth < depth:
                stack.append(Place(depth, done.lo, [done.lo]))
        stack[-1].starts.append(i)
        stack.append(Place(len(word), i, ends=True))
    while stack:
        yield stack.pop(), len(words)


#: Kinds of rows that meet at a spelling: the word itself, and copies with a character replaced, skipped or inserted.
_WORD, _REPLACED, _SKIPPED, _INSERTED = range(4)


def copies(word: str, depth: int, heavy: str) -> Iterator[tuple[str, int, int]]:
    """(spelling, kind, depth) of the copies of a word that leaves the heavy path at a depth."""
    head, tail = word[:depth], word[depth:]
    if tail:
        yield head + heavy + tail[1:], _REPLACED, depth
        # of equal characters in a row only the last is skipped: there the two words part
        if len(word) > LEAST_LENGTH and tail[1:2] != tail[0]:
            yield head + tail[1:], _SKIPPED, depth
    yield head + heavy + tail, _INSERTED, depth


_CHILD = pa.struct([("char", pa.string()), ("n", pa.int64())])
_OPEN = pa.struct([("depth", pa.int64()), ("ends", pa.bool_()), ("children", pa.list_(_CHILD))])
_RANGE_SCHEMA = pa.schema([("part", pa.int32()), ("spelling", pa.string()), ("kind", pa.int32()), ("depth", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("open", pa.list_(_OPEN))])
_RANGE_DDL = "part int, spelling string, kind int, depth bigint, word string, n bigint, open array<struct<depth: bigint, ends: boolean, children: array<struct<char: string, n: bigint>>>>"


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= OUT_ROWS:
            yield out()
            held = []
    if held:
        yield out()


def _ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range's words, the copies that its own places make, and the two paths that reach into other ranges (kind null) with the children that hang on them."""
    part = TaskContext.get().partitionId()
    words: list[str] = []
    counts: list[int] = []
    for batch in batches:
        words += batch.column("word").to_pylist()
        counts += batch.column("n").to_pylist()

    def rows() -> Iterator[tuple]:
        paths: tuple[list, list] = [], []
        for word, n in zip(words, counts, strict=True):
            yield part, word, _WORD, 0, word, n, None
        for place, hi in places(words):
            runs = list(zip(place.starts, [*place.starts[1:], hi], strict=False))
            if place.lo == 0 or hi == len(words):  # it has the first or the last word
                closed = [{"char": words[a][place.depth], "n": b - a} for a, b in runs if a > 0 and b < len(words)]
                paths[hi == len(words)].append({"depth": place.depth, "ends": place.ends, "children": closed})
                continue
            if not runs:
                continue
            top = max(runs, key=lambda r: (r[1] - r[0], -r[0]))
            heavy = words[top[0]][place.depth]
            for a, b in ([(place.lo, place.lo + 1)] if place.ends else []) + [r for r in runs if r is not top]:
                for i in range(a, b):
                    for spelling, kind, depth in copies(words[i], place.depth, heavy):
                        yield part, spelling, kind, depth, words[i], counts[i], None
        for path, own in zip((words[0], words[-1]), paths, strict=True):
            if own:
                yield part, path, None, None, path, None, own[::-1]

    if words:
        yield from _batches(rows(), _RANGE_SCHEMA)


@dataclass
class Crossing:
    """A place on the paths between ranges, which the paths from number `lo` on have."""

    depth: int
    lo: int
    ends: bool = False
    children: Counter = field(default_factory=Counter)


_CROWN_SCHEMA = pa.schema([("part", pa.int32()), ("path", pa.string()), ("depth", pa.int64()), ("heavy", pa.string())])


def _crowned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The open paths of all ranges, in order: for every path, the places on it and their heavy children, counted over all ranges."""
    seen: list[tuple[int, str]] = []

    def rows() -> Iterator[tuple]:
        stack = [Crossing(0, 0)]

        def left(place: Crossing, path: str) -> Iterator[tuple]:
            if place.children and len(place.children) + place.ends > 1:
                heavy = min(place.children, key=lambda c: (-place.children[c], c))
                for part, other in seen[place.lo :]:
                    yield part, other, place.depth, heavy

        def leave(depth: int, path: str) -> Iterator[tuple]:
            while stack[-1].depth > depth:
                done = stack.pop()
                yield from left(done, path)
                if stack[-1].depth < depth:
                    stack.append(Crossing(depth, done.lo))
                stack[-1].children[path[stack[-1].depth]] += sum(done.children.values()) + done.ends

        last = ""
        for batch in batches:
            for part, path, own in zip(batch.column("part").to_pylist(), batch.column("word").to_pylist(), batch.column("open").to_pylist(), strict=True):
                yield from leave(_shared(last, path), last)
                for o in own:
                    at = len(stack)
                    while stack[at - 1].depth > o["depth"]:
                        at -= 1
                    if stack[at - 1].depth < o["depth"]:
                        stack.insert(at, Crossing(o["depth"], stack[at].lo if at < len(stack) else len(seen)))
                    else:
                        at -= 1
                    stack[at].ends |= o["ends"]
                    for child in o["children"]:
                        stack[at].children[child["char"]] += child["n"]
                seen.append((part, path))
                last = path
        yield from leave(0, last)
        yield from left(stack[0], last)

    yield from _batches(rows(), _CROWN_SCHEMA)


_COPY_SCHEMA = pa.schema([("spelling", pa.string()), ("kind", pa.int32()), ("depth", pa.int64()), ("word", pa.string()), ("n", pa.int64())])
_COPY_DDL = "spelling string, kind int, depth bigint, word string, n bigint"


def _crossing_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies of words (word, n, crossings) at the places between ranges that are on their way."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for word, n, crossings in zip(*[batch.column(c).to_pylist() for c in ("word", "n", "crossings")], strict=True):
                ways = {(x["depth"], x["heavy"]) for x in crossings if word[: x["depth"]] == x["path"][: x["depth"]]}
                for depth, heavy in ways:
                    if word[depth : depth + 1] != heavy:
                        for spelling, kind, at in copies(word, depth, heavy):
                            yield spelling, kind, at, word, n

    yield from _batches(rows(), _COPY_SCHEMA)


_MET_SCHEMA = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("best", pa.struct([("n", pa.int64()), ("word", pa.string())]))])
_MET_DDL = "word string, n bigint, n_near bigint, best struct<n: bigint, word: string>"


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What meets at each spelling, sorted by it: for each word the number of its near words there and the best of them (its count negated, so that the least is the best)."""

    def told(word: str, near: int, best: tuple[int, str]) -> tuple:
        return word, 0, near, {"n": best[0], "word": best[1]}

    def group(own: list[tuple[int, str]], others: dict[int, list[tuple[int, str]]], stars: list[tuple[int, str]]) -> Iterator[tuple]:
        for members in others.values():  # replaced at one place: all are near each other
            together = sorted(members + own)
            if len(together) > 1:
                for x in together:
                    yield told(x[1], len(together) - 1, together[1] if x is together[0] else together[0])
        if own and stars:
            yield told(own[0][1], len(stars), min(stars))
            for x in stars:
                yield told(x[1], 1, own[0])

    def rows() -> Iterator[tuple]:
        key, own, others, stars = None, [], {}, []
        for batch in batches:
            for spelling, kind, depth, word, n in zip(*[batch.column(c).to_pylist() for c in _COPY_SCHEMA.names], strict=True):
                if spelling != key:
                    yield from group(own, others, stars)
                    key, own, others, stars = spelling, [], {}, []
                if kind == _WORD:
                    own.append((-n, word))
                    yield word, n, 0, None
                elif kind == _REPLACED:
                    others.setdefault(depth, []).append((-n, word))
                else:
                    stars.append((-n, word))
        yield from group(own, others, stars)

    yield from _batches(rows(), _MET_SCHEMA)


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n, n_near, form, form_n) of a written table (word, n)."""
    spark = words.sparkSession
    chars = words.agg(F.sum(F.length("word"))).first()[0] or 0
    ranges = max(tasks_for(spark), math.ceil(chars / RANGE_CHARS))
    ranged = scratch.written(words.repartitionByRange(ranges, "word").sortWithinPartitions("word").mapInArrow(_ranged, _RANGE_DDL), "errata-ranges")
    paths = ranged.filter("kind is null").select("part", "word", "open")
    crossings = paths.repartition(1).sortWithinPartitions("word", "part").mapInArrow(_crowned, "part int, path string, depth bigint, heavy string")  # two rows a range
    crossings = scratch.written(crossings.groupBy("part").agg(F.collect_list(F.struct("path", "depth", "heavy")).alias("crossings")), "errata-crossings")
    crossing = ranged.filter(F.col("kind") == _WORD).select("part", "word", "n").join(crossings, "part").select("word", "n", "crossings").mapInArrow(_crossing_copies, _COPY_DDL)
    meeting = ranged.filter("kind is not null").select(*_COPY_SCHEMA.names).unionByName(crossing)
    met = meeting.repartition("spelling").sortWithinPartitions("spelling").mapInArrow(_met, _MET_DDL)
    found = met.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    form = -F.col("best.n") >= COMMONER * F.col("n")
    return found.select("word", "n", "n_near", F.when(form, F.col("best.word")).alias("form"), F.when(form, -F.col("best.n")).alias("form_n"))


def with_roots(found: DataFrame, scratch: Scratch) -> DataFrame:
    """The column root of a written table (word, form): the last of the forms that follow from a word, by doubling."""
    ways = found.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = scratch.written(ways.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "errata-ways")
        if not ways.filter("moved").limit(1).count():
            break
        ways = ways.drop("moved")
    return found.join(ways.drop("moved"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The words of a corpus with their near words: word, form, root, n, n_near, form_n."""
    spark = docs.sparkSession
    ship(spark)
    with Scratch(spark) as scratch:
        words = scratch.written(count_words(docs), "errata-words")
        found = scratch.written(near_words(words, scratch), "errata-found")
        return written(with_roots(found, scratch).select("word", "form", "root", "n", "n_near", "form_n"), "errata")


#: The same in DuckDB SQL. It has no CRC-32, so a table of the 256 remainders is made first; runs have one or two bytes a character.
SQL = """
WITH RECURSIVE remainders AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(0, 256) r(i)),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS named, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
coded AS (SELECT run, n, t, flatten(list_transform(string_split(named, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c)::BIGINT >> 6), 128 + (unicode(c)::BIGINT & 63)] END)) AS bytes FROM runs, remainders),
hashed AS (SELECT run, n, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM coded),
edited AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= 7 GROUP BY ALL HAVING sum(n) >= 2),
places AS (SELECT word, n, i, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
shorter AS (SELECT DISTINCT p.word AS x, p.n AS nx, w.word AS y, w.n AS ny FROM places p JOIN words w ON w.word = p.a || p.b),
pairs AS (
  SELECT p.word AS x, q.word AS y, q.n AS ny FROM places p JOIN places q ON p.i = q.i AND p.a = q.a AND p.b = q.b AND p.word <> q.word
  UNION ALL SELECT x, y, ny FROM shorter UNION ALL SELECT y, x, nx FROM shorter),
best AS (SELECT x, count(*) AS n_near, max(ny) AS top FROM pairs GROUP BY x),
firsts AS (SELECT p.x, min(p.y) AS y FROM pairs p JOIN best b ON p.x = b.x AND p.ny = b.top GROUP BY p.x),
found AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 10 * w.n THEN f.y END AS form, CASE WHEN b.top >= 10 * w.n THEN b.top END AS form_n
  FROM words w LEFT JOIN best b ON b.x = w.word LEFT JOIN firsts f ON f.x = w.word),
ways AS (SELECT word, word AS root, form FROM found UNION ALL SELECT w.word, f.word, f.form FROM ways w JOIN found f ON f.word = w.form)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM found f JOIN ways w ON w.word = f.word AND w.form IS NULL
"""
