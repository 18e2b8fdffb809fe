"""The trie of conversations by their turns, built as a Patricia tree: aggregates come from compressed edges, which are then expanded.

A conversation is a row of turn digests (MD5 of role and text) and word counts; texts are hashed where they are read and never shuffled.
Conversations are sorted by their digests, joined to one binary key, and by id, in ranges: a prefix's members are neighbours, and many copies of
one conversation spread over several ranges. Each range is one pass with a stack, which holds only the points of the
path that is being read: places where conversations branch or end. A point that leaves the stack is final unless it is on the path of
the range's first or last conversation, as only such prefixes can reach into other ranges. Those open paths, two a range at most, with
what hangs on them, are rows of a second pass of the same kind, in one task. So no task holds more than a path, whatever the sizes of groups.

A point carries the sums of all that is below it and, for each node of the edge above it, the suffix sum of saved words; expanding the edges
is one generator. Ids of parents come by a join on (point, hundredth child), so that a branch with very many children is no hot key. Lists of
ends that cross ranges are hashed from pieces in order.

Defined cases: turns without an order come first, and turns of equal order follow the role, then the digest of the text; repeated turns are turns;
null roles and texts are empty; rows without a conversation id belong to none and are left out; texts of any length cost 16 bytes; a
conversation's digests (24 bytes a turn) must fit a row; other columns, whatever their names, are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship, tasks_for, written

#: Conversations whose ids have the same quotient by this number share the first turns of its multiple; at most HEADS - 1 turns.
FAMILY, HEADS = 20, 4
#: Bytes of a turn's digest.
DIGEST = 16
#: Children of a point that share a key when they look up their parent's id.
CHILDREN = 10_000
#: Bytes of ids that are hashed or handed on at a time, and rows of a batch.
PIECE_BYTES, OUT_ROWS = 1 << 20, 2000
#: A point's id is its range's number and its own.
_SERIAL_BITS = 40


def rebuilt(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, key, words): every conversation with the first h turns of its family's first one, h = crc32(id) % HEADS, in place of its own."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.col("turn").isNotNull().alias("placed"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.md5(F.concat_ws("\n", F.octet_length(role).cast("string"), role, text).cast("binary")).alias("d"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w"))
    slim = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).filter("conv_id is not null")
    # md5 gives hexadecimal digits, so joined digests are one text; `placed` is false for turns without an order
    own = scratch.written(slim.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("conv_id", F.col("t.d").alias("d"), F.col("t.w").alias("w")), "trie-own")
    heads = own.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), *[F.slice(c, 1, HEADS - 1).alias(f"base_{c}") for c in ("d", "w")])
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    found = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": h.cast("int")}).join(heads, "base", "left")

    def grown(c: str) -> Column:
        none = F.array().cast(own.schema[c].dataType)
        first = F.when(F.col("h") > 0, F.slice(F.coalesce(f"base_{c}", none), 1, F.greatest("h", F.lit(1)))).otherwise(none)
        return F.concat(first, F.slice(c, F.col("h") + 1, F.greatest(F.size(c), F.lit(1))))

    return scratch.written(found.select("conv_id", F.unhex(F.array_join(grown("d"), "")).alias("key"), grown("w").alias("words")), "trie-rebuilt")


@dataclass
class Point:
    """A place of the path that is being read. Sums hold what has left the stack below it, and the conversations that end here."""

    depth: int
    serial: int
    n: int = 0
    first: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: int = 0
    hash: object = None
    ids: list[bytes] = field(default_factory=list)
    id_bytes: int = 0
    piece_from: int | None = None
    joined: list[tuple[int, int, int]] = field(default_factory=list)  #: points of ranges that are this one: (id, children, ends)
    end_hash: str = ""

    def add(self, n: int, first: int) -> None:
        self.n += n
        self.first = first if self.first is None else min(self.first, first)


def shared(a: bytes, b: bytes) -> int:
    """The number of turns that two keys begin with in common."""
    least, most = 0, min(len(a), len(b)) // DIGEST
    if a[: most * DIGEST] == b[: most * DIGEST]:
        return most
    while most - least > 1:
        mid = (least + most) // 2
        if a[least * DIGEST : mid * DIGEST] == b[least * DIGEST : mid * DIGEST]:
            least = mid
        else:
            most = mid
    return least


class Patricia:
    """The stack of one pass over sorted conversations. `gone(point, parent, words)` is told of every point that leaves it."""

    def __init__(self, number: int, gone):
        self.gone, self.serials = gone, number << _SERIAL_BITS
        self.key, self.words = b"", []
        self.stack = [self.point(0)]

    def point(self, depth: int) -> Point:
        self.serials += 1
        return Point(depth, self.serials)

    def turn_to(self, key: bytes, words: list[int]) -> None:
        """Leave what the next conversation doesn't share."""
        depth = shared(self.key, key)
        self.leave(depth)
        self.key, self.words = key, words

    def leave(self, depth: int) -> None:
        while self.stack[-1].depth > depth:
            point = self.stack.pop()
            parent = self.stack[-1]
            if parent.depth < depth:
                parent = self.point(depth)
                self.stack.append(parent)
            self.gone(point, parent, self.words)

    def at(self, depth: int) -> Point:
        """The path's point at a depth."""
        place = len(self.stack)
        while self.stack[place - 1].depth > depth:
            place -= 1
        if self.stack[place - 1].depth < depth:
            self.stack.insert(place, self.point(depth))
            return self.stack[place]
        return self.stack[place - 1]


def edge_sums(point: Point, above: int, words: list[int]) -> list[int]:
    """Saved words of the subtree of each node of the edge, top first: the edge's nodes have the members of its end."""
    total, out = point.saved, []
    for depth in range(point.depth, above, -1):
        total += (point.n - 1) * (words[depth - 1] if depth else 0)
        out.append(total)
    return out[::-1]


def settle(point: Point, parent: Point, sums: list[int]) -> int:
    """A final point counts for its parent. Returns its number among the parent's children."""
    point.leaves = point.leaves or 1
    parent.add(point.n, point.first)
    parent.children += 1
    parent.leaves += point.leaves
    parent.saved += sums[0]
    return parent.children - 1


#: A row is a point (with the id of the one above and its number among that one's children), an open path, or a piece of a list of ends.
_EDGE = pa.struct([("id", pa.int64()), ("above", pa.int64()), ("child", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.list_(pa.int64())), ("ends", pa.int64()), ("ends_sha256", pa.string())])
_OPEN = pa.struct([("id", pa.int64()), ("depth", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.int64()), ("ends_sha256", pa.string())])
_PATH = pa.struct([("key", pa.binary()), ("words", pa.list_(pa.int64())), ("open", pa.list_(_OPEN))])
_PIECE = pa.struct([("id", pa.int64()), ("from", pa.int64()), ("ids", pa.binary())])
_NAME = pa.struct([("id", pa.int64()), ("conv_id", pa.int64()), ("children", pa.int64()), ("whole", pa.int64())])
_SCHEMA = pa.schema([("edge", _EDGE), ("path", _PATH), ("piece", _PIECE), ("name", _NAME)])
_DDL = (
    "edge struct<id: bigint, above: bigint, child: bigint, conv_id: bigint, depth: bigint, n_convs: bigint, n_children: bigint, n_leaves: bigint, saved: array<bigint>, ends: bigint, ends_sha256: string>, "
    "path struct<key: binary, words: array<bigint>, open: array<struct<id: bigint, depth: bigint, n: bigint, first: bigint, children: bigint, leaves: bigint, saved: bigint, ends: bigint, ends_sha256: string>>>, "
    "piece struct<id: bigint, from: bigint, ids: binary>, name struct<id: bigint, conv_id: bigint, children: bigint, whole: bigint>"
)
_NO_ENDS = hashlib.sha256(b"").hexdigest()


class Out:
    """Rows on their way to Spark, a batch at a time."""

    def __init__(self):
        self.rows: list[tuple] = []

    def put(self, kind: str, *values) -> None:
        self.rows.append(tuple(values if n == kind else None for n in _SCHEMA.names))

    def edge(self, p: Point, above: int | None, child: int, sums: list[int], ends_sha256: str | None) -> None:
        self.put("edge", p.serial, above, child, p.first, p.depth, p.n, p.children, p.leaves, sums, p.ends, ends_sha256)

    def batches(self, least: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
        if self.rows and len(self.rows) >= least:
            arrays = [pa.array([r and dict(zip([f.name for f in t.type], r, strict=True)) for r in column], t.type) for t, column in zip(_SCHEMA, zip(*self.rows, strict=True), strict=True)]
            self.rows = []
            yield pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)


def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of sorted conversations: final points, the open paths, and pieces of lists of ends."""
    out, first, common, open_first = Out(), None, 0, []

    def gone(point: Point, parent: Point, words: list[int]) -> None:
        if point.depth <= common:  # on the first conversation's path
            open_first.append(told(point))
            return
        sums = edge_sums(point, parent.depth, words)
        child = settle(point, parent, sums)
        out.edge(point, parent.serial, child, sums, point.hash.hexdigest() if point.ends else _NO_ENDS)
        if point.children:
            out.put("name", point.serial, point.first, point.children, None)

    def cut(point: Point) -> None:
        out.put("piece", point.serial, point.piece_from, b",".join(point.ids))
        point.ids, point.id_bytes, point.piece_from = [], 0, None

    def told(p: Point) -> dict:
        if p.ids:
            cut(p)
        return {"id": p.serial, "depth": p.depth, "n": p.n, "first": p.first, "children": p.children, "leaves": p.leaves, "saved": p.saved, "ends": p.ends, "ends_sha256": p.hash.hexdigest() if p.ends else None}

    tree, first_words = Patricia(TaskContext.get().partitionId(), gone), None
    for batch in batches:
        for conv, key, words in zip(batch.column("conv_id").to_pylist(), batch.column("key").to_pylist(), batch.column("words").to_pylist(), strict=True):
            if first is None:
                first, first_words, common = key, words, len(key) // DIGEST
            if tree.key != key or not tree.words:
                tree.turn_to(key, words)
                common = min(common, shared(first, key))
            end = tree.at(len(key) // DIGEST)
            digits = str(conv).encode()
            if not end.ends:
                end.hash = hashlib.sha256(digits)
            else:
                end.hash.update(b"," + digits)
            end.add(1, conv)
            end.ends += 1
            end.piece_from = conv if end.piece_from is None else end.piece_from
            end.ids.append(digits)
            end.id_bytes += len(digits)
            if end.id_bytes >= PIECE_BYTES:
                cut(end)
            yield from out.batches()
    if first is not None:
        if open_first:
            out.put("path", first, first_words, open_first[::-1])
        out.put("path", tree.key, tree.words, [told(p) for p in tree.stack])
        yield from out.batches(1)


def crown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The open paths of all ranges, in order: their points, and which point of a range is which of them."""
    out = Out()

    def gone(point: Point, parent: Point | None, words: list[int]) -> None:
        sums = edge_sums(point, parent.depth if parent else -1, words)
        child = settle(point, parent, sums) if parent else 0
        parts = [x for x in point.joined if x[2]]
        whole = len(parts) < 2  # else the list of ends is in pieces of several ranges
        out.edge(point, parent.serial if parent else None, child, sums, _NO_ENDS if not parts else point.end_hash if whole else None)
        for serial, children, ends in point.joined:
            out.put("name", serial, point.first, children, None if whole or not ends else point.serial)
        out.put("name", point.serial, point.first, point.children, None)

    # ids of this pass must differ from those of the ranges
    tree = Patricia(1 << 20, gone)
    seen = False
    for batch in batches:
        for path in batch.column("path").to_pylist():
            seen = True
            tree.turn_to(path["key"], path["words"])
            for o in path["open"]:
                point = tree.at(o["depth"])
                if o["n"]:
                    point.add(o["n"], o["first"])
                point.children += o["children"]
                point.leaves += o["leaves"]
                point.saved += o["saved"]
                point.ends += o["ends"]
                point.end_hash = o["ends_sha256"] or point.end_hash
                point.joined.append((o["id"], o["children"], o["ends"]))
            yield from out.batches()
    if seen:
        tree.leave(0)
        root = tree.stack[0]
        root.leaves = root.leaves or 1
        gone(root, None, tree.words)
        yield from out.batches(1)


def hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (id, from, ids), sorted: the SHA-256 of each id's whole list."""
    key, digest, done = None, None, []
    for batch in batches:
        for k, ids in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(ids)
            else:
                digest.update(b"," + ids)
    if key is not None:
        done.append((key, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], ["id", "whole_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each distinct sequence of first turns of the rebuilt conversations, the root included.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    """
    spark = conversations.sparkSession
    ship(spark)
    with Scratch(spark) as scratch:
        ranges = rebuilt(conversations, scratch).repartitionByRange(tasks_for(spark), "key", "conv_id").sortWithinPartitions("key", "conv_id")
        built = scratch.written(ranges.mapInArrow(build, _DDL), "trie-built")
        # two rows a range
        paths = built.filter("path is not null").select("path").repartition(1).sortWithinPartitions("path.key")
        tops = scratch.written(paths.mapInArrow(crown, _DDL), "trie-crown")

        wholes = tops.filter("name.whole is not null").select(F.col("name.id").alias("part"), F.col("name.whole").alias("id"))
        pieces = built.filter("piece is not null").select(F.col("piece.id").alias("part"), "piece.from", "piece.ids").join(wholes, "part")
        hashed = pieces.select("id", "from", "ids").repartition("id").sortWithinPartitions("id", "from").mapInArrow(hash_pieces, "id bigint, whole_sha256 string")
        edges = tops.filter("edge is not null").select("edge.*").join(hashed, "id", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", "whole_sha256")).drop("whole_sha256")
        edges = edges.unionByName(built.filter("edge is not null").select("edge.*"))

        names = built.filter("name is not null").select("name.*").unionByName(tops.filter("name is not null").select("name.*")).filter("children > 0")
        names = names.select(F.col("id").alias("above"), F.col("conv_id").alias("above_conv_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(children - 1) div {CHILDREN}"))).alias("part"))
        edges = edges.withColumn("part", F.expr(f"child div {CHILDREN}")).join(names, ["above", "part"], "left")
        nodes = edges.select("*", F.posexplode("saved").alias("at", "saved_tokens")).withColumn("last", F.col("at") == F.size("saved") - 1)
        out = nodes.select(
            "conv_id", (F.col("depth") - F.size("saved") + 1 + F.col("at")).cast("long").alias("depth"), F.when(F.col("at") == 0, F.col("above_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
            F.when(F.col("last"), F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.when(F.col("last"), F.col("ends_sha256")).otherwise(F.lit(_NO_ENDS)).alias("ends_sha256"),
        )
        return written(out, "trie")


#: The same in DuckDB SQL. It has no CRC-32, so a table of the 256 remainders is made first. A sequence is named by the SHA-256 chain of its turns.
SQL = r"""
WITH RECURSIVE remainders AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(0, 256) r(i)),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS nth, sha256(strlen(coalesce(role, '')) || ' ' || coalesce(role, '') || coalesce(text, '')) AS d,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base FROM turns),
kept AS (SELECT conv_id, base, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 4 AS h FROM ids, remainders),
built AS (
  SELECT k.conv_id, t.nth, t.d, t.w FROM kept k JOIN turns t ON t.conv_id = k.base AND t.nth <= k.h
  UNION ALL SELECT k.conv_id, t.nth + 1000000000, t.d, t.w FROM kept k JOIN turns t ON t.conv_id = k.conv_id AND t.nth > k.h),
placed AS (SELECT conv_id, d, w, row_number() OVER (PARTITION BY conv_id ORDER BY nth) AS depth FROM built),
path AS (
  SELECT conv_id, 0::BIGINT AS depth, '' AS node, '' AS above, 0 AS w FROM ids
  UNION ALL SELECT p.conv_id, q.depth, sha256(p.node || q.d), p.node, q.w FROM path p JOIN placed q ON q.conv_id = p.conv_id AND q.depth = p.depth + 1),
ends AS (SELECT conv_id, arg_max(node, depth) AS node FROM path GROUP BY conv_id),
listed AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM ends GROUP BY node),
nodes AS (SELECT node, any_value(above) AS above, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w FROM path GROUP BY node),
children AS (SELECT above, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above),
below AS (SELECT DISTINCT a.node AS top, b.node FROM path a JOIN path b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
sums AS (SELECT b.top, count(*) FILTER (c.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.w)::BIGINT AS saved_tokens FROM below b JOIN nodes n ON n.node = b.node LEFT JOIN children c ON c.above = b.node GROUP BY b.top)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(l.ids, '')) AS ends_sha256
FROM nodes n JOIN sums s ON s.top = n.node LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.above LEFT JOIN children c ON c.above = n.node LEFT JOIN listed l ON l.node = n.node
"""
