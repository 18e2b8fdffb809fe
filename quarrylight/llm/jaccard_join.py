"""N-gram Jaccard self-join with a count-vector R-tree.

Each text becomes the set of its word k-shingles (64-bit hashes). The hashes fall into GROUPS groups; the counts
of a set in each group are a point, and the sum over the groups of the smaller of two counts bounds the overlap
of two sets from above. A larger set has more groups (a power of two, so that counts of more groups fold onto fewer): with
a fixed number, chance differences would vanish in the slack that long texts have. Work in stages, each a Spark job over compact rows:

1. One pass over the texts gives a digest of the set, its size, its point and its prefix: sets that link share one
   of the first n - ceil(t n) + 1 members under any common order. The order puts members that a bounded sample
   finds frequent last; it changes the work, never the result. Equal sets (by 128 bits) become one class, with a number.
2. Classes that share a prefix member meet. Of two sets that link the first n - needed + s members of each, n its size, share s
   or more (as many as lie in the prefixes, SHARED at most). So of a meeting whose sizes and places leave few such pairs
   only the pairs go on, those that meet s times or more, each in one meeting. Pairs that share shingles by chance, whose number
   grows faster than the texts', end here, before points are joined. An R-tree over the points (LEAF points or boxes to a box,
   level on level) answers, for each point, which points of other branches can reach the needed overlap; a union-find keeps
   the spanning links only.
3. Connected candidates come together with their whole sets, and pairs that the R-tree passes are verified exactly,
   again only between branches that aren't connected yet.
4. Connected verified links are the components.

A meeting of more than MEETING classes, or a candidate group of more than HELD shingles, is dealt to parts. Each part links its
own members and one pivot of the whole; members that aren't connected with the pivot are then held against every other part,
the rest needs no more links. So a large group of near copies costs about what its members cost; only groups that hang
together by candidate links alone cost more (those members times the parts). Shingles that the sample finds in HOT_SHARE of the
texts are dealt to parts before they are gathered.

No stage lists all pairs of a group: links are spanning links, one less than the texts that they connect.

Defined cases: null or empty texts and texts without words have an empty set and link with nothing (component: their
own doc_id); texts with fewer than k words have one shingle of all their words; texts of any length take part whole; repeated rows
share a component; null doc_ids count in no minimum; an empty table gives an empty result; other columns, whatever their names,
are left out. A component's representative is its row with the smallest (doc_id, SHA-256 of the text), null doc_ids last; ids alone
need not tell its rows apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, as_long, buffers, chunks, lists, mix, sha_of, ship, shingles, tasks_for, text_of, word_hashes, word_spans, written
from .components import components

GROUPS, MOST_GROUPS, LEAF = 32, 4096, 16
#: Members of a set for each of its groups, once it has more than GROUPS.
A_GROUP = 16
#: Rows of the sample that finds frequent shingles, how many texts of it make one frequent, and how many are kept.
SAMPLE_ROWS, FREQUENT, MOST_FREQUENT = 20_000, 12, 200_000
#: Share of the sampled texts from which a shingle is hot: at most its inverse times the shingles of a prefix are.
HOT_SHARE, MOST_HOT = 0.01, 10_000
#: Classes that meet in one part; shingles of whole sets that one part holds.
MEETING, HELD = 20_000, 2_000_000
#: Rows, and shingles of whole sets, of small groups that a task takes together; a larger group is a run of its own.
RUN_ROWS, RUN_SHINGLES = 4_000, 250_000
#: Classes, and pairs for each of them, of a meeting that goes on as pairs; prefix members that such a pair is asked to share at most; pairs that are looked at together.
PAIRED, PAIRS_EACH, SHARED, PAIR_RUN = 512, 4, 8, 500_000


def needed(num: int, den: int, n: np.ndarray) -> np.ndarray:
    """Least overlap of two sets of together n members with overlap / union >= num / den."""
    return -(-num * n // (num + den))


def sets_of(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and the index of each text's first."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, off)
    h, text = shingles(word_hashes(data, starts, ends), first, k)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(off)))


def points_of(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group counts of each set, flat, and the index of each set's first group."""
    n = np.diff(first)
    groups = np.clip(2.0 ** np.ceil(np.log2(np.maximum(n, 1) / A_GROUP)), GROUPS, MOST_GROUPS).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(groups)])
    text = np.repeat(np.arange(len(n)), n)
    at = start[text] + ((h >> np.uint64(40)).astype(np.int64) & (groups[text] - 1))
    return np.bincount(at, minlength=start[-1]).astype(np.int32), start


class Points:
    """Group counts of a run of sets, and bounds on the overlap of pairs of them."""

    def __init__(self, flat: np.ndarray, first: np.ndarray):
        self.flat, self.first, self.groups = flat, first, np.diff(first)
        self.base = np.zeros((len(self.groups), GROUPS), np.int32)
        for g in np.unique(self.groups).tolist():
            rows = np.flatnonzero(self.groups == g)
            self.base[rows] = self._folded(rows, g, GROUPS)
        self.size = self.base.sum(1)

    def _folded(self, rows: np.ndarray, g: int, to: int) -> np.ndarray:
        return self.flat[self.first[rows][:, None] + np.arange(g)].reshape(len(rows), g // to, to).sum(1)

    def subset(self, lo: int, hi: int) -> Points:
        return Points(self.flat[self.first[lo] : self.first[hi]], self.first[lo : hi + 1] - self.first[lo])

    def passing(self, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
        """Which pairs may reach the needed overlap: by the base groups first, then by as many as both sets have."""
        need = needed(num, den, self.size[a] + self.size[b])
        ok = np.minimum(self.size[a], self.size[b]) >= need
        at = np.flatnonzero(ok)
        ok[at] = np.minimum(self.base[a[at]], self.base[b[at]]).sum(1) >= need[at]
        at = np.flatnonzero(ok & (np.minimum(self.groups[a], self.groups[b]) > GROUPS))
        kind = self.groups[a[at]] * (2 * MOST_GROUPS) + self.groups[b[at]]
        for k in np.unique(kind).tolist():
            ga, gb = divmod(k, 2 * MOST_GROUPS)
            same = at[kind == k]
            for lo in range(0, len(same), 256):
                p = same[lo : lo + 256]
                to = min(ga, gb)
                ok[p] = np.minimum(self._folded(a[p], ga, to), self._folded(b[p], gb, to)).sum(1) >= need[p]
        return ok


class RTree:
    """Points packed by size and then by their first coordinates, LEAF to a box and LEAF boxes to a box above, for overlap searches."""

    def __init__(self, points: Points):
        self.points = points
        self.order = np.lexsort((points.base[:, 1], points.base[:, 0], points.size))
        high, low = points.base[self.order], points.size[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # of each level the largest coordinates and the least size in a box
        while len(high) > 1 or not self.levels:
            at = np.arange(0, len(high), LEAF)
            high, low = np.maximum.reduceat(high, at, axis=0), np.minimum.reduceat(low, at)
            self.levels.append((high, low))

    def search(self, i: int, ok: np.ndarray, num: int, den: int) -> np.ndarray:
        """Points among `ok` (flags) whose bound with point i reaches the needed overlap."""
        p, boxes = self.points, np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low = self.levels[depth]
            boxes = boxes[np.minimum(high[boxes], p.base[i]).sum(1) >= needed(num, den, p.size[i] + low[boxes])]
            inside = (boxes[:, None] * LEAF + np.arange(LEAF)).ravel()
            boxes = inside[inside < (len(self.levels[depth - 1][0]) if depth else len(self.order))]
        found = self.order[boxes]
        found = found[ok[found]]
        return found[p.passing(np.full(len(found), i), found, num, den)]


def spanning(points: Points, num: int, den: int, verify=None, queries: int | None = None) -> list[tuple[int, int]]:
    """Links between points that aren't connected yet. verify(i, js) keeps the true ones; queries: only from the first so many points to the others."""
    m = len(points.size)
    tree, label, out = RTree(points), np.arange(m), []
    for i in range(m if queries is None else queries):
        ok = label != label[i]
        ok[: i + 1 if queries is None else queries] = False
        if not ok.any():
            continue
        js = tree.search(i, ok, num, den)
        if len(js) and verify is not None:
            js = verify(i, js)
        for j in js.tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def _small_meetings(points: Points, first: np.ndarray, rows: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within many small meetings at once: those whose bound passes. rows: the points of the meetings, in order."""
    out_a, out_b = [], []
    counts = np.diff(first)
    for m in np.unique(counts[counts > 1]).tolist():
        at = first[:-1][counts == m]
        for i in range(m):
            for j in range(i + 1, m):
                a, b = rows[at + i], rows[at + j]
                ok = points.passing(a, b, num, den)
                out_a.append(a[ok])
                out_b.append(b[ok])
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, np.int64),) * 2


def frequent_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, list[int]]:
    """Shingles that many distinct texts of a bounded hash sample hold, up to MOST_FREQUENT, and those of them that are hot."""
    rows = docs.count()
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    sample = text_of(docs, "doc_id").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    sample = sample.groupBy(F.xxhash64("text")).agg(F.first("text").alias("text")).select("text")
    schema = pa.schema([("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, off in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(as_long(sets_of(data, off, k)[0]))], schema=schema)

    found = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT)
    top = found.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).collect()
    hot = [r["h"] for r in top[:MOST_HOT] if r["n"] >= max(FREQUENT, HOT_SHARE * min(rows, SAMPLE_ROWS))]
    return np.sort(np.array([r["h"] for r in top], np.int64).view(np.uint64)), hot


def set_rows(docs: DataFrame, k: int, num: int, den: int, late: np.ndarray, scratch: Scratch) -> DataFrame:
    """doc_id, t (SHA-256 of the text), s1, s2 (set digest), n, prefix and point of each row; late: shingles that come last in prefixes."""
    frequent = docs.sparkSession.sparkContext.broadcast(late)  # at most MOST_FREQUENT hashes
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.binary()), ("s1", pa.int64()), ("s2", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())), ("point", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = frequent.value
        bits = np.zeros(1 << 20, bool)
        bits[(late & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for rows, data, off in chunks(batches):
            h, first = sets_of(data, off, k)
            n = np.diff(first)
            text = np.repeat(np.arange(len(n)), n)
            digest = []
            for salt in (0x51ED270B, 0xC2B2AE3D27D4EB4F):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64)])
                digest.append(as_long(mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64))))
            last = bits[h & np.uint64((1 << 20) - 1)]
            at = np.flatnonzero(last)
            last[at] = np.isin(h[at], late)
            order = np.lexsort((h, last, text)) if len(at) else np.arange(len(h))
            take = np.where(n > 0, n - -(-num * n // den) + 1, 0)
            place = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(take)[:-1]]), take) + np.arange(take.sum())
            prefix = as_long(np.ascontiguousarray(h[order][place]))
            points, point_first = points_of(h, first)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("t"), pa.array(digest[0]), pa.array(digest[1]), pa.array(n), lists(prefix, np.concatenate([[0], np.cumsum(take)]), pa.int64()), lists(points, point_first, pa.int32())], schema=schema
            )

    source = text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).select("doc_id", sha_of("text").alias("t"), "text")
    return scratch.written(source.mapInArrow(run, "doc_id long, t binary, s1 long, s2 long, n long, prefix array<long>, point array<int>"), "sets")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int, weigh: str | None = None) -> Iterator[pa.Table]:
    """Sorted batches cut into tables of whole groups, of about `rows` rows (or sum of `weigh`)."""
    held: list[pa.RecordBatch] = []
    weight = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        weight += int(np.sum(batch.column(weigh).to_numpy())) if weigh else batch.num_rows
        if weight < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(table.num_rows, bool)
        for key in keys:
            same &= table.column(key).to_numpy() == table.column(key)[-1].as_py()
        cut = int(np.argmax(same))
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        weight = int(np.sum(table.slice(cut).column(weigh).to_numpy())) if weigh else table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for key in keys:
        x = table.column(key).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(pairs: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=_LINK)


class Members:
    """Nodes of one group with what they are compared by: points, and whole sets where there are any."""

    def __init__(self, table: pa.Table, lo: int, hi: int, first: list[int], num: int, den: int):
        """Rows lo to hi of a table; nodes of the list `first` come first. A node may stand in several rows."""
        node, at = np.unique(table.column("node").to_numpy()[lo:hi], return_index=True)
        head = np.isin(node, first)
        order = np.concatenate([np.flatnonzero(head), np.flatnonzero(~head)])
        self.node, self.num, self.den = node[order], num, den
        rows = pa.array(at[order] + lo)
        if "members" in table.column_names:
            raw, off = buffers(table.column("members").take(rows))
            sets, self.start = np.ascontiguousarray(raw).view(np.uint64), off // 8
            ids, self.member = np.unique(sets, return_inverse=True)
            self.n, self.flags = np.diff(self.start), np.zeros(len(ids), bool)
            self.points, self.verify = Points(*points_of(sets, self.start)), self._true
        else:
            held = table.column("point").take(rows)
            held = held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held
            self.points, self.verify = Points(held.flatten().to_numpy(), held.offsets.to_numpy().astype(np.int64) - held.offsets[0].as_py()), None

    def _true(self, i: int, js: np.ndarray) -> np.ndarray:
        """Those of js that link with i, by their whole sets."""
        own = self.member[self.start[i] : self.start[i + 1]]
        self.flags[own] = True
        count = self.n[js]
        begins = np.cumsum(count) - count
        place = np.repeat(self.start[js] - begins, count) + np.arange(count.sum())
        both = np.add.reduceat(self.flags[self.member[place]].astype(np.int64), begins)
        self.flags[own] = False
        return js[both * self.den >= self.num * (count + self.n[i] - both)]

    def links(self, queries: int | None = None) -> np.ndarray:
        """Spanning links as two rows of places."""
        return np.array(spanning(self.points, self.num, self.den, self.verify, queries), np.int64).reshape(-1, 2).T


def _grouped(rows: DataFrame, payload: DataFrame, num: int, den: int, weigh: str | None, size: int) -> DataFrame:
    """Spanning links within each group (g) of rows (g, node). Small groups are taken in runs, which needn't hold as much as the largest group."""
    size = min(size, RUN_SHINGLES if weigh else RUN_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ["g"], size, weigh):
            first = _starts(table, ["g"])
            counts, out = np.diff(first), []
            leaf = (counts <= LEAF) & ("point" in table.column_names)  # a tree of one box: all its points are tested
            if leaf.any():
                held = table.column("point").combine_chunks()
                points = Points(held.flatten().to_numpy(), held.offsets.to_numpy().astype(np.int64) - held.offsets[0].as_py())
                a, b = _small_meetings(points, np.concatenate([[0], np.cumsum(counts[leaf])]), np.flatnonzero(np.repeat(leaf, counts)), num, den)
                node = table.column("node").to_numpy()
                out.append(np.stack([node[a], node[b]]))
            for g in np.flatnonzero(~leaf & (counts > 1)):
                m = Members(table, first[g], first[g + 1], [], num, den)
                out.append(m.node[m.links()])
            yield _links([np.unique(np.concatenate(out, axis=1), axis=1)] if out else [])

    held = rows.join(payload, "node")
    return held.repartition("g").sortWithinPartitions("g", "node").mapInArrow(run, "a long, b long")


def _parted(rows: DataFrame, payload: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """The same for groups that are dealt to parts: rows (g, part, node)."""
    pivots = rows.groupBy("g").agg(F.min("node").alias("node"))
    parts = rows.select("g", "part").distinct()
    asked = rows.withColumn("role", F.lit(0)).unionByName(parts.join(pivots, "g").withColumn("role", F.lit(1)))
    keys = ["g", "part"]
    schema = pa.schema([("g", pa.int64()), ("part", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, int, int, list[int]]]:
        for table in _runs(batches, keys, 1):
            first, role, node = _starts(table, keys), table.column("role").to_numpy(), table.column("node").to_numpy()
            for lo, hi in zip(first, first[1:], strict=False):
                yield table, lo, hi, node[lo:hi][role[lo:hi] == 1].tolist()

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of each part and the pivot, and with a null in b the nodes that aren't connected with the pivot."""
        for table, lo, hi, head in groups(batches):
            m = Members(table, lo, hi, head, num, den)
            a, b = m.links()
            label = np.arange(len(m.node))
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                label[label == label[j]] = label[i]
            rest = m.node[label != label[0]]
            n = len(a) + len(rest)
            key = [pa.array(np.full(n, table.column(k)[int(lo)].as_py(), np.int64)) for k in keys]
            yield pa.RecordBatch.from_arrays([*key, pa.array(np.concatenate([m.node[a], rest])), pa.array([*m.node[b].tolist(), *[None] * len(rest)], pa.int64())], schema=schema)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links from the asking nodes to the members of each part."""
        for table, lo, hi, head in groups(batches):
            m = Members(table, lo, hi, head, num, den)
            yield _links([m.node[m.links(len(head))]])

    order = [*keys, "node"]
    held = asked.join(payload, "node").repartition(*keys).sortWithinPartitions(*order)
    found = scratch.written(held.mapInArrow(within, "g long, part long, a long, b long"), "parted")
    rest = found.filter("b is null").select("g", F.col("part").alias("own"), F.col("a").alias("node"))
    links = found.filter("b is not null").select("a", "b")
    if not rest.limit(1).count():
        return links
    elsewhere = rest.join(parts, "g").filter("part <> own").select("g", "part", "node", F.lit(1).alias("role"))
    asked = rows.join(elsewhere.select("g", "part").distinct(), keys, "left_semi").withColumn("role", F.lit(0)).unionByName(elsewhere)
    held = asked.join(payload, "node").repartition(*keys).sortWithinPartitions(*order)
    return links.unionByName(held.mapInArrow(across, "a long, b long"))


_MET = pa.schema([("g", pa.int64()), ("salt", pa.int32()), ("part", pa.int64()), ("node", pa.int64()), ("other", pa.int64()), ("least", pa.int32())])


def least_shared(num: int, den: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many members two sets of a and b members that link share at least among the first a (or b) - needed + as many; 0: their sizes don't allow a link.

    That many of the common members, in the common order, have all but so many of the needed ones behind them. They lie in both prefixes of n - ceil(t n) + 1 members.
    """
    need = needed(num, den, a + b)
    return np.where(np.minimum(a, b) >= need, np.clip(need - -(-num * np.maximum(a, b) // den) + 1, 1, SHARED), 0)


def _pairs(node: np.ndarray, n: np.ndarray, at: np.ndarray, first: np.ndarray, m: int, num: int, den: int) -> tuple[np.ndarray, ...]:
    """Of meetings of m rows that begin at `first`: the meeting, both rows and the least shared members of each pair whose sizes and places allow a link."""
    i, j = np.triu_indices(m, 1)
    meets, a, b = np.repeat(np.arange(len(first)), len(i)), (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
    ok = np.flatnonzero(den * np.minimum(n[a], n[b]) >= num * np.maximum(n[a], n[b]))
    meets, a, b = meets[ok], a[ok], b[ok]
    least = least_shared(num, den, n[a], n[b])
    need = needed(num, den, n[a] + n[b])
    ok = np.flatnonzero((least > 0) & (at[a] < n[a] - need + least) & (at[b] < n[b] - need + least))
    return meets[ok], a[ok], b[ok], least[ok]


def _meetings(classes: DataFrame, hot: list[int], num: int, den: int, meeting: int, scratch: Scratch) -> DataFrame:
    """(g: prefix member, salt, part, node) of the members that several classes share; hot ones are dealt by salt (else -1) and all kept.

    Of members that leave few pairs the pairs (g, node, other, least: see least_shared) in place of the rows.
    """
    spark = classes.sparkSession
    met = classes.select("node", "n", F.posexplode("prefix").alias("at", "g"))
    table = spark.createDataFrame([(h,) for h in hot], "g long").withColumn("hot", F.lit(True))  # at most MOST_HOT rows
    met = met.join(F.broadcast(table), "g", "left")
    met = met.select("g", F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(tasks_for(spark)))).otherwise(-1).cast("int").alias("salt"), "node", "n", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams over sorted rows and keeps at most PAIRED of them: a meeting that may go on as pairs waits for the next batch."""
        key, seen, held = None, 0, None

        def placed(g, salt, node, nth, take) -> pa.RecordBatch:
            none = pa.nulls(int(take.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(g[take]), pa.array(salt[take]), pa.array(nth[take] // meeting), pa.array(node[take]), none, none.cast(pa.int32())], schema=_MET)

        def paired(g, node, n, at, begins, counts) -> Iterator[pa.RecordBatch]:
            """Sets in `counts` the meetings of few pairs, which it gives, to 0."""
            for m in np.unique(counts[(counts > 1) & (counts <= PAIRED)]).tolist():
                same = np.flatnonzero(counts == m)
                for some in np.array_split(same, -(-len(same) * m * m // (2 * PAIR_RUN))):
                    meets, a, b, least = _pairs(node, n, at, begins[some], m, num, den)
                    few = np.bincount(meets, minlength=len(some)) <= PAIRS_EACH * m
                    counts[some[few]] = 0
                    a, b, least = a[few[meets]], b[few[meets]], least[few[meets]]
                    low, high, zero = np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), np.zeros(len(a), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(g[a]), pa.array((zero - 1).astype(np.int32)), pa.array(zero), pa.array(low), pa.array(high), pa.array(least.astype(np.int32))], schema=_MET)

        def told(g, salt, node, n, at, carried: int) -> Iterator[pa.RecordBatch]:
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (salt[1:] != salt[:-1])
            run_of, begins = np.cumsum(new) - 1, np.flatnonzero(new)
            nth = np.arange(len(g)) - begins[run_of] + np.where(run_of == 0, carried, 0)
            counts = np.diff(np.append(begins, len(g)))
            counts[(counts == 1) & (salt[begins] < 0)] = 0
            counts[salt[begins] >= 0] = PAIRED + 1
            if carried:
                counts[0] = PAIRED + 1
            yield from paired(g, node, n, at, begins, counts)
            yield placed(g, salt, node, nth, counts[run_of] > 0)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy() for c in ("g", "salt", "node", "n", "at")]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            g, salt = rows[:2]
            last = int(np.argmax((g == g[-1]) & (salt == salt[-1])))
            carried = seen if held is None and key == (g[0], salt[0]) else 0
            ended, held = rows, None
            if salt[-1] < 0 and len(g) - last <= PAIRED and not (carried and not last):
                ended, held = [x[:last] for x in rows], [x[last:] for x in rows]
            key, seen = (g[-1], salt[-1]), len(g) - last + (0 if last else carried)
            if len(ended[0]):
                yield from told(*ended, carried)
        if held is not None:
            yield from told(*held, 0)

    return scratch.written(met.repartition("g", "salt").sortWithinPartitions("g", "salt").mapInArrow(run, "g long, salt int, part long, node long, other long, least int"), "meetings")


def _met_often(met: DataFrame) -> DataFrame:
    """Rows (g, node) of the pairs that meet often enough, each in one meeting. Pairs of which a meeting went on as rows are found there."""
    pairs = met.filter("other is not null").groupBy("node", "other").agg(F.count(F.lit(1)).alias("shared"), F.max("least").alias("least"), F.min("g").alias("g"))
    return pairs.filter("shared >= least").select("g", F.explode(F.array("node", "other")).alias("node")).distinct()


def candidate_links(met: DataFrame, classes: DataFrame, num: int, den: int, meeting: int, scratch: Scratch) -> DataFrame:
    """Spanning links (a, b) between classes that can link; met: their meetings."""
    payload = classes.select("node", "point")
    often, met = _met_often(met), met.filter("other is null").select("g", "salt", "part", "node")
    # hot members were dealt whatever they hold; only meetings that exceed one part are parted
    seen = met.filter("part > 0 or salt >= 0").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("salt").alias("salt"))
    size = F.when(F.col("salt") < 0, F.col("n") + meeting).otherwise(F.col("n"))
    large = scratch.written(seen.filter(size > meeting).select("g", F.ceil(size / meeting).alias("parts")), "large-meetings")
    if large.limit(1).count():
        parted = met.join(large, "g").select("g", F.pmod(F.xxhash64("node"), "parts").alias("part"), "node")
        small = _grouped(met.join(large, "g", "left_anti").select("g", "node").unionByName(often), payload, num, den, None, meeting)
        links = small.unionByName(_parted(parted, payload, num, den, scratch))
    else:
        links = _grouped(met.select("g", "node").unionByName(often), payload, num, den, None, meeting)
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified_links(docs: DataFrame, classes: DataFrame, groups: DataFrame, k: int, num: int, den: int, held: int, scratch: Scratch) -> DataFrame:
    """Spanning true links (a, b) within each group (node, root) of connected candidates."""
    named = groups.join(classes.select("node", "doc_id", "t", "n"), "node")
    texts = text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).withColumn("t", sha_of("text"))
    found = texts.join(named.select("node", "doc_id", "t"), (texts["t"] == named["t"]) & texts["doc_id"].eqNullSafe(named["doc_id"])).select("node", "text")
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("members", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches):
            h, first = sets_of(data, off, k)
            members = pa.Array.from_buffers(pa.large_binary(), rows.num_rows, [None, pa.py_buffer((first * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(h))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("node"), pa.array(np.diff(first)), members], schema=schema)

    payload = scratch.written(found.mapInArrow(sets, "node long, n long, members binary"), "candidate-sets")
    sizes = named.groupBy("root").agg(F.ceil(F.sum("n") / held).alias("parts"))
    rows = groups.join(sizes, "root").select(F.col("root").alias("g"), "parts", F.pmod(F.xxhash64("node"), "parts").alias("part"), "node")
    rows = scratch.written(rows, "candidate-groups")
    links = _grouped(rows.filter("parts = 1").select("g", "node"), payload, num, den, "n", held)
    if rows.filter("parts > 1").limit(1).count():
        links = links.unionByName(_parted(rows.filter("parts > 1").select("g", "part", "node"), payload.select("node", "members"), num, den, scratch))
    return links


def jaccard_components(docs: DataFrame, k: int, num: int, den: int, meeting: int = MEETING, held: int = HELD, hot: list[int] | None = None) -> DataFrame:
    """doc_id, t (SHA-256 of the text), n_shingles, component_id and component_t of every row; sets link when overlap / union >= num / den.

    (component_id, component_t) are the doc_id and t of the component's representative. hot: shingles to treat as hot, if not the sample's.
    """
    ship(docs.sparkSession)
    first_of = lambda name: F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t")).alias(name)
    with Scratch(docs.sparkSession) as scratch:
        late, found_hot = frequent_shingles(docs, k)
        rows = set_rows(docs, k, num, den, late, scratch)
        classes = rows.filter("n > 0").groupBy("s1", "s2").agg(first_of("r"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("point").alias("point"))
        classes = scratch.written(classes.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", F.col("r.doc_id").alias("doc_id"), F.col("r.t").alias("t"), "n", "prefix", "point"), "classes")
        sets, rows = rows, scratch.written(rows.drop("prefix", "point"), "rows")
        scratch.drop(sets)
        met = _meetings(classes, found_hot if hot is None else hot, num, den, meeting, scratch)
        whole, classes = classes, scratch.written(classes.drop("prefix"), "points")
        scratch.drop(whole)
        groups = components(candidate_links(met, classes, num, den, meeting, scratch))
        found = components(verified_links(docs, classes, groups, k, num, den, held, scratch))
        ids = found.join(classes.select("node", "doc_id", "t"), "node")
        ids = ids.join(ids.groupBy("root").agg(first_of("c")), "root").select("node", "c")
        own = F.struct(F.col("doc_id").isNull(), "doc_id", "t")
        classes = classes.select("node", "s1", "s2", "doc_id", "t").join(ids, "node", "left").select("s1", "s2", F.coalesce("c", own).alias("c"))
        out = rows.select("doc_id", "t", "s1", "s2", F.col("n").alias("n_shingles")).join(classes, ["s1", "s2"], "left")
        of = lambda name: F.when(F.col("n_shingles") > 0, F.col(f"c.{name}")).otherwise(F.col(name)).alias(f"component_{name.removeprefix('doc_')}")
        return written(out.select("doc_id", "t", "n_shingles", of("doc_id"), of("t")), "jaccard")


#: The four-word, 0.85 join in DuckDB: all pairs, then reachability. For small tables.
SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM d),
x AS (SELECT r, len(s) AS n, unnest(s) AS g FROM s),
pair AS (SELECT a.r AS a, b.r AS b, a.n AS na, b.n AS nb, count(*) AS o FROM x a JOIN x b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
link AS (SELECT a, b FROM pair WHERE 100 * o >= 85 * (na + nb - o)),
lk AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT r AS a, r AS b FROM s UNION SELECT reach.a, lk.b FROM reach JOIN lk ON reach.b = lk.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(t.doc_id) AS component_id FROM reach JOIN s ON s.r = reach.a JOIN s t ON t.r = reach.b GROUP BY s.r, s.doc_id, s.s
"""
