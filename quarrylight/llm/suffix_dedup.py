"""Exact removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

Every byte that lies in a string of LENGTH bytes which also starts elsewhere in the corpus is removed. Steps:

1. Anchors. Among the ANCHOR-byte strings in each window of LENGTH bytes the one with the least hash is the window's
   anchor (the leftmost of equals). It depends on the window's bytes alone, so equal windows have equal anchors, and
   a window whose anchor hash occurs once in the corpus can't repeat. Only distinct texts take part; a text with
   copies repeats as a whole.
2. Contexts. Consecutive windows with one anchor form a context, the bytes from the first window's start to the last
   one's end. Contexts with an anchor hash that occurs twice or more are written out; equal contexts become one
   (their windows repeat), which also folds a hot passage before anything is gathered by its hash.
3. The contexts of an anchor hash come together in a task, about CHUNK_PLACES bytes at a time. Each chunk is cut into
   shards; the shards' transforms are merged by interleave refinement (see bwt_merge), whose common prefixes give
   the repeated windows. An anchor hash with more than HOT_CONTEXTS distinct contexts (the edge of a very common passage)
   would fill one task: its interleave is refined across tasks, a group-by a round, with the places that still share
   their class and next symbol dealt to finer classes and those alone in theirs left out.
4. Repeated windows go back to their texts, where the union of their bytes is removed.

Texts are told apart by their SHA-256, and numbered once they are distinct.

Defined cases: a null text counts as empty; texts under LENGTH bytes stay whole; texts of any length take part whole; repeated
rows are copies of each other; of the rows of a text the one with the smallest doc_id (null first) stands for it; removal is judged on the input; an
empty table gives an empty result; other columns may have any name and stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt_merge import repeated_places
from .common import Scratch, as_long, buffers, chunks, lists, mix, packed, powers, prefix_hash, sha_of, ship, spans, text_of, unpacked, written
from .jaccard_join import _runs

LENGTH, ANCHOR, DEPTH = 200, 32, 4
#: An anchor hash with more than this share of all anchors is hot: at most its inverse are.
HOT_SHARE = 0.001
#: Distinct contexts of one anchor hash that a task may hold.
HOT_CONTEXTS = 20_000
#: Context bytes that a task merges at a time.
CHUNK_PLACES = 1 << 20


def runs(data: np.ndarray, off: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: text, first window start, last window start, anchor hash."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    n = len(data)
    if n < length:
        return none
    prefix = prefix_hash(data)
    gram = mix((prefix[anchor:] - prefix[:-anchor]) * powers(n)[1][: n - anchor + 1])
    # the least of the upper hash half wins, then the leftmost
    key = (gram >> np.uint64(32) << np.uint64(32)) | np.arange(len(gram), dtype=np.uint64)
    width = length - anchor + 1
    low, have = key, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    last = off[1:] - length
    some = last >= off[:-1]
    if not some.any():
        return none
    count = np.where(some, last - off[:-1] + 1, 0)
    starts = np.repeat(off[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    text = np.repeat(np.arange(len(count)), count)
    a = at[starts]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    final = np.append(first[1:], len(a)) - 1
    return text[first], starts[first], starts[final], gram[a[first]]


def _text_rows(docs: DataFrame, length: int, anchor: int, scratch: Scratch) -> DataFrame:
    """doc_id, tid (SHA-256 of the text), n_bytes and anchors of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("tid", pa.binary()), ("n_bytes", pa.int64()), ("anchors", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches):
            text, _, _, h = runs(data, off, length, anchor)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("tid"), pa.array(np.diff(off)), lists(as_long(h), np.searchsorted(text, np.arange(len(off))), pa.int64())], schema=schema)

    source = text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).select("doc_id", sha_of("text").alias("tid"), "text")
    return scratch.written(source.mapInArrow(run, "doc_id long, tid binary, n_bytes long, anchors array<long>"), "text-rows")


def _contexts(candidates: DataFrame, length: int, anchor: int) -> DataFrame:
    """A row for each run with a repeated anchor: its text, place and context hashes; the bytes once a batch."""
    schema = pa.schema([("h", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("t", pa.int64()), ("at", pa.int64()), ("windows", pa.int32()), ("context", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches):
            text, lo, hi, h = runs(data, off, length, anchor)
            base = np.searchsorted(text, np.arange(len(off)))
            flat = rows.column("repeated")
            own = np.repeat(np.arange(rows.num_rows), np.diff(flat.offsets.to_numpy()))
            take = np.sort(base[own] + flat.flatten().to_numpy())
            text, lo, hi, h = text[take], lo[take], hi[take], h[take]
            end = hi + length
            prefix = prefix_hash(data)
            middle = (lo + end) // 2
            c1, c2 = spans(prefix, lo, end), mix(spans(prefix, lo, middle) * np.uint64(3) + spans(prefix, middle, end))
            once = np.zeros(len(take), bool)
            once[np.unique(c1, return_index=True)[1]] = True
            raw = data.tobytes()
            bytes_ = pa.array([raw[a:b] if f else None for a, b, f in zip(lo, end, once, strict=True)], pa.binary())
            t = rows.column("t").to_numpy()[text]
            yield pa.RecordBatch.from_arrays([pa.array(as_long(h)), pa.array(as_long(c1)), pa.array(as_long(c2)), pa.array(t), pa.array(lo - off[text]), pa.array((hi - lo + 1).astype(np.int32)), bytes_], schema=schema)

    return candidates.select("t", "repeated", "text").mapInArrow(run, "h long, c1 long, c2 long, t long, at long, windows int, context binary")


def _refined_windows(whole: DataFrame, length: int, depth: int, scratch: Scratch) -> DataFrame:
    """The same as _repeated_windows for contexts of hot anchors: every round one group-by over all places of all tasks."""
    step = length // depth
    whole = scratch.written(whole.select(F.monotonically_increasing_id().alias("c"), "c1", "c2", "copies", "windows", "context"), "hot-contexts")
    places = whole.select("c", "context", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("k"), F.lit(0).cast("long").alias("class"))
    for i in range(depth):
        symbol = F.substring("context", F.col("k") + (1 + i * step), F.lit(step))
        places = places.select("c", "k", "class", symbol.alias("symbol"))
        # classes of one place can't hold a repeated window; the others are numbered anew
        classes = places.groupBy("class", "symbol").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        classes = scratch.written(classes.select("class", "symbol", F.monotonically_increasing_id().alias("next")), "hot-classes")
        places = scratch.written(places.join(classes, ["class", "symbol"]).select("c", "k", F.col("next").alias("class")), "hot-places")
        if i + 1 < depth:
            places = places.join(whole.select("c", "context"), "c")
    found = places.join(whole.select("c", "c1", "c2"), "c").select("c1", "c2", F.array("k", "k").alias("pair"))
    copied = whole.filter("copies > 1").select("c1", "c2", F.array(F.lit(0), F.col("windows") - 1).alias("pair"))
    return found.unionByName(copied).groupBy("c1", "c2").agg(F.flatten(F.collect_list("pair")).alias("spans"))  # at most the windows of one context


def _repeated_windows(contexts: DataFrame, length: int, depth: int, hot_contexts: int, scratch: Scratch) -> DataFrame:
    """(c1, c2, spans): the repeated windows of each distinct context, as pairs of first and last window."""
    schema = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("spans", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ["h"], CHUNK_PLACES, "size"):
            data, off = buffers(table.column("context"))
            h = table.column("h").to_numpy()
            windows = table.column("windows").to_numpy()
            whole = table.column("copies").to_numpy() > 1
            # an anchor with one context has nothing to be merged with
            group = np.cumsum(np.concatenate([[0], (h[1:] != h[:-1]).astype(np.int64)]))
            rows = np.flatnonzero(np.bincount(group)[group] > 1)
            size = np.diff(off)[rows]
            at = np.repeat(off[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            flags = np.zeros(len(data), bool)
            flags[at] = repeated_places(data[at], np.concatenate([[0], np.cumsum(size)]), length // depth, depth)
            w_off = np.concatenate([[0], np.cumsum(windows, dtype=np.int64)])
            row = np.repeat(np.arange(len(windows)), windows)
            nth = np.arange(w_off[-1]) - w_off[row]
            hit = flags[off[row] + nth] | whole[row]
            edge = np.ones(len(hit), bool)
            edge[1:] = row[1:] != row[:-1]
            opens = np.flatnonzero(hit & (edge | ~np.append(False, hit[:-1])))
            closes = np.flatnonzero(hit & (np.append(edge[1:], True) | ~np.append(hit[1:], False)))
            first = np.searchsorted(row[opens], np.arange(len(windows) + 1)) * 2
            pairs = np.stack([nth[opens], nth[closes]], 1).ravel().astype(np.int32)
            batch = pa.RecordBatch.from_arrays([table.column("c1").combine_chunks(), table.column("c2").combine_chunks(), lists(pairs, first, pa.int32())], schema=schema)
            yield batch.filter(pa.array(np.diff(first) > 0))

    whole = contexts.groupBy("h", "c1", "c2").agg(F.count(F.lit(1)).alias("copies"), F.max("windows").alias("windows"), F.first("context", ignorenulls=True).alias("context"))
    whole = whole.withColumn("size", F.octet_length("context"))
    hot = scratch.written(contexts.select("h", "c1", "c2").distinct().groupBy("h").count().filter(F.col("count") > hot_contexts).select("h"), "hot-anchors")
    refined = None
    if hot.limit(1).count():
        refined = _refined_windows(whole.join(hot, "h", "left_semi"), length, depth, scratch)
        whole = whole.join(hot, "h", "left_anti")
    merged = whole.select("h", "c1", "c2", "copies", "windows", "context", "size")
    merged = merged.repartition("h").sortWithinPartitions("h").mapInArrow(run, "c1 long, c2 long, spans array<int>")
    return merged if refined is None else merged.unionByName(refined)


def repeated_parts(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, depth: int = DEPTH, hot_contexts: int = HOT_CONTEXTS, *, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, tid, n_bytes, copies, t: the text's number) and, for distinct texts with repeated windows, (t, text, spans)."""
    if length % depth or anchor > length:
        raise ValueError("depth must divide length, and anchor be no longer")
    ship(docs.sparkSession)
    rows = _text_rows(docs, length, anchor, scratch)
    texts = rows.groupBy("tid").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id")).alias("rep"), F.first("anchors").alias("anchors"))
    texts = scratch.written(texts.withColumn("t", F.monotonically_increasing_id()), "texts")
    whole, rows = rows, scratch.written(rows.drop("anchors"), "rows")
    scratch.drop(whole)
    anchors = texts.select("t", F.posexplode("anchors").alias("i", "h"))
    total = texts.agg(F.sum(F.size("anchors"))).first()[0] or 0
    twice = scratch.written(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "twice")
    # hot hashes are few and broadcast, so the join by hash has no hot key
    hot = twice.filter(F.col("n") > max(1000, int(HOT_SHARE * total))).select("h", F.lit(True).alias("hot"))
    marked = anchors.join(F.broadcast(hot), "h", "left")
    repeated = marked.filter("hot").select("t", "i").unionByName(marked.filter("hot is null").join(twice.select("h"), "h").select("t", "i"))
    repeated = repeated.groupBy("t").agg(F.collect_list("i").alias("repeated"))
    repeated = repeated.join(texts.select("t", "tid", F.col("rep.doc_id").alias("rep")), "t")
    source = text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).withColumn("tid", sha_of("text"))
    # the one row that stands for its text; should that row itself be repeated, one of it
    candidates = source.join(repeated, (source["tid"] == repeated["tid"]) & source["doc_id"].eqNullSafe(repeated["rep"])).select("t", "repeated", "text")
    candidates = scratch.written(candidates, "candidates")
    whole, texts = texts, scratch.written(texts.select("tid", "t", "copies"), "text-numbers")
    for table in (whole, twice):
        scratch.drop(table)
    if candidates.groupBy("t").count().filter("count > 1").limit(1).count():
        candidates = candidates.dropDuplicates(["t"])
    contexts = scratch.written(_contexts(candidates, length, anchor), "contexts")
    found = _repeated_windows(contexts, length, depth, hot_contexts, scratch)
    windows = contexts.select("c1", "c2", "t", "at").join(found, ["c1", "c2"]).select("t", "at", "spans")
    windows = windows.groupBy("t").agg(F.collect_list(F.struct("at", "spans")).alias("found"))
    windows = windows.select("t", F.flatten(F.transform("found", lambda x: F.transform(x["spans"], lambda s: s + x["at"]))).alias("spans"))
    return rows.select("doc_id", "tid", "n_bytes").join(texts.select("tid", "t", "copies"), "tid"), candidates.select("t", "text").join(windows, "t")


def _removed(data: np.ndarray, off: np.ndarray, pairs: pa.ListArray, length: int) -> np.ndarray:
    """Flags of the bytes that repeated windows cover; pairs are first and last window starts in each text."""
    flat = pairs.flatten().to_numpy().reshape(-1, 2)
    base = np.repeat(off[:-1], np.diff(pairs.offsets.to_numpy()) // 2)
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, base + flat[:, 0], 1)
    np.add.at(change, base + flat[:, 1] + length, -1)
    return np.cumsum(change)[:-1] > 0


def _cut_texts(parts: DataFrame, length: int, with_text: bool) -> DataFrame:
    """(t, n_removed, n_spans, kept_sha256 or kept_text) of the texts with repeated windows."""
    last = ("kept_text", pa.string()) if with_text else ("kept_sha256", pa.string())
    schema = pa.schema([("t", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches):
            gone = _removed(data, off, rows.column("spans"), length)
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            edges = off[1:-1][off[1:-1] < len(data)]
            begins[edges] = gone[edges]
            total = [np.concatenate([[0], np.cumsum(f, dtype=np.int64)]) for f in (gone, begins)]
            kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(off, off[1:], strict=False)]
            out = [k.decode("utf-8", "ignore") if with_text else hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays([rows.column("t"), *[pa.array(t[off[1:]] - t[off[:-1]]) for t in total], pa.array(out, pa.string())], schema=schema)

    return parts.mapInArrow(run, f"t long, n_removed long, n_spans long, {last[0]} string")


def removal_digest(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, depth: int = DEPTH, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    with Scratch(docs.sparkSession) as scratch:
        rows, parts = repeated_parts(docs, length, anchor, depth, hot_contexts, scratch=scratch)
        cut = _cut_texts(parts, length, with_text=False)
        out = rows.join(cut, "t", "left")
        whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
        nothing = F.lit(hashlib.sha256(b"").hexdigest())
        out = out.select(
            "doc_id",
            "n_bytes",
            F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(whole, nothing).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("tid")))).alias("kept_sha256"),
        )
        return written(out, "removal")


def without_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, depth: int = DEPTH, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """The documents with repeated bytes taken out of their texts; bytes of a character cut in two go as well. Null texts stay null."""
    with Scratch(docs.sparkSession) as scratch:
        rows, parts = repeated_parts(docs, length, anchor, depth, hot_contexts, scratch=scratch)
        cut = _cut_texts(parts, length, with_text=True)
        whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
        texts = rows.groupBy("tid", "t").agg(F.max(whole).alias("whole")).join(cut.select("t", "kept_text"), "t", "left")
        change = texts.filter("whole or kept_text is not null").select("tid", F.when(F.col("whole"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
        change = written(change, "cut-texts")
    keyed = packed(docs).withColumn("tid", sha_of("text"))
    out = keyed.join(change, "tid", "left").select("row", F.coalesce("kept_text", "text").alias("text"))
    return unpacked(out, docs)


#: The removal of repeated 200-byte strings in DuckDB, over hexadecimal texts. For small tables.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT r, unnest(range(0, len(x) // 2 - 199)) AS p, x FROM d WHERE len(x) >= 400),
h AS (SELECT r, p, md5_number(substr(x, 2 * p + 1, 400)) AS h FROM win),
rep AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
isl AS (SELECT r, p, sum(CASE WHEN p > coalesce(prev, -999) + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS g FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS prev FROM rep)),
span AS (SELECT r, g, min(p) AS a, max(p) + 200 AS b FROM isl GROUP BY r, g),
gap AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM span),
agg AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM span GROUP BY r),
kept AS (SELECT gap.r, string_agg(substr(d.x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS k FROM gap JOIN d USING (r) GROUP BY gap.r)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN agg.r IS NULL THEN x ELSE k || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN agg USING (r) LEFT JOIN kept USING (r)
"""
