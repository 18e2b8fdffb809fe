"""Benchmark decontamination by spaced-seed hashing.

Texts and benchmark items become sequences of word hashes (A-Z lower-cased, ASCII punctuation left out).
Each of the fixed MASKS picks some of eight consecutive words and ignores the others; the hash of the picked
words is a seed. Seeds of the training texts are joined with those of the benchmark; a shared seed gives an
alignment of a text with an item, and the words around it are compared at equal offsets. A text is
contaminated when WINDOW aligned words in a row hold at most WINDOW - MATCHES substitutions. The two masks
together hit every such window (tested over all substitution patterns), so none is missed. Items with fewer
than WINDOW words must occur whole; they have contiguous seeds of their own.

A benchmark of at most BLOCK_BYTES of text is broadcast, and one pass over the corpus finds all. A larger one is joined by
shuffle: its seeds and those of the distinct texts, each with the words around, meet by hash, are verified pair by pair, and what
was found goes back to the texts. Every passing window holds a seed of the alignment, so the words around seeds are enough.
Of the benchmark only a bitmap of seed hashes is broadcast then, of a fixed size.

Defined cases: null or empty texts and texts without words are clean; texts of any length are searched whole; null or empty items
match nothing; items with fewer than WINDOW words must occur whole, without substitutions (an item of one word marks every text
with that word); repeated items are found under each of their ids; repeated rows get equal results; an empty table gives an empty
result, an empty benchmark marks nothing; columns that aren't in `keep`, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, chunks, lists, mix, owner, record, sha_of, ship, with_fields, word_hashes, word_spans, written

#: Lossless for 13 words with 2 substitutions.
MASKS = ("11101011", "11001111")
WINDOW, MATCHES = 13, 11
#: Text of a benchmark that is broadcast.
BLOCK_BYTES = 8 << 20
_BITS = 22
#: Seed matches that are expanded into alignments at a time.
PIECE = 1 << 20

_DROP = np.zeros(256, bool)
_DROP[33:128] = True
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _DROP[_lo:_hi] = False


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and the index of each text's first word."""
    keep = ~_DROP[data]
    before = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
    data, off = LOWER[data[keep]], before[off]
    starts, ends, first = word_spans(data, off)
    return word_hashes(data, starts, ends), first


def seeds(words: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes under a mask and the places where they begin; a seed lies within one text."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n, hash_of_mask(mask), np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    last = np.repeat(first[1:], np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) + len(mask) <= last)
    return mix(h[at]), at


def hash_of_mask(mask: str) -> np.uint64:
    return np.uint64(int("1" + mask, 2))


class Index:
    """The seeds of a benchmark that one broadcast holds."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = [(t or "").encode() for _, t in items]
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.ids = np.array([i for i, _ in items], np.int64)
        self.words, self.first = tokens(np.frombuffer(b"".join(texts), np.uint8), off)
        length = np.diff(self.first)
        item = owner(self.first)
        small = {int(n) for n in length if 0 < n < WINDOW}
        self.masks = [*MASKS, *sorted({"1" * min(n, 8) for n in small})]
        found = []
        for mask in self.masks:
            h, at = seeds(self.words, self.first, mask)
            short = length[item[at]] < WINDOW
            whole = (len(mask) == np.minimum(length[item[at]], 8)) & (at == self.first[item[at]])
            fits = short & whole if mask not in MASKS else ~short
            found.append((h[fits], at[fits]))
        h, at = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        order = np.argsort(h, kind="stable")
        self.hash, self.at = h[order], at[order]
        self.item = item[self.at] if len(item) else self.at
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[self.hash & np.uint64((1 << _BITS) - 1)] = True

    def find(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, equal words) of each text and item that overlap."""
        text = owner(first)
        seen = []
        for mask in self.masks:
            h, at = seeds(words, first, mask)
            may = np.flatnonzero(self.bitmap[h & np.uint64((1 << _BITS) - 1)])
            h, at = h[may], at[may]
            lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
            some = hi > lo
            lo, n, at = lo[some], (hi - lo)[some], at[some]
            upto = np.cumsum(n)
            cuts = np.unique(np.append(np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, PIECE)), len(n)))
            for a, b in zip(cuts, cuts[1:], strict=False):
                entry = np.repeat(lo[a:b] - np.concatenate([[0], np.cumsum(n[a:b])[:-1]]), n[a:b]) + np.arange(n[a:b].sum())
                place = np.repeat(at[a:b], n[a:b])
                seen.append(np.unique(np.stack([text[place], self.item[entry], place - first[text[place]] - self.at[entry] + self.first[self.item[entry]]]), axis=1))
        if not seen:
            return
        best: dict[tuple[int, int], int] = {}
        for d, i, shift in np.unique(np.concatenate(seen, axis=1), axis=1).T.tolist():
            n = self._overlap(words[first[d] : first[d + 1]], self.words[self.first[i] : self.first[i + 1]], shift)
            if n:
                best[d, i] = max(n, best.get((d, i), 0))
        for (d, i), n in best.items():
            yield d, i, n

    @staticmethod
    def _overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> int:
        """Equal words in windows of the alignment that pass; 0: none does."""
        lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
        if len(item) < WINDOW:
            return len(item) if hi - lo == len(item) and (doc[lo + shift : hi + shift] == item).all() else 0
        if hi - lo < WINDOW:
            return 0
        same = doc[lo + shift : hi + shift] == item[lo:hi]
        total = np.concatenate([[0], np.cumsum(same)])
        passed = np.flatnonzero(total[WINDOW:] - total[:-WINDOW] >= MATCHES)
        covered = np.zeros(len(same), bool)
        for p in passed:
            covered[p : p + WINDOW] = True
        return int((same & covered).sum())


#: Words before and after the place of a seed that a window around it may reach.
_BEFORE, _AFTER = WINDOW - len(MASKS[0]), WINDOW
_SPAN = _BEFORE + _AFTER


def around(words: np.ndarray, first: np.ndarray, at: np.ndarray, missing: int) -> np.ndarray:
    """For each place its text's words from _BEFORE before to _AFTER after; `missing` beyond the text's ends."""
    text = owner(first)[at]
    place = at[:, None] + np.arange(-_BEFORE, _AFTER)
    inside = (place >= first[text][:, None]) & (place < first[text + 1][:, None])
    return np.where(inside, words[np.clip(place, 0, max(0, len(words) - 1))], np.uint64(missing))


def _item_seeds(items: DataFrame) -> DataFrame:
    """(h, item, at, size, near): the seeds of every item (item, text), their places and the words around; size: words of the item."""
    schema = pa.schema([("h", pa.int64()), ("item", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("near", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches):
            words, first = tokens(data, off)
            size, text, item = np.diff(first), owner(first), rows.column("item").to_numpy()
            for mask in (*MASKS, *("1" * n for n in range(1, 9))):
                h, at = seeds(words, first, mask)
                own = size[text[at]]
                fits = own >= WINDOW if mask in MASKS else (own < WINDOW) & (np.minimum(own, 8) == len(mask)) & (at == first[text[at]])
                h, at = h[fits], at[fits]
                near = around(words, first, at, 1)
                yield record(schema, h.view(np.int64), item[text[at]], at - first[text[at]], size[text[at]], lists(near.ravel().view(np.int64), np.arange(len(at) + 1) * _SPAN, pa.int64()))

    return items.mapInArrow(run, "h long, item long, at long, size long, near array<long>")


def _text_seeds(texts: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(h, tid, place, words): the seeds of texts (tid, text) that the bitmap may know, their places and the words around."""
    schema = pa.schema([("h", pa.int64()), ("tid", pa.binary()), ("place", pa.int64()), ("words", pa.list_(pa.int64()))])
    known = texts.sparkSession.sparkContext.broadcast(bitmap)  # 2 ** _BITS flags

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches):
            words, first = tokens(data, off)
            text = owner(first)
            for mask in (*MASKS, *("1" * n for n in range(1, 9))):
                h, at = seeds(words, first, mask)
                may = np.flatnonzero(known.value[h & np.uint64((1 << _BITS) - 1)])
                for lo in range(0, len(may), PIECE // _SPAN):
                    p = may[lo : lo + PIECE // _SPAN]
                    near = around(words, first, at[p], 0)
                    own = text[at[p]]
                    yield record(schema, h[p].view(np.int64), rows.column("tid").take(pa.array(own)), at[p] - first[own], lists(near.ravel().view(np.int64), np.arange(len(p) + 1) * _SPAN, pa.int64()))

    return texts.mapInArrow(run, "h long, tid binary, place long, words array<long>")


def _verified(pairs: DataFrame) -> DataFrame:
    """(tid, item, shift, places): the places of equal words in passing windows around each meeting of seeds."""
    schema = pa.schema([("tid", pa.binary()), ("item", pa.int64()), ("shift", pa.int64()), ("places", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            place, at, size = (rows.column(c).to_numpy() for c in ("place", "at", "size"))
            d, i = (rows.column(c).flatten().to_numpy().view(np.uint64).reshape(-1, _SPAN) for c in ("words", "near"))
            same, inside = d == i, (d != np.uint64(0)) & (i != np.uint64(1))
            covered = np.zeros(same.shape, bool)
            for j in range(_BEFORE + 1):
                part = slice(j, j + WINDOW)
                covered[:, part] |= ((size >= WINDOW) & inside[:, part].all(1) & (same[:, part].sum(1) >= MATCHES))[:, None]
            own = np.arange(-_BEFORE, _AFTER)
            whole = (own >= 0) & (own < size[:, None])
            covered |= ((size < WINDOW) & (same | ~whole).all(1))[:, None] & whole
            covered &= same
            row, column = np.nonzero(covered)
            first = np.searchsorted(row, np.arange(rows.num_rows + 1))
            out = record(schema, rows.column("tid"), rows.column("item"), place - at, lists(place[row] + own[column], first, pa.int64()))
            yield out.filter(pa.array(np.diff(first) > 0))

    return pairs.select("tid", "item", "place", "at", "size", "words", "near").mapInArrow(run, "tid binary, item long, shift long, places array<long>")


def _joined(texts: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """(tid, item_ids, matched_words) of the texts that hold items, by a shuffled join of seeds."""
    items = scratch.written(items.withColumn("item", F.monotonically_increasing_id()), "items")
    seeds_ = scratch.written(_item_seeds(items.select("item", "text")), "item-seeds")
    bit = F.col("h").bitwiseAND((1 << _BITS) - 1)
    flags = seeds_.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))).alias("bits")).collect()  # at most 2 ** (_BITS - 6) rows
    bitmap = np.zeros(1 << (_BITS - 6), np.uint64)
    bitmap[[r["w"] for r in flags]] = np.array([r["bits"] for r in flags], np.int64).view(np.uint64)
    found = _verified(_text_seeds(texts, np.unpackbits(bitmap.view(np.uint8), bitorder="little").astype(bool)).join(seeds_, "h"))
    counted = found.select("tid", "item", "shift", F.explode("places").alias("place")).distinct().groupBy("tid", "item", "shift").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("tid", "item").agg(F.max("n").alias("n")).join(items.select("item", "item_id"), "item")
    return best.groupBy("tid").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("n").alias("matched_words"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of `keep` with contaminated, item_ids (ascending) and matched_words (most over one item) for every text."""
    spark = docs.sparkSession
    ship(spark)
    keep = keep or ["doc_id"]
    out = docs.select(*keep, *([F.col("text").cast("string").alias("text")] if "text" not in keep else []))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > block_bytes:
        out = out.withColumn("tid", sha_of("text"))
        with Scratch(spark) as scratch:
            texts = out.filter("text is not null").groupBy("tid").agg(F.first("text").alias("text"))
            found = written(_joined(texts, items, scratch), "leaks")
        out = out.join(found, "tid", "left").withColumns({"item_ids": F.coalesce("item_ids", F.array().cast("array<long>")), "matched_words": F.coalesce("matched_words", F.lit(0).cast("long"))})
        return out.select(*keep, (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "matched_words")

    index = spark.sparkContext.broadcast(Index([(r[0], r[1]) for r in items.collect()]))  # at most block_bytes of text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches):
            block = index.value
            found: list[set[int]] = [set() for _ in range(rows.num_rows)]
            most = [0] * rows.num_rows
            for d, i, n in block.find(*tokens(data, off)):
                found[d].add(int(block.ids[i]))
                most[d] = max(most[d], n)
            first = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            ids = lists(np.array([i for x in found for i in sorted(x)], np.int64), first, pa.int64())
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], ids, pa.array(most, pa.int64())], names=[*keep, "item_ids", "matched_words"])

    out = out.mapInArrow(run, with_fields(out, keep, "item_ids array<long>, matched_words long"))
    return out.select(*keep, (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "matched_words")


_WORDS = r"regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]', '', 'g'), '[^\x20\x09-\x0D]+')"

#: The search in DuckDB: equal words by alignment, then windows. item_ids are joined by commas. For small tables.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
dw AS (SELECT r, len(w) AS n, generate_subscripts(w, 1) AS p, unnest(w) AS x FROM d),
bw AS (SELECT i, item_id, len(w) AS m, generate_subscripts(w, 1) AS q, unnest(w) AS x FROM b),
al AS (SELECT r, i, p - q AS s FROM dw JOIN bw USING (x) GROUP BY ALL HAVING count(*) >= least({MATCHES}, any_value(m))),
eq AS (SELECT al.r, al.i, al.s, item_id, n, m, q FROM al JOIN bw ON bw.i = al.i JOIN dw ON dw.r = al.r AND dw.p = bw.q + al.s AND dw.x = bw.x),
win AS (SELECT r, i, s, a FROM (SELECT r, i, s, unnest(range(greatest(1, q - {WINDOW - 1}, 1 - s), least(q, m - {WINDOW - 1}, n - {WINDOW - 1} - s) + 1)) AS a FROM eq WHERE m >= {WINDOW}) GROUP BY ALL HAVING count(*) >= {MATCHES}),
hit AS (SELECT eq.r, eq.i, eq.s, eq.item_id, count(DISTINCT q) AS c FROM win JOIN eq ON eq.r = win.r AND eq.i = win.i AND eq.s = win.s AND q BETWEEN a AND a + {WINDOW - 1} GROUP BY ALL
  UNION ALL SELECT r, i, s, item_id, count(*) AS c FROM eq WHERE m < {WINDOW} GROUP BY r, i, s, item_id, m HAVING count(*) = m),
f AS (SELECT r, item_id, max(c) AS c FROM hit GROUP BY ALL)
SELECT d.doc_id, count(f.item_id) > 0 AS contaminated, coalesce(string_agg(item_id::VARCHAR, ',' ORDER BY item_id), '') AS item_ids, coalesce(max(c), 0)::BIGINT AS matched_words FROM d LEFT JOIN f USING (r) GROUP BY d.r, d.doc_id
"""
