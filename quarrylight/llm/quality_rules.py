"""Quality rules as a short-circuit cascade.

The rules are yes/no tests on whole texts. On a bounded sample each rule's cost (seconds a byte, with the setting apart of the
texts that it gets) and selectivity (share of texts rejected) are measured; the rules then run in order of rejection per cost,
each only on the texts that every earlier rule let pass. The order changes only the work: a text is
kept when no rule rejects it. Figures that are asked for of every text are counted once; rules that need them take them as
they are, which their measured cost shows.

Defined cases: a null text has no words, as an empty one; texts without words fail the base test; texts of any length are
judged whole; rules of equal worth run in the order of their names; repeated rows get equal results; an empty table gives an empty
result; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEPARATOR, chunks, mix, owner, prefix_hash, record, ship, spans, text_of, word_spans

#: Rows on which cost and selectivity are measured.
SAMPLE_ROWS = 2000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


class Texts:
    """A run of whole texts with the word spans that the rules share."""

    def __init__(self, data: np.ndarray, off: np.ndarray, words: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.data, self.off = data, off
        self.starts, self.ends, self.first = word_spans(data, off) if words is None else words
        self.n_words = np.diff(self.first)
        self.known: dict[str, np.ndarray] = {}  # figures counted so far, one for each text
        self._hash = None

    def __len__(self) -> int:
        return len(self.off) - 1

    def figure(self, name: str, count: Callable[[], np.ndarray]) -> np.ndarray:
        if name not in self.known:
            self.known[name] = count()
        return self.known[name]

    def subset(self, rows: np.ndarray) -> Texts:
        """Some of the texts, with their word spans and known figures."""
        taken = []
        for edge in (self.off, self.first):
            size = np.diff(edge)[rows]
            begin = np.concatenate([[0], np.cumsum(size)])
            taken.append((begin, np.repeat(edge[rows] - begin[:-1], size) + np.arange(begin[-1])))
        (off, at), (first, word) = taken
        moved = np.repeat(off[:-1] - self.off[rows], np.diff(first))
        out = Texts(self.data[at], off, (self.starts[word] + moved, self.ends[word] + moved, first))
        out.known = {k: x[rows] for k, x in self.known.items()}
        return out

    @property
    def prefix(self) -> np.ndarray:
        if self._hash is None:
            self._hash = prefix_hash(self.data)
        return self._hash

    def word_hash(self) -> np.ndarray:
        return spans(self.prefix, self.starts, self.ends)

    def count(self, flags: np.ndarray) -> np.ndarray:
        """Flagged bytes of each text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.off[1:]] - total[self.off[:-1]]

    def per_word(self, flags: np.ndarray) -> np.ndarray:
        """Flagged bytes of each word."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.ends] - total[self.starts]

    def sum_words(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[self.first[1:]] - total[self.first[:-1]]


def _same_earlier(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether an equal one stands before it, and whether any other is equal."""
    order = np.argsort(key, kind="stable")
    equal = np.concatenate([[False], key[order][1:] == key[order][:-1]]) if len(key) else np.zeros(0, bool)
    later, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order] = equal
    any_[order] = equal | np.concatenate([equal[1:], [False]]) if len(key) else equal
    return later, any_


def _of_text(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within one text."""
    return mix(h + (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


def word_chars(t: Texts) -> np.ndarray:
    return t.figure("word_chars", lambda: t.sum_words(t.per_word((t.data & 0xC0) != 0x80)))


def symbols(t: Texts) -> np.ndarray:
    return t.figure("symbols", lambda: t.count(_SYMBOL[t.data]))


def lines(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that are equal to an earlier one."""
    if "lines" not in t.known:
        t.known["lines"], t.known["dup_lines"] = _lines(t)
    return t.known["lines"], t.known["dup_lines"]


def _lines(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    breaks = np.flatnonzero(t.data == 10)
    text_of_break = np.searchsorted(t.off, breaks, "right") - 1
    starts = np.concatenate([t.off[:-1], breaks + 1])
    ends = np.concatenate([breaks, t.off[1:]])
    text = np.concatenate([np.arange(len(t)), text_of_break])
    order = np.lexsort((starts, text))
    starts, text = starts[order], text[order]
    ends = ends[np.lexsort((ends, np.concatenate([text_of_break, np.arange(len(t))])))]
    filled = np.concatenate([[0], np.cumsum(~SEPARATOR[t.data], dtype=np.int64)])
    some = filled[ends] > filled[starts]
    starts, ends, text = starts[some], ends[some], text[some]
    again, _ = _same_earlier(_of_text(spans(t.prefix, starts, ends), text))
    return np.bincount(text, minlength=len(t)), np.bincount(text[again], minlength=len(t))


def repeat_words(t: Texts) -> np.ndarray:
    """Words in three-word windows that the text has twice or more."""
    h, text, n = t.word_hash(), owner(t.first), len(t.starts)
    out = np.zeros(n, bool)
    if n >= 3:
        inside = text[2:] == text[:-2]
        at = np.flatnonzero(inside)
        key = mix(h[at] * np.uint64(3) + mix(h[at + 1] * np.uint64(5) + mix(h[at + 2])))
        _, twice = _same_earlier(_of_text(key, text[at]))
        for j in range(3):
            out[at[twice] + j] = True
    return t.sum_words(out)


def _too_many_symbols(t: Texts) -> np.ndarray:
    return 10 * symbols(t) > t.n_words


def _odd_word_length(t: Texts) -> np.ndarray:
    chars = word_chars(t)
    return (chars < 2 * t.n_words) | (chars > 15 * t.n_words)


def _repeated_lines(t: Texts) -> np.ndarray:
    n, again = lines(t)
    return 2 * again > n


def _shouting(t: Texts) -> np.ndarray:
    upper = (t.data >= 65) & (t.data <= 90)
    lower = (t.data >= 97) & (t.data <= 122)
    return t.count(upper) > t.count(lower)


def _exclaiming(t: Texts) -> np.ndarray:
    return 2 * t.count(t.data == 33) > t.n_words


def _few_alphabetic(t: Texts) -> np.ndarray:
    return 10 * t.sum_words(t.per_word(_LETTER[t.data]) > 0) < 7 * t.n_words


def _one_word_rules(t: Texts) -> np.ndarray:
    key = np.sort(_of_text(t.word_hash(), owner(t.first)))
    most = np.zeros(len(t), np.int64)
    if len(key):
        text = owner(t.first)
        order = np.argsort(_of_text(t.word_hash(), text), kind="stable")
        new = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.flatnonzero(new)
        np.maximum.at(most, text[order][at], np.diff(np.append(at, len(key))))
    return 10 * most > 3 * t.n_words


#: Rejecting tests by name, in whole-number arithmetic.
RULES: dict[str, Callable[[Texts], np.ndarray]] = {
    "too_many_symbols": _too_many_symbols,
    "odd_word_length": _odd_word_length,
    "repeated_lines": _repeated_lines,
    "shouting": _shouting,
    "exclaiming": _exclaiming,
    "few_alphabetic_words": _few_alphabetic,
    "one_word_rules": _one_word_rules,
}


def base_figures(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is asked for of every text: word_chars, n_symbols, n_dup_lines."""
    return word_chars(t), symbols(t), lines(t)[1]


def cascade(t: Texts, rules: list[str]) -> np.ndarray:
    """Index of the rule (in the given order) that rejects each text first; -1: kept."""
    out = np.full(len(t), -1)
    alive = np.arange(len(t))
    for i, name in enumerate(rules):
        if not len(alive):
            break
        left = np.flatnonzero(out[alive] < 0)
        if len(left) < len(alive):
            t, alive = t.subset(left), alive[left]
        if len(alive):
            out[alive[RULES[name](t)]] = i
    return out


def measure(docs: DataFrame, rules: list[str] | None = None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Seconds, bytes, texts and rejections of each rule on a hash sample of about `rows` rows."""
    names = rules or list(RULES)
    ship(docs.sparkSession)
    share = min(1.0, rows / max(1, docs.count()))
    sample = text_of(docs, "doc_id").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("text")
    schema = pa.schema([("rule", pa.string()), ("seconds", pa.float64()), ("bytes", pa.int64()), ("texts", pa.int64()), ("rejected", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, off in chunks(batches):
            out, whole = [], Texts(data, off)
            base_figures(whole)
            for name in names:
                began = time.perf_counter()
                t = whole.subset(np.arange(len(whole)))  # as the cascade sets apart what a rule gets
                no = RULES[name](t)
                out.append((name, time.perf_counter() - began, len(data), len(t), int(no.sum())))
            yield record(schema, *map(list, zip(*out, strict=True)))

    return sample.mapInArrow(run, "rule string, seconds double, bytes long, texts long, rejected long").groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("seconds", "bytes", "texts", "rejected")])


def rule_order(measured: list, rules: list[str] | None = None) -> list[str]:
    """Rules by share rejected per second a byte, most first; those never measured come last."""
    worth = {r["rule"]: (r["rejected"] / max(1, r["texts"])) / max(1e-12, r["seconds"] / max(1, r["bytes"])) for r in measured}
    return sorted(rules or list(RULES), key=lambda n: (-worth.get(n, -1.0), n))


def apply_rules(docs: DataFrame, rules: list[str] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base figures, base_failed, kept and rejected_by (the first rule that rejected the text)."""
    order = rule_order(measure(docs, rules, sample_rows).collect(), rules)
    schema = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("rejected_by", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches):
            t = Texts(data, off)
            figures, repeated = base_figures(t), repeat_words(t)
            failed = (t.n_words < 50) | (100 * repeated > 50 * t.n_words)
            by = np.full(len(t), -1)
            passed = np.flatnonzero(~failed)
            if len(passed):
                by[passed] = cascade(t.subset(passed), order)
            yield record(schema, rows.column("doc_id"), t.n_words, *figures, repeated, failed, ~failed & (by < 0), [order[i] if i >= 0 else None for i in by])

    return text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string")


_W = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"

SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, {_W} AS w FROM d),
word AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
win AS (SELECT r, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS g FROM word WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, g, count(*) OVER (PARTITION BY r, g) AS n FROM win WHERE g IS NOT NULL) WHERE n >= 2),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r),
ln AS (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n FROM ln WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
top AS (SELECT r, max(n) AS n FROM (SELECT r, x, count(*) AS n FROM word GROUP BY r, x) GROUP BY r),
al AS (SELECT r, count(*) AS n FROM word WHERE regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]') GROUP BY r),
base AS (
  SELECT w.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    coalesce(dup.n_lines, 0) AS n_lines, coalesce(top.n, 0) AS n_top, coalesce(al.n, 0) AS n_alpha,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower, length(regexp_replace(t, '[^!]', '', 'g')) AS n_bang
  FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN top USING (r) LEFT JOIN al USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_dup_lines > n_lines
    OR n_upper > n_lower OR 2 * n_bang > n_words OR 10 * n_alpha < 7 * n_words OR 10 * n_top > 3 * n_words) AS kept
FROM f
"""
