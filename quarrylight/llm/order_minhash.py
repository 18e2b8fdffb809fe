"""Order MinHash fingerprints of whole texts, in DataFrame operations only.

A text's words [^\\x20\\x09-\\x0D]+ give its k-mers of K words (a shorter text gives one of all its words). The c-th occurrence of a
k-mer is an element of its own, so repeats count. Each of M components ranks the elements by a hash of k-mer and occurrence,
takes the two least, puts them back in the order of the text, and hashes that pair. Two texts agree in a component only if
they hold the same least k-mers in the same order, so the likeness (the share of equal components) falls with their edit
distance, moved passages included, where a plain MinHash sees none.

The M rankings are turns of one hash: ranking j counts from the point j / M of the ring of 64-bit values. So a text is
hashed and sorted once, whatever M is: M markers are sorted among the elements, and component j takes the two elements behind marker j.

The table needs each text's next one. Documents are dealt to blocks by cuts of their ids (approximate quantiles; an id that holds
several cuts is dealt further by a hash of the text), each block gets the first row of the one behind it as halo, and
a window over the block sees the neighbours. Texts are shuffled once; the driver holds the cuts only.

Defined cases: null is the empty text, and all empty texts have one fingerprint; a text of any length is one row; the next document of
rows with equal ids follows a hash of their texts, and a null id comes last; repeated rows are rows like any other; a single row's next
document is itself; other columns, whatever their names, are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tasks_for

#: Words of a k-mer, components of a fingerprint.
K, M = 5, 64
#: Blocks of neighbours for each shuffle partition of the session.
BLOCKS_A_TASK = 4
#: Rows of a block that a window holds outside Spark's spilling memory: texts may be long.
WINDOW_ROWS = 128

_LEAST = -(2**63)
#: The bit that tells elements from markers; a place is below it, as no row has 2**30 words.
_IS_ELEMENT = 1 << 30
#: The bits of a k-mer's hash that name and rank it.
_RANK = -(1 << 31)


def _computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Further columns, computed once behind a generator: lambdas that read them don't repeat them for every element."""
    return df.select(*df.columns, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _element(rank: Column, at: Column) -> Column:
    """An element of the ring: its rank, with its place in the low bits."""
    return rank.bitwiseAND(_RANK).bitwiseOR(at.cast("long").bitwiseOR(_IS_ELEMENT))


def _numbered(found: Column) -> Column:
    """The sorted elements of a text in which k-mers repeat: each k-mer's occurrences are a run, and all but the first are ranked anew by k-mer and number."""
    rank = lambda x: x.bitwiseAND(_RANK)
    again = F.filter(found, lambda x, i: (i > 0) & (rank(x) == rank(F.get(found, i - 1))))

    def ranked_anew(repeats: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(repeats) - 1), lambda i: (i == 0) | (rank(F.get(repeats, i)) != rank(F.get(repeats, i - 1))))
        runs = _let(starts, lambda s: F.flatten(F.transform(s, lambda start, nth: F.transform(F.slice(repeats, start + 1, F.coalesce(F.get(s, nth + 1), F.size(repeats)) - start), lambda x, c: _element(F.xxhash64(rank(x), c), x.bitwiseAND(_IS_ELEMENT - 1))))))
        return F.sort_array(F.concat(F.array_except(found, repeats), runs))

    return _let(again, ranked_anew)


def with_signature(df: DataFrame, text: str, name: str, k: int = K, m: int = M) -> DataFrame:
    """The column `name` (m ints): the order MinHash signature of the column `text`."""
    keep = df.columns
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    df = _computed(df, _words=F.transform(words, lambda w: F.xxhash64(w)))
    # a k-mer is hashed from shifted copies of the words; a text that is shorter is one k-mer
    shifted = F.arrays_zip(F.col("_words").alias("w0"), *[F.slice("_words", F.lit(j + 1), F.size("_words")).alias(f"w{j}") for j in range(1, k)])
    whole = F.slice(shifted, 1, F.greatest(F.size("_words") - (k - 1), F.lit(1)))
    df = _computed(df, _kmers=F.transform(whole, lambda x: F.xxhash64(x).bitwiseAND(_RANK))).drop("_words")
    elements = F.sort_array(F.transform("_kmers", _element))
    once = F.size(F.array_distinct("_kmers")) == F.size("_kmers")
    df = _computed(df, _sorted=elements, _once=once).drop("_kmers")
    df = _computed(df, _elements=F.when(F.col("_once"), F.col("_sorted")).otherwise(_numbered(F.col("_sorted")))).drop("_sorted", "_once")
    markers = F.array(*[F.lit(_LEAST + j * 2**64 // m).cast("long") for j in range(m)])
    df = _computed(df, _ring=F.sort_array(F.concat("_elements", markers)))
    behind = F.filter(F.sequence(F.lit(0), F.size("_ring") - 1), lambda i: F.get("_ring", i).bitwiseAND(_IS_ELEMENT) == 0)
    df = _computed(df, _behind=F.transform(behind, lambda at, j: at - j)).drop("_ring")

    def component(begin: Column) -> Column:
        n = F.greatest(F.size("_elements"), F.lit(1))
        return _let(F.struct(F.get("_elements", F.pmod(begin, n)).alias("a"), F.get("_elements", F.pmod(begin + 1, n)).alias("b")), lambda x: in_order(x["a"], x["b"]))

    def in_order(a: Column, b: Column) -> Column:
        at = lambda x: x.bitwiseAND(_IS_ELEMENT - 1)
        rank = lambda x: x.bitwiseAND(_RANK)
        return F.shiftright(F.when(at(a) < at(b), F.xxhash64(rank(a), rank(b))).otherwise(F.xxhash64(rank(b), rank(a))), 32).cast("int")

    return df.select(*keep, F.transform("_behind", component).alias(name))


def spelled(signature: str) -> Column:
    """A signature as text: eight hexadecimal digits a component."""
    return F.array_join(F.transform(signature, lambda c: F.right(F.hex(c.cast("long") + 2**40), F.lit(8))), "")


def likeness(a: str, b: str) -> Column:
    """The share of equal components."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def _below(cuts: list[int], value: Column, inclusive: bool) -> Column:
    """How many of the sorted cuts are below a value (or equal to it), found in two steps of a square root of them each."""
    step = max(1, math.isqrt(len(cuts)))
    test = (lambda c: c <= value) if inclusive else (lambda c: c < value)
    all_cuts, heads = (F.array(*[F.lit(c).cast("long") for c in some]) for some in (cuts, cuts[::step]))
    group = F.size(F.filter(heads, test)) - 1
    return F.when(group < 0, 0).otherwise(group * step + F.size(F.filter(F.slice(all_cuts, F.greatest(group, F.lit(0)) * step + 1, step), test)))


def dealt_in_blocks(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Rows shuffled by _block, with their order in it (_halo, _key, _tie): a block's first row is also the last one (_halo) of the block ahead. `doc_id` is a long, `text` is not null."""
    key, tie = F.coalesce(F.col("doc_id"), F.lit(_LEAST).cast("long")), F.xxhash64("text")
    blocks = blocks or BLOCKS_A_TASK * tasks_for(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx(key, [i / blocks for i in range(1, blocks)], 100 * blocks)).first()[0] if blocks > 1 else None
    cuts = sorted(cuts or [0])
    below, held = _below(cuts, F.col("_key"), False), _below(cuts, F.col("_key"), True)
    # an id that holds several cuts has blocks of its own, in the order of the texts' hashes
    share = F.floor((F.shiftright("_tie", 32) + 2**31) * (F.col("_held") - F.col("_below") + 1) / 2**32)
    placed = docs.withColumns({"_key": key, "_tie": tie}).withColumns({"_below": below, "_held": held})
    placed = placed.withColumn("_block", (F.col("_below") + share).cast("int")).drop("_below", "_held")
    firsts = placed.groupBy("_block").agg(F.max(F.struct("_key", "_tie")).alias("_first"))
    ahead, every = Window.orderBy(F.desc("_block")), Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row a block
    firsts = firsts.select("_block", "_first", F.coalesce(F.lag("_block").over(ahead), F.min("_block").over(every)).alias("_to"))
    at = F.struct(F.col("_block").alias("_block"), F.lit(False).alias("_halo"))
    copy = F.struct(F.col("_to").alias("_block"), F.lit(True).alias("_halo"))
    found = placed.join(F.broadcast(firsts), "_block")
    copies = F.when(F.col("_first") == F.struct("_key", "_tie"), F.array(at, copy)).otherwise(F.array(at))
    return found.select(*docs.columns, "_key", "_tie", F.inline(copies)).repartition("_block")


def with_next(dealt: DataFrame, columns: list[str]) -> DataFrame:
    """Each dealt row with the `columns` of the next one by descending id, as next_<column>; the last row's next is the first."""
    order = Window.partitionBy("_block").orderBy("_halo", F.desc("_key"), F.desc("_tie"))
    dealt.sparkSession.conf.set("spark.sql.windowExec.buffer.in.memory.threshold", WINDOW_ROWS)
    found = dealt.select(*[c for c in dealt.columns if not c.startswith("_")], "_halo", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return found.filter(~F.col("_halo")).drop("_halo")


def fingerprints(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Every document's fingerprint, that of its edited text (the last third replaced by the beginning of the next document), and the likenesses.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(with_signature(dealt_in_blocks(rows, blocks), "text", "signature"), ["text", "signature"])
    n, third = F.length("text"), F.expr("length(text) div 3").cast("int")
    edited = F.concat(F.left("text", n - third), F.left("next_text", third))
    rows = _computed(rows, n_chars=n.cast("long"), edited=edited).drop("text", "next_text")
    rows = with_signature(rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)), "edited", "edited_signature")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", spelled("signature").alias("fingerprint"), spelled("edited_signature").alias("edited_fingerprint"), likeness("signature", "edited_signature").alias("near_edited"), likeness("signature", "next_signature").alias("near_next")
    )
