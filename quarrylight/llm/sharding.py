"""Sharding by a k-d tree over document metadata, in DataFrame operations only.

The documents become weighted points: one per distinct text, with the coordinates source, language
and length. Starting from one cell, every cell is split along its widest dimension (extent relative
to the whole corpus) at the weighted median, or at the fraction that the numbers of leaves on both
sides call for, until each leaf holds the target bytes. The medians of all cells of a level are found
together by histogram refinement: a group-by on (cell, bin) a round, whose running sums tell each cell's
next range. Cells, ranges and cuts are tables that are joined with the points; the driver sees the number of
open cells only.

Equal texts are one point, so they always share a shard. A point that is heavier than a shard's even part of what the
others leave is a leaf of its own (fewer such points exist than shards), and the tree deals the rest over the other leaves.
So shards are near equal unless the copies of one text exceed a shard; that shard is then as large as those copies.

Defined cases: a null or empty text has the size 16; texts of any length are one point; null source or language is a category
of its own; ties in a coordinate are told apart by the text's hash; repeated rows are placed like any other rows; other
columns, whatever their names, are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_of, written

#: Bytes that each document takes besides its text.
ROW_BYTES = 16
#: Bins of one round of refinement, and the share of a shard's bytes at which a cut is close enough.
BINS, CLOSE = 4096, 0.001
#: Bits of a coordinate, and of the hash that tells points of one coordinate apart.
COORDINATE_BITS, TIE_BITS = 16, 24
#: Rows that one task numbers at a time.
SLOT_ROWS = 50_000

DIMENSIONS = ("source", "lang", "length")
_KEYS = [f"k{i}" for i in range(len(DIMENSIONS))]


def _chosen(columns: list[Column]) -> Column:
    """The one of the columns whose number `dim` gives."""
    out = columns[0]
    for i, c in enumerate(columns[1:], 1):
        out = F.when(F.col("dim") == i, c).otherwise(out)
    return out


def heavy_limit(points: DataFrame, leaves: int) -> tuple[int, float]:
    """How many points are leaves of their own, and the weight above which they are: more than an even part of the rest."""
    total = points.agg(F.sum("weight")).first()[0] or 0
    n, limit = 0, total / leaves
    while True:
        found, held = points.filter(F.col("weight") > limit).agg(F.count(F.lit(1)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if found == n:
            return n, limit
        n, limit = found, (total - held) / (leaves - found)


def _searches(points: DataFrame, cells: DataFrame, scale: list[int]) -> DataFrame:
    """For each open cell with points: its leaves, the dimension to split, the weight wanted below the cut and the range that holds the cut."""
    ends = [f(k).alias(f"{name}{i}") for i, k in enumerate(_KEYS) for name, f in (("low", F.min), ("high", F.max))]
    found = points.groupBy("cell").agg(F.sum("weight").alias("w"), *ends).join(cells, "cell")
    extents = [(F.shiftright(f"high{i}", TIE_BITS) - F.shiftright(f"low{i}", TIE_BITS)) / scale[i] for i in range(len(_KEYS))]
    widest = F.greatest(*extents)
    dim = F.coalesce(*[F.when(e == widest, i) for i, e in enumerate(extents)])
    found = found.withColumn("dim", dim).withColumn("left", F.expr("n div 2").cast("int"))
    low, high = (_chosen([F.col(f"{name}{i}") for i in range(len(_KEYS))]) for name in ("low", "high"))
    width = F.greatest(F.ceil((high - low + 1) / BINS).cast("long"), F.lit(1).cast("long"))
    return found.select("cell", "first", "n", "left", "dim", (F.col("w") * F.col("left") / F.col("n")).alias("wanted"), low.alias("low"), width.alias("width"), F.lit(0.0).alias("below"))


def _refined(points: DataFrame, searches: DataFrame, tolerance: float) -> DataFrame:
    """One round: every search gets its cut, or a range that is BINS times smaller (cut: null)."""
    within = points.select("cell", "weight", *_KEYS).join(searches, "cell").withColumn("key", _chosen([F.col(k) for k in _KEYS]))
    within = within.filter((F.col("key") >= F.col("low")) & (F.col("key") < F.col("low") + F.col("width") * BINS))
    bins = within.groupBy(*searches.columns, F.expr("cast((key - low) div width as int)").alias("bin")).agg(F.sum("weight").alias("weight"))
    so_far = F.col("below") + F.sum("weight").over(Window.partitionBy("cell").orderBy("bin"))  # at most BINS rows a cell
    bins = bins.withColumn("so_far", so_far).withColumn("at", F.struct("bin", "weight", "so_far"))
    s = bins.groupBy(*searches.columns).agg(F.coalesce(F.min(F.when(F.col("so_far") >= F.col("wanted"), F.col("at"))), F.max("at")).alias("hit"))
    before = F.col("hit.so_far") - F.col("hit.weight")
    # the edge of the bin that is closer to what is wanted
    edge = F.col("hit.bin") + F.when(F.col("hit.so_far") - F.col("wanted") < F.col("wanted") - before, 1).otherwise(0)
    ready = (F.col("width") == 1) | (F.col("hit.weight") <= tolerance)
    low, width = F.col("low") + F.col("width") * F.col("hit.bin"), F.ceil(F.col("width") / BINS).cast("long")
    return s.select("cell", "first", "n", "left", "dim", "wanted", low.alias("low"), width.alias("width"), before.alias("below"), F.when(ready, F.col("low") + F.col("width") * edge).alias("cut"))


def _tree(points: DataFrame, leaves: int, total: int, scratch: Scratch) -> list[DataFrame]:
    """Tables of d1, d2, shard, which together hold the points (all in cell 0). Each level is written out: the next one reads it, and a lost executor costs one level."""
    if not total:
        return []
    ends = points.agg(*[f(F.shiftright(k, TIE_BITS)) for k in _KEYS for f in (F.max, F.min)]).first()
    scale = [max(1, (ends[2 * i] or 0) - (ends[2 * i + 1] or 0)) for i in range(len(_KEYS))]
    cells = points.select("cell").limit(1).select("cell", F.lit(0).alias("first"), F.lit(leaves).alias("n"))
    open_points, done, most = points, [], leaves
    while most > 1:
        searches, cuts = _searches(open_points, cells, scale), None
        while True:
            found = scratch.written(_refined(open_points, searches, CLOSE * total / leaves), "shard-cuts")
            cut = found.filter("cut is not null").select("cell", "first", "n", "left", "dim", "cut")
            cuts = cut if cuts is None else cuts.unionByName(cut)
            searches = found.filter("cut is null").drop("cut")
            if not searches.limit(1).count():
                break
        right = (_chosen([F.col(k) for k in _KEYS]) >= F.col("cut")).cast("int")
        leaf, share = F.col("first") + F.col("left") * F.col("side"), F.when(F.col("side") == 1, F.col("n") - F.col("left")).otherwise(F.col("left"))
        moved = open_points.join(cuts, "cell").withColumn("side", right)
        moved = scratch.written(moved.select("d1", "d2", "weight", *_KEYS, (F.col("cell") * 2 + F.col("side")).alias("cell"), leaf.alias("leaf"), share.alias("share")), "shard-level")
        done.append(moved.filter("share = 1").select("d1", "d2", F.col("leaf").alias("shard")))
        open_points = moved.filter("share > 1").drop("leaf", "share")
        halves = cuts.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
        cells = halves.select((F.col("cell") * 2 + F.col("side")).alias("cell"), leaf.alias("first"), share.alias("n")).filter("n > 1")
        most -= most // 2
    return done or [points.select("d1", "d2", F.lit(0).alias("shard"))]


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Place every document in a shard. Give the number of shards, or the bytes a shard should hold.

    Returns doc_id, size, text_crc32, shard and slot (0, 1, ... without gaps in each shard).
    """
    with Scratch(docs.sparkSession) as scratch:
        raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
        slim = scratch.written(
            text_of(docs, "doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")).select(
                "doc_id", "lang", "source", (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("d1"), F.xxhash64(F.lit(7), raw).alias("d2")
            ),
            "shard-rows",
        )
        most = 2**COORDINATE_BITS - 1
        category = lambda name: F.coalesce(F.shiftright(F.crc32(F.min(name).cast("binary")), 32 - COORDINATE_BITS), F.lit(0)).cast("long")
        # 2048 steps of length to each power of two
        coordinates = [category("source"), category("lang"), (F.log2(F.min("size")) * 2048).cast("long")]
        points = slim.groupBy("d1", "d2").agg(F.sum("size").alias("weight"), *[F.least(c, F.lit(most)).alias(f"c{i}") for i, c in enumerate(coordinates)])
        tie = F.pmod(F.xxhash64("d1", "d2"), F.lit(2**TIE_BITS))
        points = scratch.written(points.select("d1", "d2", "weight", F.lit(0).cast("long").alias("cell"), *[(F.col(f"c{i}") * 2**TIE_BITS + tie).alias(k) for i, k in enumerate(_KEYS)]), "shard-points")
        total = points.agg(F.sum("weight")).first()[0] or 0
        leaves = shards or max(1, math.ceil(total / target_bytes))

        heavy, limit = heavy_limit(points, leaves)
        rest = points.filter(F.col("weight") <= limit)
        placed = _tree(rest, leaves - heavy, rest.agg(F.sum("weight")).first()[0] or 0, scratch) if heavy < leaves else []
        nth = F.row_number().over(Window.orderBy(F.desc("weight"), "d1", "d2"))  # fewer rows than shards
        own = points.filter(F.col("weight") > limit).select("d1", "d2", (F.lit(leaves) - nth).cast("int").alias("shard"))
        for part in placed:
            own = own.unionByName(part)
        # `salt` deals even equal rows to different buckets; it is drawn once, as the table is written
        rows = scratch.written(slim.join(own, ["d1", "d2"]).select("doc_id", "size", "text_crc32", "shard", F.xxhash64(F.monotonically_increasing_id()).alias("salt")), "shard-placed")

        # Slots: rows are numbered within small buckets of a shard, which begin where the buckets before them end.
        sizes = rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SLOT_ROWS).alias("buckets"))
        rows = rows.join(sizes, "shard").withColumn("bucket", F.pmod("salt", "buckets"))
        ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        begins = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("begins"))
        numbered = rows.withColumn("at", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "salt")))
        return written(numbered.join(begins, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("begins") + F.col("at") - 1).cast("long").alias("slot")), "shards")
