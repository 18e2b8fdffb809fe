"""Quality by importance resampling.

Word unigrams and bigrams are hashed into BUCKETS; the target texts (labelled good) and the raw corpus each give a
generative model, the smoothed distribution over the buckets. A text's log weight is the sum over its n-grams of the log
ratio of the two models. Adding Gumbel noise and taking the k largest draws k texts without replacement in proportion
to their weights. The k-th largest value is found by histogram refinement over all rows, so nothing is sorted or
gathered; only bounded tables of bin counts reach the driver.

The raw model counts every n-gram of every text. The target model uses at most TARGET_ROWS labelled rows, picked by hash.

Defined cases: null or empty texts and texts without words have weight 0 (log weight 0); texts of any length are counted whole; the
noise depends on doc_id and seed alone, so repeated rows are drawn together and rows that tie with the k-th value are all drawn;
rows without a doc_id share one noise; an empty table gives an empty result; without target rows all log weights are 0; other
columns, whatever their names, are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, mix, owner, prefix_hash, record, ship, spans, text_of, word_spans, written

BUCKETS = 10_000
TARGET_ROWS = 20_000
#: Fixed point of drawn values, and bins of one round of the search for the k-th.
SCALE, BINS = 1 << 16, 4096


def ngram_buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every word and every two words in a row."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, off)
    h, text = spans(prefix_hash(data), starts, ends), owner(first)
    at = np.flatnonzero(text[1:] == text[:-1]) if len(h) > 1 else np.zeros(0, np.int64)
    two = mix(h[at] * np.uint64(0x9E3779B97F4A7C15) + h[at + 1])
    return np.concatenate([h, two]).astype(np.uint64) % np.uint64(BUCKETS), np.concatenate([text, text[at]])


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all n-grams of all texts: one row of counts a task, then a sum by bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for _, data, off in chunks(batches):
            total += np.bincount(ngram_buckets(data, off)[0].astype(np.int64), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield record(schema, some.astype(np.int32), total[some])

    out = np.zeros(BUCKETS, np.int64)
    for r in text_of(docs).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of the ratio of the add-one smoothed models, by bucket."""
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def kth_largest(values: DataFrame, k: int) -> int | None:
    """The k-th largest of a long column `v`; None if k exceeds the rows."""
    ends = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not k or ends[0] is None or k > ends[2]:
        return None
    low, high, width, above = ends[0], ends[1], max(1, -(-(ends[1] - ends[0] + 1) // BINS)), 0
    while True:  # the value lies in [low, high], and `above` rows lie beyond
        rows = values.filter(F.col("v").between(low, high)).groupBy(F.expr(f"(v - {low}L) div {width}L").alias("bin")).count().collect()
        for r in sorted(rows, key=lambda r: -r["bin"]):
            if above + r["count"] >= k:
                low += r["bin"] * width
                high = min(high, low + width - 1)
                break
            above += r["count"]
        if width == 1:
            return low
        width = max(1, -(-width // BINS))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 1, target_rows: int = TARGET_ROWS) -> DataFrame:
    """doc_id, n_grams, log_weight, drawn_value (fixed point) and selected of every row.

    k is `share` of the rows; by default the share of good rows among the labelled ones.
    """
    ship(docs.sparkSession)
    known = labels.filter("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    if share is None:
        share = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
        share = 1.0 if share is None else share
    good = known.filter("quality = 1").orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(target_rows).select("doc_id")
    target = text_of(docs, "doc_id").join(F.broadcast(good), "doc_id")  # at most target_rows ids
    ratio = log_ratio(bucket_counts(target), bucket_counts(docs))
    schema = pa.schema([("doc_id", pa.int64()), ("n_grams", pa.int64()), ("log_weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches):
            bucket, text = ngram_buckets(data, off)
            yield record(schema, rows.column("doc_id"), np.bincount(text, minlength=rows.num_rows), np.bincount(text, ratio[bucket.astype(np.int64)], rows.num_rows))

    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weights = text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, n_grams long, log_weight double")
    weights = written(weights.withColumn("v", ((F.col("log_weight") - F.log(-F.log(uniform))) * SCALE).cast("long")), "weights")
    last = kth_largest(weights, math.floor(share * weights.count()))
    return weights.select("doc_id", "n_grams", "log_weight", F.col("v").alias("drawn_value"), F.lit(False).alias("selected") if last is None else (F.col("v") >= last).alias("selected"))
