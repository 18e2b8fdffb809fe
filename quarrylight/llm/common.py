"""What all training-data operators share: shipping the code, cutting lineage, texts as bytes.

The Python helpers here look at a batch of texts as one numpy byte array with offsets, so that
words, hashes and n-grams of thousands of documents come from a few array operations.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..deploy import ship_engine

#: Bytes of text that one round of numpy operations takes; a longer text makes a round of its own.
CHUNK_BYTES = 1 << 20

#: Rows and bytes of a batch that Spark hands to Python.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20

#: Whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Word separators fixed by the data contracts: space, and tab to carriage return.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_SEED = np.random.default_rng(20250101)
_BYTE_VALUE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[str, np.ndarray] = {}


def ship(spark: SparkSession) -> None:
    """Give the executors this package, for clusters whose Python path doesn't have it."""
    # texts are long: smaller batches bound what a worker and its executor hold
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        have = int(spark.conf.get(key).rstrip("bB"))
        if have <= 0 or have > most:
            spark.conf.set(key, str(most))
    ship_engine(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and all runs on one machine, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(spark.sparkContext, "_quarrylight_dir", None)
        if found is None:
            found = spark.sparkContext._quarrylight_dir = tempfile.mkdtemp(prefix="spark-quarrylight-")
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # else shuffle files stay until the driver happens to collect its garbage
    had = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, had)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarrylight_path = path
    return out


class Scratch:
    """Tables of an operator's inner steps: written to the shared folder and deleted when the block ends.

    What leaves the block must not read them any more, so an operator writes its result before it ends the block.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        self.paths.append(_path_of(out))
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete one table early."""
        path = _path_of(df)
        if path in self.paths:
            self.paths.remove(path)
            _delete(self.spark, path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            _delete(self.spark, path)


def _path_of(df: DataFrame) -> str:
    return df._quarrylight_path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha_of(text: str) -> Column:
    """SHA-256 of a text's bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def packed(docs: DataFrame) -> DataFrame:
    """`text` (a string), and all other columns in the struct `row`, so that no name can clash with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]).alias("row"), F.col("text").cast("string").alias("text"))


def unpacked(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, from `row` and `text`."""
    return found.select(*[F.col("text").alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def with_fields(source: DataFrame, keep: list[str], more: str) -> StructType:
    """The schema of the columns of `keep`, whatever their names and types, and the further fields."""
    kept = [f for c in keep for f in source.schema if f.name == c]
    return StructType([*kept, *StructType.fromDDL(more)])


def text_of(docs: DataFrame, *columns: str) -> DataFrame:
    """The needed columns and the whole text; texts are cast to string, all else is left out."""
    return docs.select(*columns, F.col("text").cast("string").alias("text"))


def tasks_for(spark: SparkSession) -> int:
    """Shuffle partitions of the session, for repartition() calls that need a number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.large_binary()
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        column = pc.fill_null(column, "").cast(pa.large_string()).cast(large)
    else:
        column = pc.fill_null(column, b"").cast(large)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of rows of about `size` bytes: (rows, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + size, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    have = _POWERS.get("up")
    if have is None or len(have) <= n:
        size = 1 << max(21, int(n).bit_length())
        for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            out = np.ones(size, np.uint64)
            done, step = 1, base
            while done < size:
                out[done : 2 * done] = out[:done] * np.uint64(step)
                step = step * step % 2**64
                done *= 2
            _POWERS[key] = out
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; spans() turns two of them into the hash of the bytes between."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), equal for equal bytes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = CHUNK_BYTES) -> np.ndarray:
    """Hashes of words in a text run of any length, a piece of about `size` bytes at a time."""
    if len(data) <= 2 * size:
        return spans(prefix_hash(data), starts, ends)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(int(np.searchsorted(ends, starts[at] + size, "right")), at + 1)
        base = starts[at]
        out[at:to] = spans(prefix_hash(data[base : ends[to - 1]]), starts[at:to] - base, ends[at:to] - base)
        at = to
    return out


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of each text: starts, ends and the index of the first word of each text."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    np.logical_not(SEPARATOR[data], out=inside[1:-1])
    here, before, after = inside[1:-1], inside[:-2].copy(), inside[2:].copy()
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(here & ~before)
    ends = np.flatnonzero(here & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def owner(first: np.ndarray) -> np.ndarray:
    """For each item, the text it belongs to, from the index of each text's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(word_hash: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles with their text; a text with fewer words gives one of all its words."""
    counts = np.diff(first)
    n = len(word_hash)
    base = np.uint64(_BASE)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h[: n - j if j else n] = h[: n - j if j else n] * base + word_hash[j:]
    text = owner(first)
    at = np.arange(n) - first[:-1][text]
    full = at + k <= counts[text]
    out_h, out_t = [mix(h[full])], [text[full]]
    for words in range(1, k):
        short = np.flatnonzero(counts == words)
        if len(short):
            g = np.zeros(len(short), np.uint64)
            for j in range(words):
                g = g * base + word_hash[first[short] + j]
            out_h.append(mix(g + np.uint64(words)))
            out_t.append(short)
    if len(out_h) == 1:
        return out_h[0], out_t[0]
    h, t = np.concatenate(out_h), np.concatenate(out_t)
    order = np.argsort(t, kind="stable")
    return h[order], t[order]


def as_long(h: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark's signed longs."""
    return h.view(np.int64)


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the index of each row's first value."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
