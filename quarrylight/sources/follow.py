"""Log files that are still written, followed as a stream: whole lines as they are appended, across rotation and truncation.

A source of Spark's own file streams takes files that don't change. This one keeps an offset for each file: up to which byte it has been
read. A file is known by its inode and its first line, so a renamed one is the same file, and one that begins anew is another. Offsets are made
from what the folder holds, so a batch that is replayed reads the same bytes. A long backlog is cut into ranges of bytes, one task each.

Files that match the path are being written, and only their whole lines are read; those that match it with a dot and more
behind (app.log.1) have been rotated, so their last line may lack its end. Compressed ones are left out. The files must be readable under their paths
by the driver and all executors.
"""

from __future__ import annotations

import glob
import logging
import os
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

log = logging.getLogger(__name__)

#: Bytes by which a file's first line tells it, bytes that are looked at together for the last line's end, and bytes of lines that go to Spark together.
HEAD, BLOCK, OUT_BYTES = 4096, 1 << 16, 4 << 20
SPLIT_BYTES = 64 << 20
COMPRESSED = (".gz", ".bz2", ".xz", ".zst")


def whole_lines(f: BinaryIO, size: int) -> int:
    """The place behind the last line end among the first `size` bytes; 0 if there is none."""
    while size > 0:
        low = max(size - BLOCK, 0)
        f.seek(low)
        found = f.read(size - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        size = low
    return 0


def identity(f: BinaryIO, size: int) -> str:
    f.seek(0)
    head = f.read(min(HEAD, size)).split(b"\n", 1)[0]
    return f"{os.fstat(f.fileno()).st_ino}-{zlib.crc32(head):08x}"


def look(path: str, rotated: bool) -> tuple[str, int] | None:
    """Identity of a file and the byte up to which it can be read; None if it holds no whole line yet or has gone."""
    try:
        with open(path, "rb") as f:
            size = os.fstat(f.fileno()).st_size
            end = size if rotated else whole_lines(f, size)
            return (identity(f, end), end) if end else None
    except FileNotFoundError:
        return None


@dataclass
class Piece(InputPartition):
    """The lines that begin in [low, high) of a file of which [begin, end) is new."""

    file: str
    path: str
    begin: int
    low: int
    high: int
    end: int


class FollowReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.pattern = options["path"]
        self.from_start = options.get("fromstart", "false").lower() == "true"
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.fail = options.get("failondataloss", "true").lower() == "true"
        self.known: dict[str, dict] = {}

    def _names(self) -> dict[str, tuple[int, bool]]:
        """Inode of each path, and whether it is a rotated one."""
        live, out = set(glob.glob(self.pattern)), {}
        for path in sorted({*live, *glob.glob(self.pattern + ".*")}):
            try:
                if os.path.isfile(path) and (path in live or not path.endswith(COMPRESSED)):
                    out[path] = os.stat(path).st_ino, path not in live
            except FileNotFoundError:
                continue
        return out

    def _files(self, only_rotated: bool = False) -> dict[str, dict]:
        """{identity: path and end} of the files. Two listings that agree show that no file is being renamed."""
        while True:
            names, out = self._names(), {}
            for path, (_, rotated) in names.items():
                found = look(path, rotated) if rotated or not only_rotated else None
                if found:
                    out[found[0]] = {"path": path, "at": found[1]}
            if names == self._names():
                return out

    def initialOffset(self) -> dict:
        """From the start, what was rotated before is old; else all that is there is."""
        return self._files(only_rotated=self.from_start)

    def latestOffset(self) -> dict:
        # a file that can't be seen for a while stays known, so that it isn't read again
        self.known |= self._files()
        return self.known

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for name, to in end.items():
            begin = start.get(name, {}).get("at", 0)
            if to["at"] < begin:  # cut off, and written anew with the same first line
                begin = 0
            for low in range(begin, to["at"], self.split):
                out.append(Piece(name, to["path"], begin, low, min(low + self.split, to["at"]), to["at"]))
        return out

    def _open(self, piece: Piece) -> BinaryIO | None:
        """The file of a piece, under its path or, as it may have been rotated since, under another."""
        for path in (piece.path, *self._names()):
            try:
                f = open(path, "rb")
            except FileNotFoundError:
                continue
            if os.fstat(f.fileno()).st_size >= piece.end and identity(f, piece.end) == piece.file:
                return f
            f.close()
        return None

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        f = self._open(partition)
        if f is None:
            if self.fail:
                raise FileNotFoundError(f"{partition.path} went or was cut off before bytes {partition.low} to {partition.high} were read")
            log.warning("%s went before bytes %d to %d were read", partition.path, partition.low, partition.high)
            return
        with f:
            at = partition.low
            f.seek(at)
            if at > partition.begin:  # the line that reaches into this piece is of the one before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            lines, held = [], 0
            while at < partition.high:
                line = f.readline(partition.end - at)
                at += len(line)
                held += len(line)
                lines.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                if held >= OUT_BYTES:
                    yield pa.RecordBatch.from_pydict({"line": pa.array(lines, pa.string())})
                    lines, held = [], 0
            if lines:
                yield pa.RecordBatch.from_pydict({"line": pa.array(lines, pa.string())})


class FollowSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "followed_lines"

    def schema(self) -> str:
        return "line string"

    def streamReader(self, schema) -> FollowReader:
        return FollowReader({k.lower(): v for k, v in self.options.items()})


def follow_lines(spark: SparkSession, path: str, from_start: bool = False, split_bytes: int = SPLIT_BYTES, fail_on_loss: bool = True) -> DataFrame:
    """New lines of the files that match a path, as a stream. Files that appear later are read from their start; those that are there now only with `from_start`."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the worker that plans sources doesn't have shipped archives
    spark.dataSource.register(FollowSource)
    return spark.readStream.format("followed_lines").options(path=path, fromStart=from_start, splitBytes=split_bytes, failOnDataLoss=fail_on_loss).load()
