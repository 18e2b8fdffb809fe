import os

import pytest

from quarrylight.sources.follow import FollowReader, follow_lines, whole_lines


def reader(path, **options):
    return FollowReader({"path": str(path), "fromstart": "true", **options})


def new(r, start, end):
    return [x for p in r.partitions(start, end) for b in r.read(p) for x in b.column("line").to_pylist()]


def put(path, text, mode="a"):
    with open(path, mode, newline="") as f:
        f.write(text)


def test_appended_lines_and_rotation(tmp_path):
    at, steps = tmp_path / "door.log", []
    r = reader(at)
    last = r.initialOffset()

    def step():
        nonlocal last
        to = dict(r.latestOffset())
        steps.append(new(r, last, to))
        last = to
        return steps[-1]

    assert step() == []  # the file isn't there yet
    put(at, "opened ")
    assert step() == []  # nor is a line whole
    put(at, "by anna\r\nclosed\nhalf")
    assert step() == ["opened by anna", "closed"]
    put(at, " a line\n\nleft ov")
    os.rename(at, tmp_path / "door.log.1")
    assert step() == ["half a line", "", "left ov"]  # the rest of the old file, with no new one
    put(at, "second file\n")
    os.rename(tmp_path / "door.log.1", tmp_path / "door.log.2")
    os.rename(at, tmp_path / "door.log.1")
    put(at, "third file\n")
    assert sorted(step()) == ["second file", "third file"]  # rotated twice between two looks
    put(at, "x\n", "w")
    assert step() == ["x"]  # cut off and written anew
    put(at, "x\ny\nz\n")
    assert step() == ["x", "y", "z"]
    put(at, "x\nw\n", "w")
    assert step() == ["x", "w"]  # as before, with the same first line
    (tmp_path / "door.log.3.gz").write_bytes(b"packed\n")
    assert step() == []


def test_start_at_the_end(tmp_path):
    at = tmp_path / "a.log"
    put(at, "old\n")
    put(tmp_path / "a.log.1", "older\n")
    end = FollowReader({"path": str(at)})
    first = end.initialOffset()
    assert new(reader(at), reader(at).initialOffset(), reader(at).latestOffset()) == ["old"]
    put(at, "new\n")
    put(tmp_path / "b.log", "other\n")
    assert new(end, first, end.latestOffset()) == ["new"]


@pytest.mark.parametrize("split", [1, 2, 3, 7, 64, 10**6])
def test_pieces_hold_each_line_once(tmp_path, split):
    at, lines = tmp_path / "a.log", ["", "é" * 5, "a", "b" * 40, "", "", "last퟿"]
    put(at, "".join(f"{x}\n" for x in lines) + "open")
    r = reader(at, splitbytes=str(split))
    assert new(r, {}, r.latestOffset()) == lines
    with open(at, "rb") as f:
        assert whole_lines(f, 4) == 1 and whole_lines(f, 0) == 0


def test_files_that_go(tmp_path):
    at = tmp_path / "a.log"
    put(at, "one\n")
    r = reader(at)
    to = dict(r.latestOffset())
    os.rename(at, tmp_path / "a.log.1")
    assert new(r, {}, to) == ["one"]  # found under its new name
    os.remove(tmp_path / "a.log.1")
    with pytest.raises(FileNotFoundError):
        new(r, {}, to)
    assert new(reader(at, failondataloss="false"), {}, to) == []
    assert new(r, to, dict(r.latestOffset())) == []


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files = [tmp_path / "in" / f"{n}.log" for n in range(3)]

    def run():
        lines = follow_lines(spark, str(tmp_path / "in" / "*.log"), from_start=True, split_bytes=50)
        lines.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
        return sorted(x.line for x in spark.read.parquet(str(tmp_path / "out")).collect())

    for n, at in enumerate(files):
        put(at, "".join(f"{n} {i}\n" for i in range(40)) + f"{n} 4")
    want = [f"{n} {i}" for n in range(3) for i in range(40)]
    assert run() == sorted(want)
    for n, at in enumerate(files):
        put(at, "0\n")
    os.rename(files[1], f"{files[1]}.1")
    put(files[1], "1 fresh\n")
    want += [f"{n} 40" for n in range(3)] + ["1 fresh"]
    assert run() == sorted(want)
    assert run() == sorted(want)
