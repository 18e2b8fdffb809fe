"""Log lines to events. A parser maps a table with the column `line` to the event columns, a status (ok, skip or fail) and the reason of a failure.

`now` is an argument, not the clock, so that a batch is parsed alike whenever it runs. Lines of white space are dropped uncounted.
A line holds no line feed but at its end; one that does fails. Each line is matched once: one replacement lays the groups of a
pattern out in lines, and the event is made from them behind a generator, so that later filters and projections read the
event's columns instead of repeating the parse.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT_COLUMNS = ("timestamp", "source", "host", "type", "src_ip", "user", "message", "fields")

# What log lines are made of. A word ends at a blank; a quoted part can't hold a quote.
_WORD, _MAYBE = r"[^\t\n\f\r ]+", r"[^\t\n\f\r ]*"
_QUOTED = r'"([^"]*)"'

# sshd writes by syslog, with a date that lacks the year or with an RFC 3339 time; then come host, program and message.
_SSH_HEAD = rf"(?:([A-Z][a-z][a-z] +\d\d? \d\d:\d\d:\d\d)|(\d\d\d\d-\d\d-\d\dT{_WORD})) ({_WORD}) sshd(?:-session)?\[\d+\]: "
_SSH_PEER = rf" from ({_WORD})"
_SSH_FAILED = rf"Failed ({_WORD}) for (invalid user )?({_MAYBE}){_SSH_PEER} port (\d+)"
_SSH_ACCEPTED = rf"Accepted ({_WORD}) for ({_WORD}){_SSH_PEER} port (\d+)"
_SSH_INVALID = rf"Invalid user ({_MAYBE}){_SSH_PEER}(?: port (\d+))?"
_SSH = rf"{_SSH_HEAD}((?:{_SSH_FAILED}|{_SSH_ACCEPTED}|{_SSH_INVALID})?.*)"
# host ident user [time] "request" status bytes, and in the combined form "referer" "agent"
_COMBINED = rf"({_WORD}) {_WORD} ({_WORD}) \[([^\]]+)\] {_QUOTED} (\d\d\d) (\d+|-)(?: {_QUOTED} {_QUOTED})?.*"

_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})\z"


def _groups(line: Column, pattern: str) -> Column:
    """The groups of a pattern that begins where the line does, in an array; all are empty where it doesn't match."""
    n = re.compile(pattern).groups
    laid_out = F.regexp_replace(line, rf"(?s)^(?:{pattern}|.*)\z", "\n".join(f"${i}" for i in range(1, n + 1)))
    return F.split(F.when(F.contains(line, F.lit("\n")), "\n" * (n - 1)).otherwise(laid_out), "\n")


def _fields(*entries: tuple[str, Column, Column | None]) -> Column:
    """A map of those entries (key, value, condition) whose condition holds."""
    none = F.create_map().cast("map<string,string>")
    return F.map_concat(*[F.create_map(F.lit(k), v) if ok is None else F.when(ok, F.create_map(F.lit(k), v)).otherwise(none) for k, v, ok in entries])


def _with_event(lines: DataFrame, event: Column, keep: list[str]) -> DataFrame:
    """The columns of `keep` and those of the event, which is computed once however often they are used."""
    return lines.select(*[F.col(f"`{c}`") for c in keep], F.inline(F.array(event)))


def _possible(time: Column) -> Column:
    """A time, or null where it is out of bounds, offsets included; every parser's times go through here."""
    return F.when(F.unix_micros(time).between(*TIME_BOUNDS), time)


def _event(status: Column, reason: Column, **columns: Column) -> Column:
    return F.struct(status.alias("status"), *[columns.get(n, F.lit("")).alias(n) for n in EVENT_COLUMNS], reason.alias("reason"))


def _rfc3339(text: Column) -> Column:
    return _possible(F.when(text.rlike(_RFC3339), F.try_to_timestamp(F.replace(text, F.lit(","), F.lit(".")))))


def _in_year(stamp: Column, year: int) -> Column:
    """A syslog date in a year, the 29th of February of a year without one as the 1st of March."""
    leap = F.try_to_timestamp(F.concat(F.lit("2000 "), F.regexp_replace(stamp, " +", " ")), F.lit("yyyy MMM d HH:mm:ss"))
    moved = leap + F.expr(f"make_interval({year - 2000})")
    return moved + F.make_dt_interval(F.dayofmonth(leap) - F.dayofmonth(moved))


def parse_ssh(lines: DataFrame, now: datetime) -> DataFrame:
    """OpenSSH server lines, in the classic form without a year or with an RFC 3339 time. A date over a day ahead of now is last year's."""
    keep = lines.columns
    lines = lines.withColumn("__g", _groups(F.rtrim("line", F.lit("\r\n")), _SSH))
    (classic, iso, host, message, how, unknown, failed_user, failed_ip, failed_port, accepted_how, accepted_user, accepted_ip, accepted_port, invalid_user, invalid_ip, invalid_port) = (F.col("__g")[i] for i in range(16))
    lines = lines.withColumns({"__this": F.when(classic != "", _in_year(classic, now.year)), "__last": F.when(classic != "", _in_year(classic, now.year - 1)), "__iso": _rfc3339(iso)})
    far = F.lit(now.astimezone(timezone.utc).isoformat()).cast("timestamp") + F.expr("interval 24 hours")
    time = F.coalesce(F.when(F.col("__this") > far, F.col("__last")).otherwise(F.col("__this")), F.col("__iso"))
    failed, accepted, invalid = how != "", accepted_how != "", invalid_ip != ""

    def pick(a: Column, b: Column, c: Column) -> Column:
        return F.when(failed, a).when(accepted, b).when(invalid, c).otherwise("")

    port = pick(failed_port, accepted_port, invalid_port)
    reason = F.when(host == "", "ssh: not a line of sshd").when(time.isNull(), F.concat(F.lit("ssh: bad time "), classic, iso))
    status = F.when(reason.isNotNull(), "fail").when(failed | accepted | invalid, "ok").otherwise("skip")
    event = _event(
        status, reason, timestamp=time, source=F.lit("ssh"), host=host, type=pick(F.lit("auth_failure"), F.lit("auth_success"), F.lit("invalid_user")), src_ip=pick(failed_ip, accepted_ip, invalid_ip), user=pick(failed_user, accepted_user, invalid_user), message=message,
        fields=_fields(("method", F.concat(how, accepted_how), failed | accepted), ("port", port, port != ""), ("invalid_user", F.lit("true"), failed & (unknown != ""))),
    )
    return _with_event(lines, event, keep)


def parse_nginx(lines: DataFrame, now: datetime) -> DataFrame:
    """Access logs in the common and the combined format."""
    keep = lines.columns
    lines = lines.withColumn("__g", _groups(F.rtrim("line", F.lit("\r\n")), _COMBINED))
    address, user, stamp, request, code, size, referer, agent = (F.col("__g")[i] for i in range(8))
    parts = F.split(request, " ", 3)
    lines = lines.withColumns({"__time": _possible(F.try_to_timestamp(stamp, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))), "__parts": parts, "__stem": F.substring_index(F.get(parts, F.lit(1)), "?", 1)})
    path, stem, split = F.get("__parts", F.lit(1)), F.col("__stem"), F.size("__parts") >= 2
    query, last = F.substr(path, F.length(stem) + 2), F.substring_index(stem, "/", -1)
    extension = F.when(F.contains(last, F.lit(".")), F.substring_index(last, ".", -1)).otherwise("")
    reason = F.when(address == "", "nginx: not a line of the combined format").when(F.col("__time").isNull(), F.concat(F.lit("nginx: bad time "), stamp))
    given = lambda c: (c != "") & (c != "-")
    fields = _fields(
        ("status", code, None), ("bytes", size, None), ("method", F.get("__parts", F.lit(0)), split), ("path", path, split), ("uri_stem", stem, split), ("uri_query", query, split & (query != "")), ("uri_extension", extension, split & (extension != "")),
        ("referer", referer, given(referer)), ("user_agent", agent, given(agent)),
    )
    event = _event(F.when(reason.isNull(), "ok").otherwise("fail"), reason, timestamp=F.col("__time"), source=F.lit("nginx"), type=F.lit("http_request"), src_ip=address, user=F.when(user == "-", "").otherwise(user), message=request, fields=fields)
    return _with_event(lines, event, keep)


#: The first and the last microsecond of an event's time (years 1 to 9999).
TIME_BOUNDS = (-62_135_596_800_000_000, 253_402_300_799_999_999)


#: JSON keys that fill the event's own columns, first of each list first (fixed names of the format).
JSON_ALIASES = {
    "timestamp": ("timestamp", "time", "@timestamp", "ts"),
    "type": ("type", "event_type"),
    "source": ("source",),
    "host": ("host", "hostname"),
    "src_ip": ("src_ip", "ip", "client_ip", "remote_addr"),
    "user": ("user", "username"),
    "message": ("message", "msg"),
}


_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_LONE = re.compile("[\ud800-\udfff]")


class _Number(str):
    """A JSON number as it is written."""


def _no_number(word: str):
    raise ValueError(f"{word} is not JSON")


_DECODER = json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_no_number)
_OWN = {a for aliases in JSON_ALIASES.values() for a in aliases}


def json_time(value: str) -> int:
    """Microseconds since 1970 of an RFC 3339 text, or of a number of seconds; a ValueError if it is neither or out of bounds."""
    if isinstance(value, _Number):
        seconds = float(value)
        if not abs(seconds) < 1e12:
            raise ValueError(f"bad timestamp {value}")
        whole = int(seconds)
        return (whole * 10**9 + int((seconds - whole) * 1e9)) // 1000
    if not isinstance(value, str) or not re.match(_RFC3339.replace(r"\z", r"\Z"), value):
        raise ValueError(f"bad timestamp {value!r}")
    return (datetime.fromisoformat(value.replace("Z", "+00:00").replace(",", ".")) - _EPOCH) // timedelta(microseconds=1)


def json_event(line: str, now_micros: int) -> tuple:
    """(time, type, source, host, src_ip, user, message, fields) of one line; a ValueError if it is no event. Half characters become U+FFFD."""
    try:
        found, _ = _DECODER.raw_decode(line.lstrip(" \t\r\n"))
    except RecursionError as e:
        raise ValueError("nested too deeply") from e
    if found is None:
        found = {}
    if not isinstance(found, dict):
        raise ValueError("not an object")
    text = {}
    for k, v in found.items():
        if isinstance(v, (dict, list)):
            continue
        text[_LONE.sub("\ufffd", k)] = "" if v is None else ("true" if v else "false") if isinstance(v, bool) else _LONE.sub("\ufffd", v)
    key = {name: next((a for a in aliases if a in text), None) for name, aliases in JSON_ALIASES.items()}
    own = {name: "" if k is None else text[k] for name, k in key.items()}
    at = now_micros
    for alias in JSON_ALIASES["timestamp"]:  # each of them must be a time
        if alias in text:
            stamp = json_time(found[alias])
            at = stamp if alias == key["timestamp"] else at
    rest = [(k, v) for k, v in text.items() if k not in _OWN]
    return (at, own["type"] if key["type"] else "generic", own["source"] if key["source"] else "json", own["host"], own["src_ip"], own["user"], own["message"], rest)


_JSON_TYPE = pa.struct([("t", pa.int64()), *[(n, pa.string()) for n in ("type", "source", "host", "src_ip", "user", "message")], ("fields", pa.map_(pa.string(), pa.string())), ("reason", pa.string())])


def parse_json(lines: DataFrame, now: datetime) -> DataFrame:
    """One JSON object a line. Number texts are kept as written, nested values are dropped: Spark's own reader does neither, so lines go through Arrow batches."""
    keep, micros = lines.columns, round(now.timestamp() * 1e6)

    @F.arrow_udf("t bigint, type string, source string, host string, src_ip string, user string, message string, fields map<string,string>, reason string")
    def parse(line: pa.Array) -> pa.Array:
        rows = []
        for text in line.to_pylist():
            try:
                rows.append((*json_event(text, micros), None))
            except ValueError as e:
                rows.append((None, *[""] * 6, [], _LONE.sub("\ufffd", f"json: {e}")))
        columns = list(zip(*rows, strict=True)) or [()] * len(_JSON_TYPE)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _JSON_TYPE, strict=True)], fields=list(_JSON_TYPE))

    found = lines.withColumn("__e", parse(F.coalesce("line", F.lit(""))))
    e = F.col("__e")
    time = _possible(F.timestamp_micros(e["t"]))
    reason = F.coalesce(e["reason"], F.when(time.isNull(), "json: time out of bounds"))
    event = _event(F.when(reason.isNull(), "ok").otherwise("fail"), reason, timestamp=time, **{n: e[n] for n in EVENT_COLUMNS[1:]})
    return _with_event(found, event, keep)


Parser = Callable[[DataFrame, datetime], DataFrame]
PARSERS: dict[str, Parser] = {"json": parse_json, "nginx": parse_nginx, "ssh": parse_ssh}


def get_parser(name: str) -> Parser:
    if name not in PARSERS:
        raise ValueError(f"unknown parser {name!r}; known: {', '.join(sorted(PARSERS))}")
    return PARSERS[name]


def parse_lines(lines: DataFrame, parser: str, now: datetime) -> DataFrame:
    """All lines with their status and event columns; white-space lines are left out."""
    return get_parser(parser)(lines.filter(F.col("line").rlike(r"[^\s]")), now)


def events_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter("status = 'ok'").select(*EVENT_COLUMNS)


def parse_report(parsed: DataFrame) -> DataFrame:
    """One row: accepted, skipped, failed."""
    return parsed.agg(*[F.count(F.when(F.col("status") == s, 1)).alias(n) for s, n in (("ok", "accepted"), ("skip", "skipped"), ("fail", "failed"))])


def failures(parsed: DataFrame, most: int = 5) -> list[str]:
    """Why lines failed, of at most so many of them."""
    return [r["reason"] for r in parsed.filter("status = 'fail'").select("reason").limit(most).collect()]


def read_lines(spark, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def stream_lines(spark, path: str, files_per_batch: int = 100) -> DataFrame:
    """Lines of a folder that log shipping writes files into, as a stream; the limit of files a batch is the back-pressure."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).withColumnRenamed("value", "line")
