import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quarrylight.sources.parsers import failures, get_parser, parse_lines, parse_report, read_lines, stream_lines

NOW = datetime(2025, 3, 14, 9, tzinfo=timezone.utc)


def parse(spark, parser, *lines, now=NOW):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, line string")
    return parse_lines(frame, parser, now).withColumn("at", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS")).drop("timestamp").orderBy("n").collect()


def test_ssh_messages(spark):
    rows = parse(
        spark, "ssh",
        "Mar 14 08:15:02 gate sshd[77]: Failed keyboard-interactive/pam for deploy from 192.0.2.14 port 6022 ssh2",
        "Mar  4 08:15:03 gate sshd[77]: Failed password for invalid user ftp from 192.0.2.15 port 6023 ssh2",
        "2025-03-14T09:15:04.25+01:00 gate sshd-session[5]: Accepted password for carol from 2001:db8::5 port 49152 ssh2",
        "Mar 14 08:15:05 gate sshd[77]: Invalid user guest from 192.0.2.16\r\n",
        "Mar 14 08:15:05 gate sshd[77]: Invalid user  from 192.0.2.17 port 99",
        "Mar 14 08:15:06 gate sshd[77]: Connection closed by 192.0.2.14 port 6022",
        "Mar 14 08:15:06 gate systemd[1]: started", " \t ", "Mar 44 08:15:06 gate sshd[1]: Failed x for y from z port 1",
    )
    assert [r.status for r in rows] == ["ok"] * 5 + ["skip", "fail", "fail"]
    assert [(r.type, r.user, r.src_ip) for r in rows[:5]] == [
        ("auth_failure", "deploy", "192.0.2.14"), ("auth_failure", "ftp", "192.0.2.15"), ("auth_success", "carol", "2001:db8::5"), ("invalid_user", "guest", "192.0.2.16"), ("invalid_user", "", "192.0.2.17")
    ]
    assert [r.at for r in rows[:4]] == ["2025-03-14 08:15:02.000", "2025-03-04 08:15:03.000", "2025-03-14 08:15:04.250", "2025-03-14 08:15:05.000"]
    assert [r.fields for r in rows[:5]] == [{"method": "keyboard-interactive/pam", "port": "6022"}, {"method": "password", "port": "6023", "invalid_user": "true"}, {"method": "password", "port": "49152"}, {}, {"port": "99"}]
    assert {r.host for r in rows[:5]} == {"gate"} and all(r.source == "ssh" for r in rows)
    assert rows[6].reason == "ssh: not a line of sshd" and rows[7].reason == "ssh: bad time Mar 44 08:15:06"


def test_ssh_forged_messages(spark):
    """What a client chooses, such as a user name, can't stand for a message of the server."""
    rows = parse(
        spark, "ssh",
        "Mar 14 08:15:02 gate sshd[7]: Invalid user Accepted password for root from 198.51.100.1 port 22 from 192.0.2.99 port 4",
        "Mar 14 08:15:02 gate sshd[7]: error: PAM: Failed password for root from 198.51.100.1 port 22",
        "Mar 14 08:15:02 gate sshd[7]: input_userauth_request: Invalid user x from 198.51.100.1",
    )
    assert [r.status for r in rows] == ["skip"] * 3


@pytest.mark.parametrize("now,stamp,want", [((2025, 1, 2), "Dec 30 01:02:03", "2024-12-30"), ((2025, 1, 2), "Jan  3 00:00:00", "2025-01-03"), ((2025, 1, 2), "Jan  3 00:00:01", "2024-01-03"), ((2024, 3, 5), "Feb 29 10:00:00", "2024-02-29"), ((2025, 3, 5), "Feb 29 10:00:00", "2025-03-01")])
def test_ssh_year(spark, now, stamp, want):
    (row,) = parse(spark, "ssh", f"{stamp} a sshd[1]: Invalid user b from c", now=datetime(*now, tzinfo=timezone.utc))
    assert row.at.startswith(want)


def test_access_logs(spark):
    rows = parse(
        spark, "nginx",
        '192.0.2.8 - - [14/Mar/2025:10:00:00 +0200] "HEAD /a/b.c/robots.txt?x=1?y HTTP/2.0" 304 0 "https://example.net/" "Probe/1.0 (test)"',
        '192.0.2.8 id ann [14/Mar/2025:08:00:00 +0000] "PUT /v1.2/item HTTP/1.1" 201 - "-" "-"',
        '192.0.2.8 - - [14/Mar/2025:08:00:00 +0000] "" 400 0',
        '192.0.2.8 - - [14/Mar/2025:08:00:00 +0000] "GET /x.? HTTP/1.1" 200 7 "" ""', '192.0.2.8 - - [14/Mar/2025:25:00:00 +0000] "GET / HTTP/1.1" 200 7', "GET / 200",
    )
    assert [r.status for r in rows] == ["ok"] * 4 + ["fail"] * 2
    assert rows[0].at == "2025-03-14 08:00:00.000" and rows[0].user == "" and rows[0].src_ip == "192.0.2.8" and rows[0].type == "http_request"
    assert rows[0].fields == {"status": "304", "bytes": "0", "method": "HEAD", "path": "/a/b.c/robots.txt?x=1?y", "uri_stem": "/a/b.c/robots.txt", "uri_query": "x=1?y", "uri_extension": "txt", "referer": "https://example.net/", "user_agent": "Probe/1.0 (test)"}
    assert rows[1].fields == {"status": "201", "bytes": "-", "method": "PUT", "path": "/v1.2/item", "uri_stem": "/v1.2/item"} and rows[1].user == "ann"
    assert rows[2].fields == {"status": "400", "bytes": "0"} and rows[3].fields["uri_stem"] == "/x." and "uri_query" not in rows[3].fields and "uri_extension" not in rows[3].fields
    assert [r.reason for r in rows[4:]] == ["nginx: bad time 14/Mar/2025:25:00:00 +0000", "nginx: not a line of the combined format"]


def test_json_objects(spark):
    rows = parse(
        spark, "json",
        '{"@timestamp":"2025-03-14T07:59:59.5-01:00","event_type":"order","client_ip":"192.0.2.1","username":"eve","amount":12.50,"exact":1E2,"flag":false,"gone":null,"deep":{"x":[1]},"many":[]}',
        ' {"ts":1741942800.25,"message":"m","hostname":"h1"} and more', "null", '"text"', "[]", "{", '{"time":false}', '{"time":"2025-03-14"}', '{"time":[1],"k":""}', '{"ip":"192.0.2.2","src_ip":"192.0.2.3","type":""}',
    )
    assert [r.status for r in rows] == ["ok", "ok", "ok", "fail", "fail", "fail", "fail", "fail", "ok", "ok"]
    assert rows[0].at == "2025-03-14 08:59:59.500" and (rows[0].type, rows[0].src_ip, rows[0].user, rows[0].source) == ("order", "192.0.2.1", "eve", "json")
    assert rows[0].fields == {"amount": "12.50", "exact": "1E2", "flag": "false", "gone": ""}
    assert rows[1].at == "2025-03-14 09:00:00.250" and (rows[1].type, rows[1].message, rows[1].host) == ("generic", "m", "h1")
    assert rows[2].type == "generic" and rows[2].at == "2025-03-14 09:00:00.000"
    assert rows[8].fields == {"k": ""} and rows[8].at == rows[2].at and rows[9].src_ip == "192.0.2.3" and rows[9].type == ""


def test_hostile_json(spark):
    """No line stops the job: times out of bounds and what isn't JSON fail, half characters become U+FFFD."""
    bad = ['{"time":"2025-13-01T00:00:00Z"}', '{"time":1e999}', '{"time":1e15}', '{"time":-1e12}', '{"a":NaN}', '{"a":-Infinity}', '{"time":"0000-01-01T00:00:00Z"}', "[" * 100_000, '{"a":"\x01"}', '{"time":"2025-03-14T00:00:00+99:99"}', '{"ts":1,"time":"x"}']
    good = ['{"a":"\\ud800 x"}', '{"\\udfff":1}', '{"a":"\\ud83d\\ude00"}', '{"time":-62135596800}', '{"a":' + "9" * 5000 + "}", '{"time":1741942800}' + "﻿", '{"a":1,"a":2}']
    rows = parse(spark, "json", *bad, *good)
    assert [r.status for r in rows] == ["fail"] * len(bad) + ["ok"] * len(good) and all(r.reason.startswith("json: ") for r in rows[: len(bad)])
    found = [r.fields for r in rows[len(bad) :]]
    assert found[0] == {"a": "� x"} and found[1] == {"�": "1"} and found[2] == {"a": "\U0001f600"} and len(found[4]["a"]) == 5000 and found[6] == {"a": "2"}


@pytest.mark.parametrize("parser", ["json", "nginx", "ssh"])
def test_random_lines(spark, parser):
    rng = random.Random(3)
    pieces = ["Mar 14 08:15:02", " gate ", "sshd[1]: ", "Failed x for y from z port 1", '"', "[14/Mar/2025:08:00:00 +0000]", " ", "-", "{", "}", '":', "\\u", "é", "\r", "\n", "\x00", "200", " ", "a.b", "1e9"]
    lines = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(400)] + [None, "x" * 300_000]
    rows = parse(spark, parser, *lines)
    assert {r.status for r in rows} <= {"ok", "skip", "fail"} and all((r.status == "fail") == (r.reason is not None) for r in rows)
    assert len(rows) == sum(1 for x in lines if x and x.strip(" \t\n\x0b\f\r"))


def test_parsed_once(spark):
    """Filters and projections over parsed lines don't repeat the match."""
    frame = spark.createDataFrame([("x",)], "line string")
    found = parse_lines(frame, "nginx", NOW).filter("status = 'ok' and fields['status'] > '3' and src_ip like '1%'").select("message", F.col("fields")["path"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and "regexp_extract" not in plan


def test_report_and_sources(spark, tmp_path):
    frame = spark.createDataFrame([("{}",), ("x",), (" ",), ("[]",)], "line string")
    parsed = parse_lines(frame, "json", NOW)
    assert parse_report(parsed).first().asDict() == {"accepted": 1, "skipped": 0, "failed": 2}
    assert len(failures(parsed)) == 2 and len(failures(parsed, 1)) == 1 and "json: not an object" in failures(parsed)
    with pytest.raises(ValueError, match="json, nginx, ssh"):
        get_parser("x")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text('{"a":1}\n{"a":2}\n')
    assert parse_report(parse_lines(read_lines(spark, str(tmp_path / "in")), "json", NOW)).first().accepted == 2
    query = parse_lines(stream_lines(spark, str(tmp_path / "in")), "json", NOW).select("status").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("seen").count() == 2 and timedelta(0) == NOW.utcoffset()
