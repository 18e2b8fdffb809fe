from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quarrylight.functions.addresses import bits_v4, in_prefix, parse_address, parse_prefix, routable
from quarrylight.functions.durations import format_duration, parse_duration, parse_when
from quarrylight.functions.fields import field_ref, severity_rank
from quarrylight.functions.numbers import number_of, parse_number
from quarrylight.functions.regexes import RegexSyntaxError, re2_to_java


@pytest.mark.parametrize("text,micros,form", [("1h30m", 5_400_000_000, "1h30m0s"), ("500ms", 500_000, "500ms"), ("1m", 60_000_000, "1m0s"), ("0", 0, "0s"), ("1.5s", 1_500_000, "1.5s"), ("-2s", -2_000_000, "-2s"), ("24h", 86_400_000_000, "24h0m0s")])
def test_durations(text, micros, form):
    assert parse_duration(text) == micros
    assert format_duration(micros) == form


@pytest.mark.parametrize("text", ["", "5", "1x", "h", "1h 2m"])
def test_wrong_durations(text):
    with pytest.raises(ValueError):
        parse_duration(text)


def test_times():
    now = datetime(2025, 3, 14, 0, 10, tzinfo=timezone.utc)
    assert parse_when("90m", now) == datetime(2025, 3, 13, 22, 40, tzinfo=timezone.utc)
    assert parse_when("2025-03-01T01:30:00-03:30", now) == datetime(2025, 3, 1, 5, tzinfo=timezone.utc)
    with pytest.raises(ValueError):
        parse_when("2025-03-14", now)


@pytest.mark.parametrize(
    "pattern,text,found",
    [
        (r"^4\d\d$", "404", True), (r"c$", "abc\n", False), (r"(?m)c$", "abc\nx", True), (r"(?i)É", "é", True), (r"a.b", "a\rb", True), (r"a.b", "a\nb", False), (r"a\sb", "a\x0bb", False), (r"(?P<n_a>x)y", "xy", True),
        (r"[[:alpha:]&&x]", "&", True), (r"a{,2}", "a{,2}", True), (r"\Qa.b\E", "a.b", True), (r"\Qa.b\E", "axb", False), (r"[^\s]", "\x0b", True), (r"x{2,3}?", "xx", True), (r"\v", "\x0b", True),
    ],
)
def test_regex_meaning(spark, pattern, text, found):
    assert spark.range(1).select(F.lit(text).rlike(re2_to_java(pattern))).first()[0] is found


@pytest.mark.parametrize("pattern", [r"(?!a)b", r"(?<=a)b", r"(?>a)", r"a++", r"a**", r"\1", r"(a", "a)", "*a", "[a", r"\k<x>", "a{1001}"])
def test_regexes_that_do_not_exist(pattern):
    with pytest.raises(RegexSyntaxError):
        re2_to_java(pattern)


def test_numbers(spark):
    rows = [("5",), ("-1.5e2",), (".5",), ("1d",), (" 5 ",), ("1e400",), ("Inf",), ("nan",), ("",), ("1_0",)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(number_of(F.col("x"))).collect()]
    assert got[:6] == [5, -150, 0.5, None, None, None]
    assert got[6] == float("inf") and got[7] != got[7] and got[8:] == [None, None]
    assert parse_number("3") == 3
    with pytest.raises(ValueError):
        parse_number("x")


def test_addresses(spark):
    assert parse_address("::ffff:1.2.3.4") == parse_address("1.2.3.4")
    assert parse_address("01.2.3.4") is None and parse_address("x") is None
    assert parse_prefix("10.1.2.3/8") == (4, "00001010")
    assert parse_prefix("10.0.0.0") is None
    frame = spark.createDataFrame([("198.51.100.4",), ("198.51.101.4",), ("::ffff:198.51.100.9",), ("x",), ("",), ("300.1.1.1",)], "ip string")
    assert [r[0] for r in frame.select(in_prefix(F.col("ip"), "198.51.100.0/24")).collect()] == [True, False, True, False, False, False]
    v6 = spark.createDataFrame([("2001:db8::1",), ("2001:db9::1",)], "ip string")
    assert [r[0] for r in v6.select(in_prefix(F.col("ip"), "2001:db8::/32")).collect()] == [True, False]
    bits = spark.createDataFrame([(x,) for x in ("10.1.2.3", "192.0.2.1", "203.0.113.5", "172.32.0.1", "127.0.0.1")], "ip string")
    assert [r[0] for r in bits.select(routable(bits_v4(F.col("ip")))).collect()] == [False, True, True, True, False]


def test_fields(spark):
    e = spark.createDataFrame([("", "", "t", "", "", "m", {"type": "inner", "path": "/x", "empty": ""})], "source string, host string, type string, src_ip string, user string, message string, fields map<string,string>")
    for name, want in {"type": ("t", True), "fields.type": ("inner", True), "path": ("/x", True), "fields.empty": ("", True), "nope": ("", False), "host": ("", False), "source": ("", True), "fields.": ("", False)}.items():
        assert tuple(e.select(*field_ref(name)).first()) == want, name
    ranks = spark.createDataFrame([("low",), ("critical",), ("x",)], "s string").select(severity_rank(F.col("s"))).collect()
    assert [r[0] for r in ranks] == [1, 4, 0]
