"""The registered queries: every operator over the driver's tables, with the DuckDB SQL that gives the same rows.

The tables hold no logs, so log lines and events are made from `events` by fixed expressions; the SQL gives the expected
fields straight from the columns, without parsing.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from datetime import datetime, timedelta, timezone

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import delete_folder, shared_folder
from ..functions.fields import severity_rank
from ..operators import detect, intel, stats, store
from ..operators.ledger import Store
from ..sources import feeds, parsers
from ..sources.follow import follow_lines
from ..streaming.detection import STATE, judged, live_alerts
from ..streaming.live import Counters, open_store, pipeline_stream
from . import sigma
from .conditions import compile_condition
from .rules import Rule, parse_rules, rule_table

NOW = datetime(2024, 2, 1, tzinfo=timezone.utc)
SINCE = datetime(2024, 1, 20, tzinfo=timezone.utc)

RULES = """
rules:
  - {id: errors, name: Repeated errors, description: "{count} errors of {group} within {window}", severity: high, type: threshold, where: {type: error}, group_by: user, threshold: 3, window: 24h, tags: [app]}
  - {id: kinds, name: Many kinds, severity: low, type: threshold, where: {source: json}, group_by: user, distinct: type, threshold: 3, window: 24h}
  - {id: errors-then-purchase, name: Purchase after errors, description: "{group}: {event.message}", severity: critical, type: sequence, where: {type: error}, then: {type: purchase}, group_by: user, threshold: 2, window: 24h}
  - {id: large, name: Large value, description: "{group} had {event.value}", severity: medium, type: match, where: {fields.value: {gte: 60}}, group_by: user, window: 48h, tags: [app, value]}
  - {id: every-large, name: Every large value, severity: low, type: match, where: {fields.value: {gte: 100}}}
  - {id: off, name: Disabled, severity: low, type: match, disabled: true, where: {type: view}}
"""

SIGMA = """
title: Slow pages asked for by tools
id: 0f0f
level: high
logsource: {category: webserver}
detection:
  selection:
    cs-method: GET
    cs-uri-stem|endswith: ['.PHP', '.asp']
  tool:
    cs-user-agent|startswith: 'Agent/1'
  query:
    cs-uri-query|re: 'k=[1-3]\\d$'
  range:
    c-ip|cidr: 203.0.2.0/24
  error:
    sc-status|gte: 500
  word:
    - 'click.ph?'
    - 'purch'
  filter_ref:
    cs-referer: null
  condition: selection and (1 of tool or query) and not error and (range or word) and filter_ref
"""

FEED_TEXT = {"first": ["# comment", "203.0.0.0/25", "203.0.1.7 ; one", "bad", "2001:db8::/32"], "second": ["203.0.0.64/26", "203.0.3.0/24 # all", "10.0.0.0/8"]}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ip(user: Column) -> Column:
    return F.concat(F.lit("203.0."), (user % 4).cast("string"), F.lit("."), (user % 256).cast("string"))


def _user(user: Column) -> Column:
    return F.concat(F.lit("user"), user.cast("string"))


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as log events."""
    return _as_logs(_table(spark, sf_dir, "events"))


def _as_logs(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"), F.lit("json").alias("source"), F.concat(F.lit("host"), (F.col("user_id") % 7).cast("string")).alias("host"), F.col("event_type").alias("type"), _ip(F.col("user_id")).alias("src_ip"),
        _user(F.col("user_id")).alias("user"), F.concat("event_type", F.lit(" k="), k).alias("message"), F.create_map(F.lit("k"), k, F.lit("value"), F.col("value").cast("string")).alias("fields"),
    )


_SQL_EVENTS = """
le AS (SELECT event_id AS id, ts AS timestamp, 'json' AS source, 'host' || (user_id % 7) AS host, event_type AS type,
  '203.0.' || (user_id % 4) || '.' || (user_id % 256) AS src_ip, 'user' || user_id AS "user", event_type || ' k=' || json_extract_string(props, '$.k') AS message,
  json_extract_string(props, '$.k') AS k, value FROM events)"""

_EVENT_COLUMNS = ["id", "timestamp", "type", "src_ip", "user", "message"]
_SQL_COLUMNS = 'id, timestamp, type, src_ip, "user", message'


def _plain(df: DataFrame) -> DataFrame:
    """Times without a zone, as the tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})




# -- parsing


def _status(e: DataFrame) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in ("200", "404", "503", "301")]), (F.col("event_id") % 4 + 1).cast("int"))


def nginx_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    stamp = F.concat(F.date_format(F.date_trunc("second", F.col("ts").cast("timestamp")), "dd/MMM/yyyy:HH:mm:ss"), F.lit(" "), F.date_format(F.col("ts").cast("timestamp"), "xx"))
    return e.select(
        "event_id",
        F.concat(
            _ip(F.col("user_id")), F.lit(" - "), F.when(F.col("event_id") % 3 == 0, "-").otherwise(_user(F.col("user_id"))), F.lit(" ["), stamp, F.lit('] "GET /'), F.col("event_type"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(".php?k="), k)).otherwise(""), F.lit(' HTTP/1.1" '),
            _status(e), F.lit(" "), k, F.lit(' "-" "agent/'), (F.col("event_id") % 5).cast("string"), F.lit('"'),
        ).alias("line"),
    )


def parse_nginx(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parsers.parse_lines(nginx_lines(spark, sf_dir), "nginx", NOW).filter("status = 'ok'")
    f = lambda k: F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit("-")).alias(k)
    return _plain(found.select("event_id", "timestamp", "source", "type", "src_ip", "user", "message", F.col("fields")["status"].alias("status"), *map(f, ("bytes", "method", "path", "uri_stem", "uri_query", "uri_extension", "user_agent", "referer"))))


_PARSE_NGINX = """
WITH x AS (SELECT *, json_extract_string(props, '$.k') AS k, event_id % 2 = 0 AS q FROM events),
y AS (SELECT *, '/' || event_type || CASE WHEN q THEN '.php' ELSE '' END AS stem, CASE WHEN q THEN 'k=' || k ELSE '-' END AS query FROM x)
SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS timestamp, 'nginx' AS source, 'http_request' AS type, '203.0.' || (user_id % 4) || '.' || (user_id % 256) AS src_ip,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE 'user' || user_id END AS "user", 'GET ' || stem || CASE WHEN q THEN '?' || query ELSE '' END || ' HTTP/1.1' AS message,
  ['200', '404', '503', '301'][event_id % 4 + 1] AS status, k AS bytes, 'GET' AS method, stem || CASE WHEN q THEN '?' || query ELSE '' END AS path, stem AS uri_stem, query AS uri_query,
  CASE WHEN q THEN 'php' ELSE '-' END AS uri_extension, 'agent/' || (event_id % 5) AS user_agent, '-' AS referer
FROM y
"""


def ssh_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    t = F.col("ts").cast("timestamp")
    head = F.concat(F.date_format(t, "MMM"), F.lit(" "), F.lpad(F.date_format(t, "d"), 2, " "), F.date_format(t, " HH:mm:ss"), F.lit(" web"), (F.col("user_id") % 7).cast("string"), F.lit(" sshd[1]: "))
    tail = F.concat(F.lit(" from "), _ip(F.col("user_id")), F.lit(" port "), (F.col("event_id") % 60000).cast("string"))
    user = _user(F.col("user_id"))
    said = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("Failed password for "), user, tail, F.lit(" ssh2")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("Failed none for invalid user "), user, tail))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("Accepted publickey for "), user, tail, F.lit(" ssh2: ED25519")))
        .when(F.col("event_type") == "click", F.concat(F.lit("Invalid user "), user, tail))
        .otherwise(F.lit("pam_unix(sshd:session): session closed for user x"))
    )
    return e.select("event_id", F.when(F.col("event_id") % 97 == 0, "garbage").when(F.col("event_id") % 101 == 0, " \t").otherwise(F.concat(head, said, F.lit("\r"))).alias("line"))


def parse_ssh(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parsers.parse_lines(ssh_lines(spark, sf_dir), "ssh", NOW).filter("status = 'ok'")
    f = lambda k: F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit("-")).alias(k)
    return _plain(found.select("event_id", "timestamp", "source", "host", "type", "src_ip", "user", *map(f, ("method", "port", "invalid_user"))))


_SSH_KEPT = "event_id % 97 <> 0 AND event_id % 101 <> 0"
_PARSE_SSH = f"""
SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS timestamp, 'ssh' AS source, 'web' || (user_id % 7) AS host,
  CASE event_type WHEN 'purchase' THEN 'auth_success' WHEN 'click' THEN 'invalid_user' ELSE 'auth_failure' END AS type, '203.0.' || (user_id % 4) || '.' || (user_id % 256) AS src_ip, 'user' || user_id AS "user",
  CASE event_type WHEN 'error' THEN 'password' WHEN 'signup' THEN 'none' WHEN 'purchase' THEN 'publickey' ELSE '-' END AS method, (event_id % 60000)::VARCHAR AS port, CASE WHEN event_type = 'signup' THEN 'true' ELSE '-' END AS invalid_user
FROM events WHERE event_type <> 'view' AND {_SSH_KEPT}
"""


def parse_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.parse_report(parsers.parse_lines(ssh_lines(spark, sf_dir), "ssh", NOW))


_PARSE_REPORT = f"""
SELECT count(*) FILTER (event_type <> 'view' AND {_SSH_KEPT}) AS accepted, count(*) FILTER (event_type = 'view' AND {_SSH_KEPT}) AS skipped, count(*) FILTER (event_id % 97 = 0) AS failed FROM events
"""


def parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    n = F.col("event_id").cast("string")
    seconds = F.concat((F.lit(1704067200) + F.col("event_id")).cast("string"), F.lit(".5"))
    stamp = F.concat(F.lit('"ts":"2024-01-02T03:04:05.25+01:00"'))
    line = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("[1,"), n, F.lit("]"))).otherwise(
        F.concat(F.lit("{"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"time":'), seconds)).otherwise(stamp), F.lit(',"event_type":"'), F.col("event_type"), F.lit('","ip":"'), _ip(F.col("user_id")), F.lit('","n":1e3,"id":'), n, F.lit(',"on":true,"off":null,"nested":{"a":1}} trailing'))
    )
    found = parsers.parse_lines(e.select("event_id", line.alias("line")), "json", NOW).filter("status = 'ok'")
    return found.select("event_id", F.unix_micros("timestamp").alias("micros"), "source", "type", "src_ip", *[F.col("fields")[k].alias(f"f_{k}") for k in ("n", "id", "on", "off")], F.size("fields").alias("n_fields"))


_PARSE_JSON = """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (1704067200 + event_id) * 1000000 + 500000 ELSE 1704161045250000 END::BIGINT AS micros, 'json' AS source, event_type AS type, '203.0.' || (user_id % 4) || '.' || (user_id % 256) AS src_ip,
  '1e3' AS f_n, event_id::VARCHAR AS f_id, 'true' AS f_on, '' AS f_off, 4 AS n_fields FROM events WHERE event_id % 50 <> 0
"""



def parse_hostile_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that no parser may stumble over: times out of bounds, numbers that JSON lacks, half characters."""
    e = _table(spark, sf_dir, "events")
    forms = ['{"time":"2024-13-01T00:00:00Z"}', '{"time":1e999}', '{"time":1e15}', '{"a":"\\ud800!"}', '{"a":NaN}', '{"a":1e999}', '{"a":', '{"ts":-1.5,"a":null}', '{"time":"2024-02-30T00:00:00Z","ts":1}', '{"time":"9999-12-31T23:59:59-23:00"}', '{"time":"0001-01-01T00:00:00+23:00"}', '{"ts":253402300799.5}', '{"ts":253402300800}', '{"ts":-62135596801}']
    line = F.element_at(F.array(*[F.lit(x) for x in forms]), (F.col("event_id") % len(forms) + 1).cast("int"))
    found = parsers.parse_lines(e.select("event_id", line.alias("line")), "json", NOW)
    return found.select("event_id", "status", F.coalesce(F.try_element_at("fields", F.lit("a")), F.lit("-")).alias("a"), F.coalesce(F.unix_micros("timestamp"), F.lit(-1).cast("long")).alias("micros"))


_HOSTILE_JSON = """
SELECT event_id, ['fail', 'fail', 'fail', 'ok', 'fail', 'ok', 'fail', 'ok', 'fail', 'fail', 'fail', 'ok', 'fail', 'fail'][event_id % 14 + 1] AS status, ['-', '-', '-', chr(65533) || '!', '-', '1e999', '-', '', '-', '-', '-', '-', '-', '-'][event_id % 14 + 1] AS a,
  [-1, -1, -1, 1706745600000000, -1, 1706745600000000, -1, -1500000, -1, -1, -1, 253402300799500000, -1, -1][event_id % 14 + 1] AS micros FROM events
"""


def parse_hostile_ssh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User names that look like messages of the server, and times that leave the years 1 to 9999 by their offset."""
    e = _table(spark, sf_dir, "events")
    said = ["Invalid user Accepted password for root from 198.51.100.1 port 22 from ", "error: Failed password for root from ", "Failed password for  from ", "Accepted password for a b from "]
    text = F.element_at(F.array(*[F.lit(x) for x in said]), (F.col("event_id") % len(said) + 1).cast("int"))
    times = ["Jan 10 00:00:00", "9999-12-31T23:59:59-23:00", "0001-01-01T00:00:00+23:00"]
    time = F.element_at(F.array(*[F.lit(x) for x in times]), F.when(F.col("event_id") % 5 > 0, 1).otherwise(F.col("event_id") % 2 + 2).cast("int"))
    line = F.concat(time, F.lit(" h sshd[1]: "), text, _ip(F.col("user_id")), F.lit(" port "), (F.col("event_id") % 60000).cast("string"))
    found = parsers.parse_lines(e.select("event_id", line.alias("line")), "ssh", NOW)
    return found.select("event_id", "status", "type", "user", "src_ip")


_HOSTILE_SSH = """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'fail' WHEN event_id % 4 = 2 THEN 'ok' ELSE 'skip' END AS status, CASE WHEN event_id % 4 = 2 THEN 'auth_failure' ELSE '' END AS type, '' AS "user",
  CASE WHEN event_id % 4 = 2 THEN '203.0.' || (user_id % 4) || '.' || (user_id % 256) ELSE '' END AS src_ip FROM events
"""

# -- predicates


def condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every operator of the rules' predicate language."""
    tests = {
        "type": {"in": ["error", "click", "view"], "not_in": ["view"]},
        "user": {"not": "user5", "prefix": "user", "exists": True},
        "fields.value": {"gte": 5, "lte": "40"},
        "k": {"regex": r"^[1-7]\d$"},
        "message": {"contains": "r"},
        "fields.missing": {"exists": False, "equals": "", "not_in": ["x"]},
        "source": "json",
    }
    return _plain(log_events(spark, sf_dir).filter(compile_condition(tests)).select(*_EVENT_COLUMNS))


_CONDITION = f"""
WITH {_SQL_EVENTS} SELECT {_SQL_COLUMNS} FROM le
WHERE type IN ('error', 'click') AND "user" <> 'user5' AND value BETWEEN 5 AND 40 AND regexp_matches(k, '^[1-7]\\d$') AND contains(message, 'r')
"""


def sigma_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web events that a Sigma rule's predicate holds for."""
    rule = sigma.compile_rule(sigma.parse_document(SIGMA))
    web = parsers.parse_lines(nginx_lines(spark, sf_dir), "nginx", NOW).filter("status = 'ok'")
    return web.filter(rule.matches()).select("event_id", "src_ip", "message", F.lit(rule.id).alias("rule_id"))


_SIGMA = """
WITH x AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events WHERE event_id % 2 = 0)
SELECT event_id, '203.0.' || (user_id % 4) || '.' || (user_id % 256) AS src_ip, 'GET /' || event_type || '.php?k=' || k || ' HTTP/1.1' AS message, 'sigma-0f0f' AS rule_id
FROM x WHERE (event_id % 5 = 1 OR regexp_matches(k, '^[1-3]\\d$')) AND event_id % 4 <> 2 AND (user_id % 4 = 2 OR event_type IN ('click', 'purchase'))
"""

SIGMA_FORMS = """
title: Either form
level: low
logsource: {product: nginx}
detection:
  asked: {uri_query|exists: true}
  plain: {uri_query|exists: 'false', sc-status: [404, 301]}
  odd:
    - {cs-uri-stem|startswith: /view}
    - {sc-bytes|lt: 10}
  condition:
    - asked and odd
    - plain and not odd
"""


def sigma_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests for existence, lists of maps and lists of conditions."""
    rule = sigma.compile_rule(sigma.parse_document(SIGMA_FORMS))
    web = parsers.parse_lines(nginx_lines(spark, sf_dir), "nginx", NOW).filter("status = 'ok'")
    return web.filter(rule.matches()).select("event_id", F.lit(rule.id).alias("rule_id"))


_SIGMA_FORMS = """
WITH x AS (SELECT event_id, event_id % 2 = 0 AS asked, event_id % 4 IN (1, 3) AS plain, event_type = 'view' OR json_extract_string(props, '$.k')::INTEGER < 10 AS odd FROM events)
SELECT event_id, 'sigma-either-form' AS rule_id FROM x WHERE (asked AND odd) OR (plain AND NOT odd)
"""


def sigma_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loading a folder of documents: what was skipped, by reason; and how often the loaded rules hold for web events."""
    base = "title: T\nlevel: low\nlogsource: {category: webserver}\ndetection:\n  a: {method: GET}\n  condition: "
    docs = {
        "a.yml": base + "a", "b.yml": base + "a", "c.yml": base.replace("title: T", "title: U") + "a", "d.yaml": base + "x", "e.yml": base.replace("webserver", "dns") + "a", "f.yml": "status: deprecated\n" + base + "a", "g.yml": base + "a | count() > 1",
        "h.yml": base.replace("method: GET", "method|base64: x") + "a", "i.yml": base.replace("level: low", "level: informational").replace("T", "V", 1) + "a", "j.yml": base + "a\n---\nx: 1", "k.yml": "correlation: {}\n" + base + "a", "l.yml": "- 1", "m.txt": "x",
    }
    with tempfile.TemporaryDirectory() as folder:  # rule files are read by the driver
        for name, text in docs.items():
            with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
                f.write(text)
        rules, report = sigma.load_paths([folder])
    web = parsers.parse_lines(nginx_lines(spark, sf_dir), "nginx", NOW).filter("status = 'ok'")
    matched = web.agg(*[F.count_if(r.matches()).alias(f"n{i}") for i, r in enumerate(rules)]).first()
    return report.table(spark).withColumns({"files": F.lit(report.files), "loaded": F.lit(report.loaded), "matches": F.lit(sum(matched)).cast("long")})


_SIGMA_REPORT = """
SELECT *, 12 AS files, 3 AS loaded, 3 * (SELECT count(*) FROM events) AS matches FROM (VALUES ('aggregation in condition', 1), ('correlation rule', 1), ('duplicate id', 1), ('invalid rule', 2), ('logsource', 1), ('modifier base64', 1), ('multi-document rule', 1), ('status deprecated', 1)) t(reason, rules)
"""

# -- detection


def _rules(*ids: str) -> list[Rule]:
    return [r for r in parse_rules(RULES) if not ids or r.id in ids]


def alerts(spark: SparkSession, sf_dir: str, *ids: str) -> DataFrame:
    return detect.evaluate(log_events(spark, sf_dir), _rules(*ids))


def _alert_rows(df: DataFrame) -> DataFrame:
    return _plain(df.select("rule_id", "severity", "group_key", "count", "description", "first_seen", "last_seen", F.size("event_ids").alias("n_ids"), F.element_at("event_ids", 1).alias("first_id"), F.element_at("event_ids", -1).alias("last_id")))


def _alerts_sql(rule: str, severity: str, candidates: str, description: str, hours: int = 24, group: str = '"user"') -> str:
    """Candidates (grp, timestamp, id, n, since, first_id, ids) thinned by suppression, which a recursion follows from fire to fire."""
    return f"""
WITH RECURSIVE {_SQL_EVENTS}, cand AS ({candidates}),
c AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY timestamp, id) AS rn FROM cand),
nx AS (SELECT c.*, (SELECT min(d.rn) FROM c AS d WHERE d.grp = c.grp AND d.timestamp >= c.timestamp + INTERVAL {hours} HOUR) AS nxt FROM c),
f AS (SELECT * FROM nx WHERE rn = 1 UNION ALL SELECT nx.* FROM f JOIN nx ON nx.grp = f.grp AND nx.rn = f.nxt)
SELECT '{rule}' AS rule_id, '{severity}' AS severity, grp AS group_key, n::INTEGER AS count, {description} AS description, since AS first_seen, timestamp AS last_seen, ids::INTEGER AS n_ids, first_id, id AS last_id FROM f
"""


def detect_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alert_rows(alerts(spark, sf_dir, "errors"))


_THRESHOLD = _alerts_sql(
    "errors", "high",
    """SELECT a."user" AS grp, a.timestamp, a.id, count(*) AS n, min(b.timestamp) AS since, arg_min(b.id, (b.timestamp, b.id)) AS first_id, count(*) AS ids
  FROM le a JOIN le b ON a."user" = b."user" AND b.type = 'error' AND b.timestamp > a.timestamp - INTERVAL 24 HOUR AND (b.timestamp, b.id) <= (a.timestamp, a.id)
  WHERE a.type = 'error' GROUP BY ALL HAVING count(*) >= 3""", "n || ' errors of ' || grp || ' within 24h0m0s'",
)


def detect_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alert_rows(alerts(spark, sf_dir, "kinds"))


_DISTINCT = _alerts_sql(
    "kinds", "low",
    """SELECT a."user" AS grp, a.timestamp, a.id, count(DISTINCT b.type) AS n, min(b.timestamp) AS since, arg_min(b.id, (b.timestamp, b.id)) AS first_id, count(*) AS ids
  FROM le a JOIN le b ON a."user" = b."user" AND b.timestamp > a.timestamp - INTERVAL 24 HOUR AND (b.timestamp, b.id) <= (a.timestamp, a.id) GROUP BY ALL HAVING count(DISTINCT b.type) >= 3""", "'Many kinds: ' || grp",
)


def detect_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alert_rows(alerts(spark, sf_dir, "errors-then-purchase"))


_SEQUENCE = _alerts_sql(
    "errors-then-purchase", "critical",
    """SELECT a."user" AS grp, a.timestamp, a.id, a.message AS m, count(*) AS n, min(b.timestamp) AS since, arg_min(b.id, (b.timestamp, b.id)) AS first_id, count(*) + 1 AS ids
  FROM le a JOIN le b ON a."user" = b."user" AND b.type = 'error' AND b.timestamp > a.timestamp - INTERVAL 24 HOUR AND (b.timestamp, b.id) < (a.timestamp, a.id)
  WHERE a.type = 'purchase' GROUP BY ALL HAVING count(*) >= 2""", "grp || ': ' || m",
)


def detect_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alert_rows(alerts(spark, sf_dir, "large"))


_MATCH = _alerts_sql("large", "medium", """SELECT "user" AS grp, timestamp, id, 1 AS n, timestamp AS since, id AS first_id, 1 AS ids, value FROM le WHERE value >= 60""", "grp || ' had ' || value::VARCHAR", 48)


def detect_every_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A match rule without a window fires on every event."""
    return _alert_rows(alerts(spark, sf_dir, "every-large"))


_EVERY = f"""
WITH {_SQL_EVENTS} SELECT 'every-large' AS rule_id, 'low' AS severity, '' AS group_key, 1 AS count, 'Every large value' AS description, timestamp AS first_seen, timestamp AS last_seen, 1 AS n_ids, id AS first_id, id AS last_id FROM le WHERE value >= 100
"""


def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules in one evaluation, counted."""
    return alerts(spark, sf_dir).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("alerts"), F.countDistinct("group_key").alias("groups"))


_ALL = "\nUNION ALL\n".join(f"SELECT rule_id, severity, count(*) AS alerts, count(DISTINCT group_key) AS groups FROM ({q}) GROUP BY ALL" for q in (_THRESHOLD, _DISTINCT, _SEQUENCE, _MATCH, _EVERY))

def detect_hit_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group remembers 10,000 hits at most: that many fire a rule, one more never do. Events are taken a dozen times."""
    rules = [Rule(id=f"r{n}", severity="low", kind="threshold", group_by="source", threshold=n, window=10**15).validate() for n in (10_000, 10_001)]
    few = _table(spark, sf_dir, "events").repartition(2 * spark.sparkContext.defaultParallelism, "event_id")  # a file of a few row groups is read by as few tasks; one task merges what all tell of the quantiles
    e = _as_logs(few).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("id", F.col("id") * 12 + F.col("j"))
    return _alert_rows(detect.evaluate(e, rules))


_HIT_CAP = """
WITH x AS (SELECT event_id * 12 + j AS id, ts, row_number() OVER (ORDER BY ts, event_id * 12 + j) AS rn FROM events, generate_series(0, 11) t(j))
SELECT 'r10000' AS rule_id, 'low' AS severity, 'json' AS group_key, 10000 AS count, 'r10000: json' AS description, min(ts) AS first_seen, max(ts) AS last_seen, 50 AS n_ids, arg_min(id, rn) FILTER (rn = 9951) AS first_id, max(id) FILTER (rn = 10000) AS last_id FROM x WHERE rn <= 10000
"""


_STREAM_EXPIRY = f"SELECT *, true AS remembered, 0::BIGINT AS \"left\" FROM (({_THRESHOLD}) UNION ALL ({_SEQUENCE}) UNION ALL ({_MATCH}))"


def _result(spark: SparkSession, rows: DataFrame, at: str) -> DataFrame:
    """The rows as a table of their own, so that the folder that they come from can go."""
    path = f"{shared_folder(spark)}/result-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    delete_folder(spark, at)
    return spark.read.schema(rows.schema).parquet(path)


def stream_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold rule over a stream of the events, by keyed state: the same alerts as over the table."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(_table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as a stream's path must be no plain file
    live = live_alerts(_as_logs(source), _rules("errors"))
    live.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/alerts/{n}")).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _result(spark, _alert_rows(spark.read.parquet(f"{at}/alerts/*")), at)


def stream_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rules over a stream that is stopped and started again twice; at last an event of ten days later, which no rule concerns. The alerts are the table's, and no state is left."""
    at = f"{shared_folder(spark)}/expiry-{uuid.uuid4().hex}"
    e = _table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = e.agg(F.percentile_approx(micros, [0.33, 0.67])).first()[0]
    third = sum((micros >= c).cast("int") for c in cuts)
    end = e.agg(F.max("event_id").alias("event_id"), (F.max("ts") + F.expr("INTERVAL 10 DAYS")).alias("ts")).withColumn("event_type", F.lit("end"))
    held = []
    for part in (*[e.filter(third == n) for n in range(3)], spark.createDataFrame([], e.schema).unionByName(end, allowMissingColumns=True)):
        part.write.mode("append").parquet(f"{at}/events")
        live = live_alerts(_as_logs(spark.readStream.schema(e.schema).parquet(f"{at}/events")), _rules("errors", "errors-then-purchase", "large"))
        query = live.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/alerts/{n}")).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    out = _alert_rows(spark.read.parquet(f"{at}/alerts/*")).withColumns({"remembered": F.lit(all(held[:3])), "left": F.lit(held[3]).cast("long")})
    return _result(spark, out, at)


def _json_lines(e: DataFrame) -> DataFrame:
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return e.select(F.to_json(F.struct(stamp.alias("time"), "type", "user", F.col("src_ip").alias("ip"), F.col("fields")["value"].alias("value"))).alias("line"))


def _live(spark: SparkSession, sf_dir: str) -> tuple[str, Store, Counters]:
    """The events as JSON lines in a folder, taken through the live path."""
    at = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    _json_lines(log_events(spark, sf_dir)).write.text(f"{at}/in")
    counters, held = Counters(), open_store(spark, f"{at}/store")
    pipeline_stream(parsers.stream_lines(spark, f"{at}/in"), "json", _rules("errors", "kinds"), held, f"{at}/checkpoint", counters=counters, now=NOW, trigger={"availableNow": True}).awaitTermination()
    return at, held, counters


def _with_stored(held: Store) -> DataFrame:
    """Stored alerts, and how many of the ids that they carry are stored events of their group."""
    alerts = held.alerts()
    named = alerts.select("id", F.explode("event_ids").alias("event_id"), "group_key").join(held.events().select(F.col("id").alias("event_id"), F.col("user").alias("group_key")), ["event_id", "group_key"])
    return _plain(alerts.join(named.groupBy("id").agg(F.count(F.lit(1)).alias("n_stored")), "id").select("rule_id", "group_key", "count", "last_seen", "n_stored"))


def live_alerts_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the live path with their stored events."""
    at, held, _ = _live(spark, sf_dir)
    return _result(spark, _with_stored(held), at)


def follow_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files followed as they are rotated: the earlier half of the events lies in some files, which get new names once they have been read, and files of the later half take their place."""
    at = f"{shared_folder(spark)}/follow-{uuid.uuid4().hex}"
    e = log_events(spark, sf_dir)
    half = e.agg(F.percentile_approx(F.unix_micros("timestamp"), 0.5)).first()[0]
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{at}/logs"))
    folder = fs.resolvePath(path(f"{at}/logs")).toUri().getPath()  # the followed files are opened by their plain paths
    for later in (False, True, None):
        if later is not None:
            _json_lines(e.filter((F.unix_micros("timestamp") >= half) == later)).repartition(4).write.text(f"{at}/{later}")
            for n, part in enumerate(fs.globStatus(path(f"{at}/{later}/part-*"))):
                name = f"{at}/logs/{n}.log"
                if later:
                    fs.rename(path(name), path(f"{name}.1"))
                fs.rename(part.getPath(), path(name))
        lines = follow_lines(spark, f"{folder}/*.log", from_start=True)
        parsed = parsers.events_of(parsers.parse_lines(lines, "json", NOW))
        parsed.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/events").awaitTermination()
    out = spark.read.schema(parsed.schema).parquet(f"{at}/events")
    return _result(spark, _plain(out.groupBy("user", "type").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))), at)


_FOLLOW = f"WITH {_SQL_EVENTS} SELECT \"user\", type, count(*) AS n, min(timestamp) AS first, max(timestamp) AS last FROM le GROUP BY ALL"


def live_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, _, c = _live(spark, sf_dir)
    delete_folder(spark, at)
    return spark.createDataFrame([(c.ingested, c.alerts, c.store_failures, c.queued)], "ingested bigint, alerts bigint, store_failures bigint, queued bigint")


_LIVE_ALERTS = f"SELECT rule_id, group_key, count, last_seen, n_ids::BIGINT AS n_stored FROM ({_THRESHOLD}) UNION ALL SELECT rule_id, group_key, count, last_seen, n_ids::BIGINT FROM ({_DISTINCT})"
_LIVE_COUNTERS = f"SELECT (SELECT count(*) FROM events) AS ingested, (SELECT count(*) FROM ({_LIVE_ALERTS})) AS alerts, 0::BIGINT AS store_failures, 0::BIGINT AS queued"


class Killed(RuntimeError):
    """The end that a crash would make of a stream."""


class _Mortal(Store):
    """A store whose process dies once before it commits a batch, and once right after it has."""

    def __init__(self, spark: SparkSession, path: str, before: int, after: int):
        super().__init__(spark, path, STATE)
        self.before, self.after = {before}, {after}

    def commit_batch(self, batch: int, **tables) -> int:
        if batch in self.before:
            self.before.remove(batch)
            for name in ("events", "alerts"):  # what it has written by then lies about
                tables.get(name) is not None and self.write(tables[name], name, f"batch-{batch}")
            raise Killed("before the commit")
        out = super().commit_batch(batch, **tables)
        if batch in self.after:
            self.after.remove(batch)
            raise Killed("after the commit")
        return out


def live_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches, in the order of time; the process dies between writing and commit of the second, and after the commit of the third, before Spark knows of it. Restarted, both times Spark replays
    the batch: the alerts are those of a run without crashes, and every event is stored once."""
    at = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    held = _Mortal(spark, f"{at}/store", before=1, after=2)
    e = log_events(spark, sf_dir)
    cuts = e.agg(F.percentile_approx(F.unix_micros("timestamp"), [0.25, 0.5, 0.75])).first()[0]
    quarter = sum((F.unix_micros("timestamp") >= c).cast("int") for c in cuts)
    for n in range(4):
        # a quarter is one batch, so it has fewer files than a batch may have
        _json_lines(e.filter(quarter == n)).repartition(min(32, int(spark.conf.get("spark.sql.shuffle.partitions")))).write.mode("append").text(f"{at}/in")
        for _ in range(2):  # the second run is the restart
            query = pipeline_stream(parsers.stream_lines(spark, f"{at}/in"), "json", _rules("errors", "kinds"), held, f"{at}/checkpoint", now=NOW, trigger={"availableNow": True})
            try:
                query.awaitTermination()
                break
            except StreamingQueryException:
                held = open_store(spark, f"{at}/store") if not held.before | held.after else held
    events = held.events()
    out = _with_stored(held).withColumns({"n_events": F.lit(events.count()).cast("long"), "n_event_ids": F.lit(events.select("id").distinct().count()).cast("long")})
    return _result(spark, out, at)


_LIVE_REPLAY = f"SELECT *, (SELECT count(*) FROM events) AS n_events, (SELECT count(*) FROM events) AS n_event_ids FROM ({_LIVE_ALERTS})"


def _filled(spark: SparkSession, sf_dir: str, batches: int) -> tuple[str, Store]:
    """A store with the events in batches of equal ranges of ids, and the alerts of one rule."""
    at = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    held, e = open_store(spark, at), log_events(spark, sf_dir)
    low, high = e.agg(F.min("id"), F.max("id")).first()
    for n in range(batches):
        part = e.filter(F.expr(f"(id - {low}) * {batches} div {high - low + 1} = {n}"))
        found = store.as_alerts(detect.evaluate(part, _rules("every-large")).withColumn("id", F.element_at("event_ids", 1)), NOW)
        held.commit_batch(n, events=part, alerts=found.select(*held.schemas["alerts"].names))
    return at, held


def store_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old events are removed from the store: files of whole days without reading them, those of the day at the edge by rewriting; alerts stay."""
    at, held = _filled(spark, sf_dir, 3)
    files = {p.path for p in held.parts("events")}
    done = held.expire(NOW - timedelta(hours=6), timedelta(days=7))
    left = {p.path for p in held.parts("events")}
    e = held.events()
    out = e.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).withColumns({"alerts": F.lit(held.alerts().count()).cast("long"), "gone": F.lit(done["rows"]).cast("long"), "by_file": F.lit(done["removed"] > done["rewritten"] > 0 and len(files - left) == done["removed"] + done["rewritten"])})
    return _result(spark, out, at)


_STORE_RETENTION = f"""
WITH {_SQL_EVENTS}, k AS (SELECT * FROM le WHERE date_trunc('millisecond', timestamp) >= TIMESTAMP '2024-01-24 18:00:00')
SELECT type, count(*) AS n, min(id) AS first, (SELECT count(*) FROM le WHERE value >= 100) AS alerts, (SELECT count(*) FROM le) - (SELECT count(*) FROM k) AS gone, true AS by_file FROM k GROUP BY ALL
"""


def store_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page and single events from the store: only files that can hold them are opened."""
    at, held = _filled(spark, sf_dir, 8)
    total, (low, high) = len(held.parts("events")), held.events().agg(F.min("id"), F.max("id")).first()
    opened: list[int] = []
    table = held.table
    held.table = lambda name, parts=None: opened.append(len(parts)) or table(name, parts)
    before = low + (high - low + 1) // 2
    page = held.page(100, before_id=before, where=F.col("type") == "click")
    some = held.get_events([low, low + 1, high])
    out = page.select("id", F.lit("page").alias("asked")).unionByName(some.select("id", F.lit("ids").alias("asked"))).withColumn("few_files", F.lit(all(n < 0.6 * total for n in opened)))
    return _result(spark, out, at)


_STORE_PAGE = f"""
WITH {_SQL_EVENTS}, b AS (SELECT min(id) AS low, max(id) AS high FROM le)
(SELECT id, 'page' AS asked, true AS few_files FROM le, b WHERE type = 'click' AND id < low + (high - low + 1) // 2 ORDER BY id DESC LIMIT 100)
UNION ALL SELECT id, 'ids', true FROM le, b WHERE id IN (low, low + 1, high)
"""


def engine_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that a rule still remembers after all events: those with a hit in the last window, or still quiet."""
    left = judged(log_events(spark, sf_dir), spark.createDataFrame([], STATE), _rules("errors")).filter("fire is null")
    return _plain(left.select("grp", F.timestamp_micros("seen").alias("seen")))


_ENGINE_STATE = f"""
WITH f AS ({_THRESHOLD}), s AS (SELECT 'user' || user_id AS grp, max(ts) AS seen FROM events WHERE event_type = 'error' GROUP BY ALL)
SELECT grp, seen FROM s WHERE (SELECT max(ts) FROM events) - seen <= INTERVAL 24 HOUR OR (SELECT max(last_seen) FROM f WHERE group_key = grp) + INTERVAL 24 HOUR > (SELECT max(ts) FROM events)
"""

# -- enrichment


def _prefixes(spark: SparkSession) -> DataFrame:
    out = None
    for i, (name, lines) in enumerate(FEED_TEXT.items()):
        t = feeds.parse_feed(spark.createDataFrame([(x,) for x in lines], "line string"), i, name)
        out = t if out is None else out.unionByName(t)
    return out


def _feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of the addresses that errors came from, with networks, comments and wrong entries between."""
    e = log_events(spark, sf_dir)
    errors = e.filter("type = 'error'").select(F.concat("src_ip", F.lit(" # seen")).alias("line"))
    networks = e.select(F.concat(F.lit("  "), "src_ip", F.lit("/24;"), "type").alias("line"))
    return errors.unionByName(networks.filter("line like '%purchase'")).unionByName(e.select(F.concat(F.lit("user "), "user").alias("line")))


def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.parse_feed(_feed_lines(spark, sf_dir), 0, "errors").groupBy("feed", "family", "len").agg(F.count(F.lit(1)).alias("entries"))


_FEED_ENTRIES = f"""
WITH {_SQL_EVENTS}
SELECT 'errors' AS feed, 4 AS family, 32 AS len, count(DISTINCT src_ip) AS entries FROM le WHERE type = 'error' HAVING count(*) > 0
UNION ALL SELECT 'errors', 4, 24, count(DISTINCT split_part(src_ip, '.', 3)) FROM le WHERE type = 'purchase' HAVING count(*) > 0
"""


def enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intel.enrich(log_events(spark, sf_dir), _prefixes(spark))
    return found.select("id", "src_ip", F.coalesce(F.try_element_at("fields", F.lit("ti_lists")), F.lit("")).alias("ti_lists"), F.size("fields").alias("n_fields"))


_ENRICH = f"""
WITH {_SQL_EVENTS}, p AS (SELECT id, src_ip, split_part(src_ip, '.', 3)::INTEGER AS c, split_part(src_ip, '.', 4)::INTEGER AS d FROM le),
q AS (SELECT id, src_ip, (c = 0 AND d < 128) OR (c = 1 AND d = 7) AS a, (c = 0 AND d BETWEEN 64 AND 127) OR c = 3 AS b FROM p)
SELECT id, src_ip, CASE WHEN a AND b THEN 'first,second' WHEN a THEN 'first' WHEN b THEN 'second' ELSE '' END AS ti_lists, CASE WHEN a OR b THEN 3 ELSE 2 END AS n_fields FROM q
"""


def feed_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed that is renewed when its time has come: its new content holds, and a refresh that fails keeps what there was and says so. Events are flagged by the second of three versions."""
    at = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    lines = _feed_lines(spark, sf_dir)
    found = feeds.FeedSet(spark, [feeds.Feed("kept", f"{at}/feed"), feeds.Feed("never", f"{at}/missing")], timedelta(hours=6), f"{at}/tables")
    asked = []
    for hours, text in ((0, lines.filter("line like '%/24;%'")), (5, lines), (6, lines.filter("line like '%seen'")), (12, lines.filter("line like 'user%'"))):
        text.write.mode("overwrite").text(f"{at}/feed")
        asked.append(found.refresh_if_due(NOW + timedelta(hours=hours)))
    status = {r["feed"]: (r["error"] != "", r["loaded_at"] is not None) for r in found.status().collect()}
    rows = intel.enrich(log_events(spark, sf_dir), found.prefixes()).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count(F.try_element_at("fields", F.lit("ti_lists"))).alias("flagged"))
    states = asked == [True, False, True, True] and status == {"kept": (True, True), "never": (True, False)}
    return _result(spark, rows.withColumn("as_told", F.lit(states)), at)


_FEED_REFRESH = f"""
WITH {_SQL_EVENTS}, bad AS (SELECT DISTINCT src_ip FROM le WHERE type = 'error')
SELECT type, count(*) AS n, count(*) FILTER (src_ip IN (SELECT src_ip FROM bad)) AS flagged, true AS as_told FROM le GROUP BY ALL
"""

# -- store


def list_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of one type since a time (a page of 100 is the feature)."""
    return _plain(store.list_events(log_events(spark, sf_dir), type="click", source="json", since=SINCE, before_id=900_000).select(*_EVENT_COLUMNS))


_LIST_EVENTS = f"WITH {_SQL_EVENTS} SELECT {_SQL_COLUMNS} FROM le WHERE type = 'click' AND timestamp >= TIMESTAMP '2024-01-20' AND id < 900000 ORDER BY id DESC LIMIT 100"


def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(log_events(spark, sf_dir).filter(store.message_has("ERROR K=1")).select(*_EVENT_COLUMNS))


_SEARCH = f"WITH {_SQL_EVENTS} SELECT {_SQL_COLUMNS} FROM le WHERE contains(message, 'error k=1')"


def get_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(store.get_events(log_events(spark, sf_dir), [1, 5, 77, 990, 10**12]).select(*_EVENT_COLUMNS))


_GET = f"WITH {_SQL_EVENTS} SELECT {_SQL_COLUMNS} FROM le WHERE id IN (1, 5, 77, 990)"


def _stored_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of one match rule with the id of their event, as stored: a third acknowledged later."""
    found = alerts(spark, sf_dir, "every-large").withColumn("id", F.element_at("event_ids", 1)).withColumn("created_at", F.col("last_seen"))
    found = found.withColumn("group_key", F.concat(F.lit("user"), (F.col("id") % 11).cast("string"))).withColumn("severity", F.when(F.col("id") % 2 == 0, "high").otherwise("low"))
    log = found.filter("id % 3 = 0").select(F.col("id").alias("alert_id"), F.lit("closed").alias("status"), F.lit(1).alias("seq"))
    log = log.unionByName(found.filter("id % 6 = 0").select(F.col("id").alias("alert_id"), F.lit("acknowledged").alias("status"), F.lit(2).alias("seq")))
    return store.with_status(found, log)


_SQL_ALERTS = f"""{_SQL_EVENTS}, al AS (SELECT id, 'user' || (id % 11) AS group_key, CASE WHEN id % 2 = 0 THEN 'high' ELSE 'low' END AS severity, timestamp AS last_seen,
  CASE WHEN id % 6 = 0 THEN 'acknowledged' WHEN id % 3 = 0 THEN 'closed' ELSE 'open' END AS status FROM le WHERE value >= 100)"""


def list_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(store.list_alerts(_stored_alerts(spark, sf_dir), status="open", severity="low", limit=50).select("id", "group_key", "severity", "status", "last_seen"))


_LIST_ALERTS = f"WITH {_SQL_ALERTS} SELECT id, group_key, severity, status, last_seen FROM al WHERE status = 'open' AND severity = 'low' ORDER BY id DESC LIMIT 50"


def alert_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.alerts_by_status(_stored_alerts(spark, sf_dir))


_ALERT_STATUS = f"WITH {_SQL_ALERTS} SELECT status, count(*) AS n FROM al GROUP BY ALL"


def alert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alerts(spark, sf_dir, "errors").withColumn("id", F.element_at("event_ids", -1))
    return store.alert_events(found, log_events(spark, sf_dir)).groupBy("alert_id").agg(F.count(F.lit(1)).alias("events"), F.min("id").alias("first"), F.sum("id").alias("total"))


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = store.kept_events(log_events(spark, sf_dir), NOW, timedelta(days=7))
    return kept.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


_RETENTION = f"WITH {_SQL_EVENTS} SELECT type, count(*) AS n, min(id) AS first FROM le WHERE timestamp >= TIMESTAMP '2024-01-25' GROUP BY ALL"


def assign_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in time order, over rows with all their columns."""
    e = log_events(spark, sf_dir).withColumnRenamed("id", "event_id")
    return store.with_ids(e, after=100, order=("timestamp", "event_id")).select("id", "event_id", "user", "message", "src_ip", F.col("fields")["value"].cast("double").alias("value"))


_ASSIGN = f"WITH {_SQL_EVENTS} SELECT 100 + row_number() OVER (ORDER BY timestamp, id) AS id, id AS event_id, \"user\", message, src_ip, value::DOUBLE AS value FROM le"

# -- statistics


def stats_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.totals(log_events(spark, sf_dir), SINCE)


_TOTALS = "SELECT count(*) AS total_events, count(*) FILTER (ts >= TIMESTAMP '2024-01-20') AS window_events FROM events"


def stats_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.events_by_type(log_events(spark, sf_dir), SINCE)


_BY_TYPE = "SELECT event_type AS type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY ALL"


def stats_top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_sources(log_events(spark, sf_dir), SINCE)


_TOP = f"WITH {_SQL_EVENTS} SELECT src_ip, count(*) AS n FROM le WHERE timestamp >= TIMESTAMP '2024-01-20' GROUP BY ALL ORDER BY n DESC, src_ip LIMIT 10"


def stats_top_alerted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_alerted(_stored_alerts(spark, sf_dir), SINCE)


_TOP_ALERTED = f"WITH {_SQL_ALERTS} SELECT group_key, count(*) AS n FROM al WHERE last_seen >= TIMESTAMP '2024-01-20' GROUP BY ALL ORDER BY n DESC, group_key LIMIT 10"


def stats_open_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.open_by_severity(_stored_alerts(spark, sf_dir))


_OPEN = f"WITH {_SQL_ALERTS} SELECT severity, count(*) AS n FROM al WHERE status = 'open' GROUP BY ALL"


def stats_open_and_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.open_and_high(_stored_alerts(spark, sf_dir))


_OPEN_HIGH = f"WITH {_SQL_ALERTS} SELECT count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'open' AND severity IN ('high', 'critical')) AS high FROM al"


def stats_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    since, now = SINCE + timedelta(minutes=7), SINCE + timedelta(hours=20)
    return _plain(stats.timeline(log_events(spark, sf_dir), _stored_alerts(spark, sf_dir), since, now, timedelta(minutes=15)))


_TIMELINE = f"""
WITH {_SQL_ALERTS}, g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-20', TIMESTAMP '2024-01-20 20:00:00', INTERVAL 15 MINUTE)) AS start),
e AS (SELECT time_bucket(INTERVAL 15 MINUTE, timestamp) AS start, count(*) AS n FROM le WHERE timestamp BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-20 20:00:00' GROUP BY ALL),
a AS (SELECT time_bucket(INTERVAL 15 MINUTE, last_seen) AS start, count(*) AS n FROM al WHERE last_seen BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-20 20:00:00' GROUP BY ALL)
SELECT g.start, coalesce(e.n, 0) AS events, coalesce(a.n, 0) AS alerts FROM g LEFT JOIN e USING (start) LEFT JOIN a USING (start)
"""


def stats_default_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's ranges: the last day's timeline, in buckets of that range."""
    span, width = stats.range_preset("24h")
    return _plain(stats.timeline(log_events(spark, sf_dir), _stored_alerts(spark, sf_dir), SINCE - span, SINCE, width))


_DEFAULT_RANGE = _TIMELINE.replace("2024-01-20 20:00:00", "@").replace("2024-01-20", "2024-01-19").replace("@", "2024-01-20")


def stats_flagged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top sources joined with alert counts: alerts here are grouped by address."""
    e = log_events(spark, sf_dir)
    found = e.filter(F.col("fields")["value"].cast("double") >= 60).select(F.col("src_ip").alias("group_key"), F.col("timestamp").alias("created_at"))
    return stats.flagged_sources(e, found, SINCE)


_FLAGGED = f"""
WITH {_SQL_EVENTS}, t AS (SELECT src_ip, count(*) AS n FROM le WHERE timestamp >= TIMESTAMP '2024-01-20' GROUP BY ALL ORDER BY n DESC, src_ip LIMIT 10),
a AS (SELECT src_ip, count(*) AS m FROM le WHERE timestamp >= TIMESTAMP '2024-01-20' AND value >= 60 GROUP BY ALL ORDER BY m DESC, src_ip LIMIT 10)
SELECT src_ip, n, coalesce(m, 0) AS alerts FROM t LEFT JOIN a USING (src_ip)
"""


def _rules_and_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = rule_table(spark, [*_rules(), sigma.compile_rule(sigma.parse_document(SIGMA))])
    return table.join(alerts(spark, sf_dir).groupBy(F.col("rule_id").alias("id")).agg(F.count(F.lit(1)).alias("alerts")), "id", "left").withColumn("alerts", F.coalesce("alerts", F.lit(0)))


def rule_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by a word, with the alerts that they have raised."""
    return stats.search_rules(_rules_and_alerts(spark, sf_dir), "LARGE").select("id", "name", "severity", severity_rank(F.col("severity")).alias("rank"), "alerts")


_RULE_SEARCH = f"SELECT t.*, (SELECT count(*) FROM ({_MATCH})) AS alerts FROM (VALUES ('large', 'Large value', 'medium', 2)) t(id, name, severity, rank) UNION ALL SELECT t.*, (SELECT count(*) FROM ({_EVERY})) FROM (VALUES ('every-large', 'Every large value', 'low', 1)) t(id, name, severity, rank)"


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by their state, and how many of them have raised alerts."""
    table = _rules_and_alerts(spark, sf_dir)
    return stats.rule_counts(table).withColumn("fired", F.lit(table.filter("alerts > 0").count()).cast("long"))


_RULE_COUNTS = f"SELECT 6::BIGINT AS active, 6::BIGINT AS builtin, 1::BIGINT AS sigma, (SELECT count(*) FROM ({_ALL}) WHERE alerts > 0) AS fired"

_ALERT_EVENTS = f"""
WITH {_SQL_EVENTS}, f AS ({_THRESHOLD})
SELECT f.last_id AS alert_id, count(*) AS events, min(b.id) AS first, sum(b.id)::BIGINT AS total
FROM f JOIN le b ON b."user" = f.group_key AND b.type = 'error' AND (b.timestamp, b.id) BETWEEN (f.first_seen, f.first_id) AND (f.last_seen, f.last_id) GROUP BY ALL
"""

_ALL_QUERIES = (
    (parse_nginx, _PARSE_NGINX), (parse_ssh, _PARSE_SSH), (parse_json, _PARSE_JSON), (parse_report, _PARSE_REPORT), (parse_hostile_json, _HOSTILE_JSON), (parse_hostile_ssh, _HOSTILE_SSH), (condition, _CONDITION), (sigma_rule, _SIGMA), (sigma_forms, _SIGMA_FORMS), (sigma_report, _SIGMA_REPORT),
    (detect_threshold, _THRESHOLD), (detect_distinct, _DISTINCT), (detect_sequence, _SEQUENCE), (detect_match, _MATCH), (detect_every_match, _EVERY), (detect_all, _ALL), (detect_hit_cap, _HIT_CAP),
    (stream_threshold, _THRESHOLD), (stream_expiry, _STREAM_EXPIRY), (live_alerts_stored, _LIVE_ALERTS), (live_counters, _LIVE_COUNTERS), (follow_rotation, _FOLLOW), (live_replay, _LIVE_REPLAY), (engine_state, _ENGINE_STATE), (store_retention, _STORE_RETENTION), (store_page, _STORE_PAGE),
    (feed_entries, _FEED_ENTRIES), (feed_refresh, _FEED_REFRESH), (enrich, _ENRICH), (list_events, _LIST_EVENTS), (search_events, _SEARCH), (get_events, _GET), (list_alerts, _LIST_ALERTS), (alert_status, _ALERT_STATUS), (alert_events, _ALERT_EVENTS),
    (retention, _RETENTION), (assign_ids, _ASSIGN), (stats_totals, _TOTALS), (stats_by_type, _BY_TYPE), (stats_top_sources, _TOP), (stats_top_alerted, _TOP_ALERTED), (stats_open_by_severity, _OPEN), (stats_open_and_high, _OPEN_HIGH),
    (stats_timeline, _TIMELINE), (stats_default_range, _DEFAULT_RANGE), (stats_flagged_sources, _FLAGGED), (rule_search, _RULE_SEARCH), (rule_counts, _RULE_COUNTS),
)

QUERIES = {f.__name__: f for f, _ in _ALL_QUERIES}
ORACLE_SQL = {f.__name__: sql for f, sql in _ALL_QUERIES}
