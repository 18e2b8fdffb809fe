from collections import Counter
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest

import quarrylight.plans
from quarrylight.operators.detect import evaluate
from quarrylight.operators.store import with_ids
from quarrylight.plans.rules import load_rules
from quarrylight.sources.config import parse_config
from quarrylight.sources.parsers import events_of, parse_lines
from quarrylight.sources.samples import ATTACKS, lines

RULES = str(Path(quarrylight.plans.__file__).parent / "default_rules.yaml")


def test_config(monkeypatch):
    c = parse_config("inputs: [{path: /logs, parser: ssh}]\nretention: 48h\nsigma: {min_level: high, dedup_window: 1h}\nthreat_intel: {feeds: [{name: a, path: x}]}\nauth_token: t")
    assert c.inputs[0].parser == "ssh" and c.retention == 48 * 3_600_000_000 and c.sigma.min_level == "high" and c.sigma.dedup == 3_600_000_000 and c.feeds[0].name == "a" and c.auth_token == "t"
    assert parse_config("").retention == 7 * 86_400_000_000 and parse_config("").feeds_refresh == 6 * 3_600_000_000
    monkeypatch.setenv("ENGINE_AUTH_TOKEN", "env")
    assert parse_config("auth_token: t").auth_token == "env"
    for wrong in ("bogus: 1", "webhook: {bogus: 1}", "inputs: [{path: a, parser: x}]", "webhook: {min_severity: x}", "[1]"):
        with pytest.raises(ValueError):
            parse_config(wrong)


def test_default_rules_end_to_end(spark):
    """Attack lines among ordinary ones: the rules fire for the attackers, and for nobody else."""
    rules = load_rules(RULES)
    assert len(rules) == 10
    start = datetime(2025, 3, 14, 9, tzinfo=timezone.utc)
    made = lines(1, start, 210)
    events = None
    for parser in ("ssh", "nginx"):
        frame = spark.createDataFrame([(x,) for p, x in made if p == parser], "line string")
        part = events_of(parse_lines(frame, parser, start + timedelta(hours=1)))
        events = part if events is None else events.unionByName(part)
    alerts = evaluate(with_ids(events, order=("timestamp", "source", "message")), rules).collect()
    assert len(ATTACKS) == 7
    assert Counter((a.rule_id, a.group_key.rsplit(".", 1)[1]) for a in alerts) == Counter(
        {("ssh-bruteforce", "1"): 1, ("ssh-password-spray", "2"): 1, ("ssh-bruteforce", "3"): 1, ("ssh-success-after-bruteforce", "3"): 1, ("ssh-root-login", "4"): 1, ("web-scan", "5"): 1, ("web-sensitive-file", "5"): 1, ("web-injection-attempt", "6"): 1, ("web-auth-bruteforce", "7"): 1}
    )
    assert all(a.group_key.startswith("203.0.113.") for a in alerts)
