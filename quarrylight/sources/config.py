"""Configuration of a deployment: one YAML document with known keys only."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import yaml

from ..functions.durations import parse_duration
from ..functions.fields import SEVERITIES
from ..plans.sigma import DEFAULT_DEDUP, Options
from .feeds import Feed, validate_feeds
from .parsers import PARSERS

DAY = 86_400_000_000


@dataclass
class Input:
    path: str
    parser: str
    from_start: bool = False


@dataclass
class EngineConfig:
    """Durations are microseconds. Inputs are folders that log files are shipped into."""

    events: str = "events"
    alerts: str = "alerts"
    rules: str = ""
    retention: int = 7 * DAY
    inputs: list[Input] = field(default_factory=list)
    webhook_url: str = ""
    webhook_min_severity: str = "low"
    sigma_paths: list[str] = field(default_factory=list)
    sigma: Options = field(default_factory=Options)
    feeds_refresh: int = DAY // 4
    feeds: list[Feed] = field(default_factory=list)
    auth_token: str = ""


#: Keys of each section.
_KEYS = {
    "": {"events", "alerts", "rules", "retention", "inputs", "webhook", "sigma", "threat_intel", "auth_token"},
    "inputs": {"path", "parser", "from_start"},
    "webhook": {"url", "min_severity"},
    "sigma": {"paths", "min_level", "include_proxy", "dedup_window"},
    "threat_intel": {"refresh", "feeds"},
    "feeds": {"name", "url", "path"},
}


def _section(raw, name: str) -> dict:
    raw = raw or {}
    if not isinstance(raw, dict):
        raise ValueError(f"{name or 'config'}: not a mapping")
    unknown = set(raw) - _KEYS[name]
    if unknown:
        raise ValueError(f"{name or 'config'}: unknown key {sorted(unknown)[0]}")
    return raw


def parse_config(text: str, token_from: str = "ENGINE_AUTH_TOKEN") -> EngineConfig:
    """The configuration; an environment variable's token wins over the file's."""
    top = _section(yaml.safe_load(text), "")
    hook, sigma, intel = (_section(top.get(k), k) for k in ("webhook", "sigma", "threat_intel"))
    out = EngineConfig(**{k: str(top[k]) for k in ("events", "alerts", "rules", "auth_token") if top.get(k)})
    out.retention = parse_duration(top["retention"]) if top.get("retention") else out.retention
    for raw in top.get("inputs") or []:
        entry = Input(**_section(raw, "inputs"))
        if entry.parser not in PARSERS:
            raise ValueError(f"inputs: unknown parser {entry.parser!r}")
        out.inputs.append(entry)
    out.webhook_url, out.webhook_min_severity = hook.get("url", ""), hook.get("min_severity", "low")
    if out.webhook_min_severity not in SEVERITIES:
        raise ValueError(f"webhook: min_severity must be one of {', '.join(SEVERITIES)}")
    out.sigma_paths = list(sigma.get("paths") or [])
    out.sigma = Options(sigma.get("min_level", ""), bool(sigma.get("include_proxy", False)), parse_duration(sigma["dedup_window"]) if sigma.get("dedup_window") else DEFAULT_DEDUP)
    out.feeds_refresh = parse_duration(intel["refresh"]) if intel.get("refresh") else out.feeds_refresh
    out.feeds = [Feed(**_section(raw, "feeds")) for raw in intel.get("feeds") or []]
    validate_feeds(out.feeds)
    out.auth_token = os.environ.get(token_from) or out.auth_token
    return out


def load_config(path: str) -> EngineConfig:
    with open(path, encoding="utf-8") as f:
        return parse_config(f.read())
