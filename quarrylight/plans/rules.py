"""Detection rules: the model, its validation and loading from YAML."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durations import format_duration, parse_duration
from ..functions.fields import SEVERITIES, field_ref
from .conditions import compile_condition

KINDS = ("match", "threshold", "sequence")
_KEYS = ("id", "name", "description", "severity", "type", "disabled", "where", "then", "group_by", "distinct", "threshold", "window", "tags")
_PLACEHOLDER = re.compile(r"\{(group|count|window|threshold)\}|\{event\.([a-zA-Z0-9_.]+)\}")


@dataclass
class Rule:
    """One rule. `predicate` (a function that makes a column) takes the place of `where` for imported rules."""

    id: str = ""
    name: str = ""
    description: str = ""
    severity: str = ""
    kind: str = ""
    disabled: bool = False
    where: dict = field(default_factory=dict)
    then: dict = field(default_factory=dict)
    group_by: str = ""
    distinct: str = ""
    threshold: int = 0
    window: int = 0  #: microseconds
    tags: list[str] = field(default_factory=list)
    origin: str = "builtin"
    logic: str = ""
    references: list[str] = field(default_factory=list)
    predicate: Callable[[], Column] | None = None

    def validate(self) -> Rule:
        if not self.id:
            raise ValueError("id is required")
        self.name = self.name or self.id
        if self.severity not in SEVERITIES:
            raise ValueError(f"severity must be one of {', '.join(SEVERITIES)}, got {self.severity!r}")
        if self.kind not in KINDS:
            raise ValueError(f"type must be one of {', '.join(KINDS)}, got {self.kind!r}")
        stateful = self.kind != "match"
        for wrong, why in (
            (self.window < 0, "window must not be negative"),
            (stateful and not self.group_by, f"group_by is required for {self.kind} rules"),
            (stateful and self.threshold < 1, "threshold must be at least 1"),
            (stateful and self.window <= 0, f"window must be positive for {self.kind} rules"),
            (self.kind == "sequence" and not self.then, "sequence rules need a then condition"),
            (self.kind != "sequence" and self.then, "then is only valid for sequence rules"),
            (self.distinct and self.kind != "threshold", "distinct is only valid for threshold rules"),
        ):
            if wrong:
                raise ValueError(why)
        return self

    def matches(self) -> Column:
        return self.predicate() if self.predicate else compile_condition(self.where)

    def event_fields(self) -> list[str]:
        """The fields that the description takes from the firing event."""
        return list(dict.fromkeys(m[1] for m in _PLACEHOLDER.findall(self.description) if m[1]))

    def describe(self, group: Column, count: Column, event: Callable[[str], Column]) -> Column:
        """The alert's description; values are put in once, so placeholders inside values stay as they are."""
        if not self.description:
            return F.when(group == "", self.name).otherwise(F.concat(F.lit(f"{self.name}: "), group))
        parts, at = [], 0
        known = {"group": group, "count": count.cast("string"), "window": F.lit(format_duration(self.window)), "threshold": F.lit(str(self.threshold))}
        for m in _PLACEHOLDER.finditer(self.description):
            parts += [F.lit(self.description[at : m.start()]), known[m[1]] if m[1] else event(m[2])]
            at = m.end()
        return F.regexp_replace(F.concat(*parts, F.lit(self.description[at:])), "^: ", "")


class _Loader(yaml.SafeLoader):
    """Only true and false are booleans, so that an id such as `off` stays text."""


_Loader.yaml_implicit_resolvers = {k: [(tag, r) for tag, r in v if tag not in ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:timestamp")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
_Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


def _rule(raw: dict) -> Rule:
    if not isinstance(raw, dict) or set(raw) - set(_KEYS):
        raise ValueError(f"unknown rule keys: {sorted(set(raw) - set(_KEYS)) if isinstance(raw, dict) else raw!r}")
    if not isinstance(raw.get("threshold", 0), int):
        raise ValueError("threshold must be a whole number")
    text = {k: str(raw.get(k) or "") for k in ("id", "name", "description", "severity", "group_by", "distinct")}
    return Rule(
        **text, kind=str(raw.get("type") or ""), disabled=bool(raw.get("disabled", False)), where=raw.get("where") or {}, then=raw.get("then") or {}, threshold=raw.get("threshold") or 0, window=parse_duration(raw["window"]) if raw.get("window") else 0, tags=list(raw.get("tags") or [])
    )


def parse_rules(text: str) -> list[Rule]:
    """Rules of a YAML document with the key `rules`; a wrong or repeated rule is a ValueError. Needs a Spark session, as conditions are compiled."""
    doc = yaml.load(text, _Loader) or {}
    if not isinstance(doc, dict) or set(doc) - {"rules"}:
        raise ValueError("a rules file has the one key `rules`")
    out: dict[str, Rule] = {}
    for n, raw in enumerate(doc.get("rules") or [], 1):
        try:
            rule = _rule(raw).validate()
            compile_condition(rule.where), compile_condition(rule.then)
        except (ValueError, TypeError, AttributeError) as e:
            raise ValueError(f"rule {n}: {e}") from e
        if rule.id in out:
            raise ValueError(f"duplicate rule id {rule.id}")
        out[rule.id] = rule
    return list(out.values())


def load_rules(path: str) -> list[Rule]:
    with open(path, encoding="utf-8") as f:
        return parse_rules(f.read())


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as a small table, for listing and search."""
    rows = [(r.id, r.name, r.description, r.severity, r.kind, r.disabled, r.group_by, r.threshold, format_duration(r.window), r.tags, r.origin, r.logic or render(r.where)) for r in rules]
    return spark.createDataFrame(rows, "id string, name string, description string, severity string, type string, disabled boolean, group_by string, threshold int, window string, tags array<string>, origin string, logic string")


def render(condition: dict) -> str:
    """A condition as text, for people."""
    words = {"equals": "=", "not": "!=", "in": "in", "not_in": "not in", "contains": "contains", "prefix": "starts with", "regex": "~", "gte": ">=", "lte": "<="}
    out = []
    for name, matcher in (condition or {}).items():
        for op, value in matcher.items() if isinstance(matcher, dict) else [("equals", matcher)]:
            if op == "exists":
                out.append(f"{name} {'exists' if value else 'is missing'}")
            else:
                out.append(f"{name} {words.get(op, op)} {', '.join(map(str, value)) if isinstance(value, list) else value}")
    return " and ".join(out)


def field_value(name: str) -> Column:
    return field_ref(name).value
