"""Durations in the text form that rules and API parameters use, as whole microseconds."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

#: Units of the duration text form, in microseconds (fixed values of the format).
UNITS = {"ns": 0.001, "us": 1, "µs": 1, "μs": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}

_PART = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)")


def parse_duration(text: str | int) -> int:
    """`1h30m`, `500ms`, `-2s`, `0`; anything else is a ValueError."""
    text = str(text)
    body = text[1:] if text[:1] in ("+", "-") else text
    if body == "0":
        return 0
    parts = _PART.findall(body)
    if not parts or "".join(a + b for a, b in parts) != body:
        raise ValueError(f"invalid duration {text!r}")
    total = round(sum(float(n) * UNITS[u] for n, u in parts))
    return -total if text.startswith("-") else total


def format_duration(micros: int) -> str:
    """The canonical form: `1m0s`, `1h0m0s`, `1.5s`, `20ms`, `0s`."""
    if micros == 0:
        return "0s"
    sign, micros = ("-", -micros) if micros < 0 else ("", micros)

    def number(n: int, unit: int) -> str:
        whole, rest = divmod(n, unit)
        return f"{whole}" + (f".{rest:0{len(str(unit)) - 1}d}".rstrip("0") if rest else "")

    if micros < 1_000:
        return f"{sign}{micros}µs"
    if micros < 1_000_000:
        return f"{sign}{number(micros, 1_000)}ms"
    minutes, micros = divmod(micros, 60_000_000)
    hours, minutes = divmod(minutes, 60)
    lead = f"{hours}h{minutes}m" if hours else f"{minutes}m" if minutes else ""
    return f"{sign}{lead}{number(micros, 1_000_000)}s"


def parse_when(text: str, now: datetime) -> datetime:
    """A time parameter: a duration before now, or RFC 3339."""
    try:
        return now - timedelta(microseconds=parse_duration(text))
    except ValueError:
        pass
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", text):
        raise ValueError(f"invalid time {text!r}")
    return datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(timezone.utc)
