"""Sample log lines: normal traffic and the shapes of seven attacks, for tests and demonstrations. Same seed, same lines."""

from __future__ import annotations

import random
from collections.abc import Iterator
from datetime import datetime, timedelta

USERS, PATHS = ("alice", "bob", "carol", "dave"), ("/", "/index.html", "/app/list", "/static/site.css", "/api/items?page=2")
ATTACKER = "203.0.113.{}"
#: Attack shapes by name (fixed names).
ATTACKS = ("ssh_bruteforce", "ssh_spray", "ssh_breach", "root_login", "web_scan", "web_injection", "web_login")


def _ssh(at: datetime, said: str) -> str:
    return f"{at:%b} {at.day:2d} {at:%H:%M:%S} web1 sshd[4242]: {said}"


def _web(at: datetime, ip: str, request: str, status: int, agent: str = "Mozilla/5.0") -> str:
    return f'{ip} - - [{at:%d/%b/%Y:%H:%M:%S} +0000] "{request} HTTP/1.1" {status} 512 "-" "{agent}"'


def normal(rng: random.Random, at: datetime) -> tuple[str, str]:
    """(parser, line) of ordinary traffic."""
    ip, user = f"198.51.100.{rng.randrange(1, 100)}", rng.choice(USERS)
    if rng.random() < 0.3:
        return "ssh", _ssh(at, f"Accepted publickey for {user} from {ip} port {rng.randrange(40000, 60000)} ssh2")
    return "nginx", _web(at, ip, f"GET {rng.choice(PATHS)}", rng.choice((200, 200, 200, 304)))


def attack(name: str, at: datetime, host: int = 7) -> Iterator[tuple[str, str]]:
    """(parser, line) of one attack, a line a second."""
    ip = ATTACKER.format(host)
    tick = lambda n: at + timedelta(seconds=n)
    if name in ("ssh_bruteforce", "ssh_breach"):
        for n in range(6):
            yield "ssh", _ssh(tick(n), f"Failed password for admin from {ip} port {50000 + n} ssh2")
        if name == "ssh_breach":
            yield "ssh", _ssh(tick(7), f"Accepted password for admin from {ip} port 50007 ssh2")
    elif name == "ssh_spray":
        for n, user in enumerate(("root", "oracle", "test", "git")):
            yield "ssh", _ssh(tick(n), f"Failed password for invalid user {user} from {ip} port {50000 + n} ssh2")
    elif name == "root_login":
        yield "ssh", _ssh(at, f"Accepted password for root from {ip} port 50000 ssh2")
    elif name == "web_scan":
        for n in range(24):
            yield "nginx", _web(tick(n), ip, f"GET /{'.env' if n == 3 else f'x{n}.php'}", 404, "scanner/1.0")
    elif name == "web_injection":
        yield "nginx", _web(at, ip, "GET /items?id=1%20union%20select%20pw", 200)
    elif name == "web_login":
        for n in range(11):
            yield "nginx", _web(tick(n), ip, "POST /login", 401)
    else:
        raise ValueError(f"unknown attack {name!r}")


def lines(seed: int, start: datetime, seconds: int, attacks: tuple[str, ...] = ATTACKS) -> list[tuple[str, str]]:
    """Five ordinary lines a second, and the attacks spread over the time, each from an address of its own."""
    rng = random.Random(seed)
    out = [normal(rng, start + timedelta(seconds=n // 5)) for n in range(5 * seconds)]
    for n, name in enumerate(attacks):
        out += attack(name, start + timedelta(seconds=n * seconds // max(1, len(attacks))), n + 1)
    return out
