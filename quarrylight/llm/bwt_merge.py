"""Burrows-Wheeler transforms of byte strings over block symbols, and their merging.

A string is read in blocks of `step` bytes: the suffix at byte p begins with the block at p and goes on at
p + step, so a string makes `step` interleaved symbol strings and `depth` symbols are step * depth bytes. Symbols
are dense numbers of the distinct block hashes, the same in all shards.

A shard holds its suffixes in order (to `depth` symbols) and, for each, the symbol before it: its transform. Two
shards are merged without sorting suffixes again: the interleave of their suffixes starts as "all of the first,
then all of the second" and is refined once a symbol; a round reads the transforms in the present interleave and
deals its entries to their symbols' places, stably. A boundary between neighbours that appears in round i means a
common prefix of i - 1 symbols. After `depth` rounds, runs without a boundary are the repeated intervals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

from .common import prefix_hash, spans


@dataclass
class Shard:
    suffixes: np.ndarray  #: byte places in suffix order
    before: np.ndarray  #: symbol before each suffix, -1 at the head of a symbol string
    ends: int  #: how many of the first suffixes are the ends of symbol strings


@dataclass
class Symbols:
    """Strings laid end to end, each with one place for the empty suffix after it."""

    at: np.ndarray  #: symbol of the block at each place, -1 where less than a block is left
    before: np.ndarray
    step: int

    @classmethod
    def of(cls, data: np.ndarray, off: np.ndarray, step: int) -> Symbols:
        n = np.diff(off)
        place = np.arange(off[-1] + len(n))
        string = np.repeat(np.arange(len(n)), n + 1)
        p = place - string  # byte
        end = off[string + 1]
        whole = p + step <= end
        at = np.full(len(p), -1, np.int32)
        at[whole] = pd.factorize(spans(prefix_hash(data), p[whole], p[whole] + step))[0]
        before = np.full(len(p), -1, np.int32)
        inner = np.flatnonzero(p - off[string] >= step)
        before[inner] = at[inner - step]
        return cls(at, before, step)


def _stable_order(x: np.ndarray) -> np.ndarray:
    """Stable order of nonnegative integers below 2**32, by two radix passes."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    high = (x >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def shard(s: Symbols, lo: int, hi: int, depth: int) -> Shard:
    """Sort the suffixes at places lo to hi (whole strings): a radix sort over their symbols, last one first."""
    sym = s.at[lo:hi]
    n = len(sym)
    order = np.arange(n)
    # the i-th symbol after each place; 0 once the string has ended
    ahead = [sym + 1]
    for _ in range(depth - 1):
        nxt = np.zeros(n, np.int32)
        nxt[: n - s.step] = ahead[-1][s.step :]
        nxt[sym < 0] = 0
        ahead.append(nxt)
    for symbol in reversed(ahead):
        order = order[_stable_order(symbol[order])]
    return Shard(order + lo, s.before[lo:hi][order], int((sym < 0).sum()))


def merge(a: Shard, b: Shard, depth: int) -> tuple[Shard, np.ndarray]:
    """The merged shard, and for each suffix the symbols it shares with the one before it (depth: that many or more)."""
    ends = np.concatenate([np.zeros(a.ends, bool), np.ones(b.ends, bool)])
    n = len(a.suffixes) + len(b.suffixes)
    second = np.zeros(n, bool)
    second[len(a.suffixes) :] = True
    block = np.zeros(n, np.int32)
    common = np.full(n, depth, np.int16)
    first_round = np.ones(n, bool)
    for i in range(1, depth + 1):
        symbol = _interleave(second, a.before, b.before)
        inner = np.flatnonzero(symbol >= 0)
        source = inner[_stable_order(symbol[inner])]
        c, old = symbol[source], block[source]
        edge = np.ones(n, bool)
        edge[len(ends) + 1 :] = (c[1:] != c[:-1]) | (old[1:] != old[:-1])
        found = edge & first_round
        common[found] = i - 1
        first_round &= ~edge
        second = np.concatenate([ends, second[source]])
        block = np.cumsum(edge, dtype=np.int32)
    return Shard(_interleave(second, a.suffixes, b.suffixes), _interleave(second, a.before, b.before), len(ends)), common


def _interleave(second: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(second), a.dtype)
    out[~second] = a
    out[second] = b
    return out


def repeated_places(data: np.ndarray, off: np.ndarray, step: int, depth: int, shard_size: int = 1 << 19) -> np.ndarray:
    """Flags over bytes: does a string of step * depth bytes that starts there also start elsewhere?

    The strings are dealt to shards of about `shard_size` places, at least two, which are merged in pairs.
    """
    out = np.zeros(len(data), bool)
    n = len(off) - 1
    if n < 2:
        return out
    s = Symbols.of(data, off, step)
    place_of = off + np.arange(n + 1)
    shards = max(2, -(-int(place_of[-1]) // shard_size))
    cuts = np.unique(np.searchsorted(place_of, np.linspace(0, place_of[-1], shards + 1)[1:-1]).clip(1, n - 1))
    edges = place_of[np.concatenate([[0], cuts, [n]])]
    level = [shard(s, int(lo), int(hi), depth) for lo, hi in zip(edges, edges[1:], strict=False)]
    while len(level) > 1:
        merged = [merge(a, b, depth) for a, b in zip(level[::2], level[1::2], strict=False)]
        common = merged[-1][1]
        level = [m[0] for m in merged] + level[len(level) & ~1 :]
    same = common >= depth
    same = same | np.append(same[1:], False)
    place = level[0].suffixes[same]
    string = np.searchsorted(place_of, place, "right") - 1
    out[place - string] = True
    return out
