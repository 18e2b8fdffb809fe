"""SentencePiece encoding and decoding by n-best segmentation of the piece lattice.

A text in the model's normal form (spaces as marks, one mark in front) spans a lattice: its nodes are places
between characters, its edges the vocabulary pieces that stand there, weighted with the model's scores; a character
that the vocabulary lacks is an edge of its own and is written as byte pieces. A segmentation is a path, its score the
sum of its pieces'. Forward Viterbi gives the best score from the start to every node. The same scores are the exact
heuristic of an A-star search that runs backward from the end, so paths come off its heap in order and the first n
are the n best. Of equal scores the batch form takes the smaller piece ids, read from the end of the text.

Where no piece holds two neighbouring characters every path has a node between them, so a lattice falls apart there into
segments (a word start is such a place, as no piece has a mark after another character): the best segmentation joins those
of the segments. For a batch of texts, Viterbi runs over the distinct segments at once in numpy and gives each one's best ids and
what its second-best path costs. A text's n best differ from its best one only in the n - 1 segments where that is least; for
these the A-star search gives the paths from which the second to nth segmentations are put together. A segment of more than LONG
characters runs through the same recursions by itself.

Defined cases: a null or empty text has no pieces, score 0 and one segmentation; decoding gives the text back except that
the mark character itself comes back as a space; texts of any length are segmented whole; repeated rows get equal results; an empty
table gives an empty result; columns that aren't in `keep`, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lists, mix, powers, ship, with_fields

MARK = "▁"
#: An unknown character scores this much below the worst piece.
UNKNOWN_PENALTY = 10
#: Bytes of text segmented at a time.
CHUNK = 1 << 20
#: Characters of a segment that goes through the recursions by itself.
LONG = 1000
_PAIR_BITS = 22
_FAR = np.int64(1) << 60


class Pieces:
    """Pieces, scores and ids of a sentencepiece model file with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only identity normalization with a dummy prefix is supported")
        self.piece = [p.piece for p in model.pieces]
        self.kind = [p.type for p in model.pieces]
        normal = [i for i, t in enumerate(self.kind) if t == 1]
        if any(MARK in p.lstrip(MARK) for p in (self.piece[i] for i in normal)):
            raise ValueError("a piece spans a word start")
        if any(p.score != int(p.score) for p in model.pieces):
            raise ValueError("scores must be whole numbers, so that sums are exact")
        self.id = {self.piece[i]: i for i in normal}
        self.score = np.array([int(p.score) for p in model.pieces], np.int64)
        self.unknown = int(self.score[normal].min()) - UNKNOWN_PENALTY
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if self.kind[i] == 6}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.longest = max(len(self.piece[i]) for i in normal)
        # character pairs inside pieces, by hash: one that isn't marked is in no piece
        self.inside = np.zeros(1 << _PAIR_BITS, bool)
        for i in normal:
            c = code_points(self.piece[i])
            self.inside[pair_hash(c[:-1], c[1:])] = True
        text = "".join(self.piece[i] for i in normal)
        off = np.concatenate([[0], np.cumsum([len(self.piece[i]) for i in normal])])
        h = span_hash(char_prefix(code_points(text)), off[:-1], off[1:])
        order = np.argsort(h)
        self.hash, self.hash_id = h[order], np.array(normal)[order]
        if (self.hash[1:] == self.hash[:-1]).any():
            raise ValueError("piece hashes collide")
        # open addressing by the low bits: one probe tells for nearly every substring
        self.slot = np.full(1 << 20, -1, np.int32)
        self.probes = 1
        for n, slot in enumerate((self.hash & np.uint64((1 << 20) - 1)).tolist()):
            tries = 1
            while self.slot[slot] >= 0:
                slot, tries = (slot + 1) & ((1 << 20) - 1), tries + 1
            self.slot[slot] = n
            self.probes = max(self.probes, tries)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1: no piece."""
        out = np.full(len(h), -1, np.int32)
        slot = (h & np.uint64((1 << 20) - 1)).astype(np.int64)
        n = self.slot[slot]
        at = np.flatnonzero(n >= 0)
        for _ in range(self.probes):
            hit = self.hash[n[at]] == h[at]
            out[at[hit]] = self.hash_id[n[at[hit]]]
            at = at[~hit]
            if not len(at):
                break
            slot[at] = (slot[at] + 1) & ((1 << 20) - 1)
            n[at] = self.slot[slot[at]]
            at = at[n[at] >= 0]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation; byte pieces that make no character become U+FFFD, one a byte."""
        parts: list[str] = []
        held = bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                parts.append(_bytes_text(bytes(held)))
                held.clear()
            if self.kind[i] == 1:
                parts.append(self.piece[i])
        if held:
            parts.append(_bytes_text(bytes(held)))
        out = "".join(parts).replace(MARK, " ")
        return out[1:] if out.startswith(" ") else out


def _bytes_text(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)


def char_prefix(cp: np.ndarray) -> np.ndarray:
    out = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(mix(cp.astype(np.uint64) + np.uint64(1)) * powers(len(cp))[0][: len(cp)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64))


def n_best(v: Pieces, text: str, n: int) -> list[tuple[int, list[int]]]:
    """The n best paths of a text in normal form, best first: (score, ids). Forward Viterbi, then A-star from the end."""
    size = len(text)
    into: list[list[tuple[int, int, int]]] = [[] for _ in range(size + 1)]  # edges by end: start, score, id
    best = [0] + [-int(_FAR)] * size
    for j in range(1, size + 1):
        for i in range(max(0, j - v.longest), j):
            at = v.id.get(text[i:j])
            if at is not None:
                into[j].append((i, int(v.score[at]), at))
            elif i == j - 1:
                into[j].append((i, v.unknown, -1))
        best[j] = max(best[i] + s for i, s, _ in into[j])
    out: list[tuple[int, list[int]]] = []
    # what a path can reach, its node (of equal ones the path that has come furthest), a count, its score, its pieces so far as a chain
    heap = [(-best[size], size, 0, 0, None)]
    count = 0
    while heap and len(out) < n:
        reach, node, _, done, chain = heapq.heappop(heap)
        if node == 0:
            out.append((-reach, _spelled(v, chain, text)))
            continue
        for i, s, at in into[node]:
            count += 1
            heapq.heappush(heap, (-(best[i] + s + done), i, count, done + s, (at, chain)))
    return out


def _spelled(v: Pieces, chain: tuple | None, text: str) -> list[int]:
    """Ids in text order, with unknown characters as byte pieces. The chain's last link is the first piece."""
    out, at = [], 0
    while chain is not None:
        i, chain = chain
        if i >= 0:
            out.append(i)
            at += len(v.piece[i])
        else:
            out += [v.byte[b] for b in text[at].encode("utf-8", "surrogatepass")]
            at += 1
    return out


class Words:
    """Viterbi over many distinct words at once: best ids (flat, with the index of each word's first), score and what the second best costs.

    Words are ordered by length, longest first, and laid out place by place: the characters (and nodes) at place t of all
    words that reach it stand side by side, so every step of the recursion works on slices.
    """

    def __init__(self, v: Pieces, cp: np.ndarray, off: np.ndarray):
        size = np.diff(off)
        words, total, wide = len(size), int(off[-1]), v.longest
        order = np.argsort(-size, kind="stable")
        longest = int(size[order[0]]) if words else 0
        reach = words - np.cumsum(np.bincount(size, minlength=longest + 1))  # words longer than t, for each place t
        active = np.concatenate([[words], reach[:longest]])  # words of at least t characters
        node = np.concatenate([[0], np.cumsum(active)])  # first node of each place
        at = np.concatenate([[0], np.cumsum(reach[:longest])])  # first character of each place
        rank = np.empty(words, np.int64)
        rank[order] = np.arange(words)
        string = np.repeat(np.arange(words), size)
        place = np.arange(total) - off[string]
        spot = at[place] + rank[string]
        prefix, end_of = char_prefix(cp), off[1:][string]
        ids: list[np.ndarray] = []
        for k in range(1, min(wide, longest) + 1):
            fits = np.flatnonzero(np.arange(total) + k <= end_of)
            found = np.full(total, -1, np.int32)
            found[spot[fits]] = v.find(span_hash(prefix, fits, fits + k))
            ids.append(found)
        # scores by id; -1 is no piece (for one character: an unknown one), -2 an edge struck out
        score = [np.append(v.score, [-_FAR, v.unknown if k == 0 else -_FAR]) for k in range(2)]
        cost = lambda k, edges: score[min(k, 2) - 1][ids[k - 1][edges]]

        ahead, back, last = np.full(node[-1], -_FAR, np.int64), np.zeros(node[-1], np.int8), np.zeros(node[-1], np.int32)
        ahead[:words] = 0
        for t in range(1, longest + 1):
            m = active[t]
            here = slice(node[t], node[t] + m)
            best, won, by = ahead[here], back[here], last[here]
            for k in range(1, min(wide, t) + 1):
                edge = slice(at[t - k], at[t - k] + m)
                sum_ = ahead[node[t - k] : node[t - k] + m] + cost(k, edge)
                piece = ids[k - 1][edge]
                better = (sum_ > best) | ((sum_ == best) & (piece < by))
                np.copyto(best, sum_, where=better)
                np.copyto(won, np.int8(k), where=better)
                np.copyto(by, piece, where=better)
        behind = np.full(node[-1], -_FAR, np.int64)
        behind[node[size[order]] + np.arange(words)] = 0
        for t in range(longest - 1, -1, -1):
            m = active[t + 1]
            best = behind[node[t] : node[t] + m]
            for k in range(1, min(wide, longest - t) + 1):
                n = active[t + k]
                np.maximum(best[:n], behind[node[t + k] : node[t + k] + n] + cost(k, slice(at[t], at[t] + n)), out=best[:n])

        # the best paths, from the ends; the second best has an edge that isn't on them
        self.score = ahead[node[size] + rank]
        w, j, found = np.arange(words), size.copy(), []
        while len(w):
            k = back[node[j] + rank[w]].astype(np.int64)
            j = j - k
            found.append((off[w] + j, k, at[j] + rank[w]))
            live = j > 0
            w, j = w[live], j[live]
        start, k, edge = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in range(3))
        path = np.empty(len(start), np.int32)
        second = np.full(words, -_FAR, np.int64)
        for n, i in enumerate(ids, 1):
            mine = k == n
            path[mine] = i[edge[mine]]
            i[edge[mine]] = -2
            for t in range(longest - n + 1):
                m = active[t + n]
                here = slice(at[t], at[t] + m)
                np.maximum(second[:m], ahead[node[t] : node[t] + m] + cost(n, here) + behind[node[t + n] : node[t + n] + m], out=second[:m])
        second = second[rank]
        self.second_costs = np.where(second > -(_FAR >> 1), self.score - second, _FAR)
        by_start = np.argsort(start)
        start, path = start[by_start], path[by_start]
        # byte pieces for unknown characters
        extra = path < 0
        spelled = np.ones(len(path), np.int64)
        if extra.any():
            c = cp[start[extra]]
            spelled[extra] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        to = np.concatenate([[0], np.cumsum(spelled)])
        flat = np.repeat(path, spelled)
        for i in np.flatnonzero(extra):
            flat[to[i] : to[i + 1]] = [v.byte[b] for b in chr(int(cp[start[i]])).encode("utf-8", "surrogatepass")]
        self.ids, self.first = flat, to[np.searchsorted(start, off)]


def long_word(v: Pieces, cp: np.ndarray) -> tuple[list[int], int, int]:
    """Best ids, score and what the second best costs of one long segment: the recursions of Words, place by place."""
    size, far = len(cp), -int(_FAR)
    prefix = char_prefix(cp)
    ids, cost = [], []
    for k in range(1, min(v.longest, size) + 1):
        start = np.arange(size - k + 1)
        found = v.find(span_hash(prefix, start, start + k))
        ids.append(found.tolist())
        cost.append(np.where(found >= 0, v.score[found], v.unknown if k == 1 else far).tolist())
    ahead, back = [0] + [far] * size, [0] * (size + 1)
    for t in range(1, size + 1):
        best, won, by = far, 0, 0
        for k in range(1, min(len(ids), t) + 1):
            c = cost[k - 1][t - k]
            if c > far:
                total, piece = ahead[t - k] + c, ids[k - 1][t - k]
                if total > best or (total == best and piece < by):
                    best, won, by = total, k, piece
        ahead[t], back[t] = best, won
    behind = [far] * size + [0]
    for t in range(size - 1, -1, -1):
        behind[t] = max(cost[k - 1][t] + behind[t + k] for k in range(1, min(len(ids), size - t) + 1) if cost[k - 1][t] > far)
    path, on, t = [], set(), size
    while t:
        k = back[t]
        t -= k
        on.add((t, k))
        i = ids[k - 1][t]
        path.append([i] if i >= 0 else [v.byte[b] for b in chr(int(cp[t])).encode("utf-8", "surrogatepass")])
    second = max((ahead[t] + c + behind[t + k] for k, row in enumerate(cost, 1) for t, c in enumerate(row) if c > far and (t, k) not in on), default=far)
    return [i for part in reversed(path) for i in part], ahead[size], ahead[size] - second if second > far else int(_FAR)


def combined(lists_: list[list[int]], n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The n least sums of one entry from each ascending list (each starts with 0), with the entries' places."""
    heap, out, seen = [(0, (0,) * len(lists_))], [], {(0,) * len(lists_)}
    while heap and len(out) < n:
        cost, at = heapq.heappop(heap)
        out.append((cost, at))
        for i, x in enumerate(at):
            if x + 1 < len(lists_[i]):
                nxt = (*at[:i], x + 1, *at[i + 1 :])
                if nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(heap, (cost - lists_[i][x] + lists_[i][x + 1], nxt))
    return out


class Batch:
    """Best ids, and the ids and scores of the n best, of a run of texts."""

    def __init__(self, v: Pieces, data: np.ndarray, off: np.ndarray, n: int):
        lead = (data & 0xC0) != 0x80
        char_off = np.concatenate([[0], np.cumsum(lead)])[off]
        cp = code_points(data.tobytes().decode("utf-8", "surrogatepass"))
        mark = np.uint32(ord(MARK))
        cp = np.where(cp == 32, mark, cp)
        some = np.flatnonzero(np.diff(char_off) > 0)
        cp = np.insert(cp, char_off[:-1][some], mark)
        inserted = np.concatenate([[0], np.cumsum(np.diff(char_off) > 0)])
        text_off = char_off + inserted
        new = np.ones(len(cp), bool)
        new[1:] = ~v.inside[pair_hash(cp[:-1], cp[1:])] | ((cp[1:] == mark) & (cp[:-1] != mark))
        new[text_off[:-1][some]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(cp))
        prefix = char_prefix(cp)
        _, one, which = np.unique(span_hash(prefix, start, end), return_index=True, return_inverse=True)
        size = (end - start)[one]
        spelled = lambda w: cp[start[one[w]] : end[one[w]]]
        short = np.flatnonzero(size <= LONG)
        word_off = np.concatenate([[0], np.cumsum(size[short])])
        at = np.repeat(start[one[short]] - word_off[:-1], size[short]) + np.arange(word_off[-1])
        words = Words(v, cp[at], word_off)
        score, second, length = (np.zeros(len(size), np.int64) for _ in range(3))
        score[short], second[short], length[short] = words.score, words.second_costs, np.diff(words.first)
        alone = {}
        for w in np.flatnonzero(size > LONG).tolist():
            alone[w], score[w], second[w] = long_word(v, spelled(w))
            length[w] = len(alone[w])
        begin = np.concatenate([[0], np.cumsum(length)])
        flat = np.empty(begin[-1], np.int32)
        flat[np.repeat(begin[:-1][short] - words.first[:-1], length[short]) + np.arange(words.first[-1])] = words.ids
        for w, ids in alone.items():
            flat[begin[w] : begin[w + 1]] = ids
        first = np.searchsorted(start, text_off)
        count = length[which]
        place = np.repeat(begin[:-1][which] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        self.ids = flat[place]
        pieces = np.concatenate([[0], np.cumsum(count)])
        self.first = pieces[first]
        total = np.concatenate([[0], np.cumsum(score[which])])
        self.best = total[first[1:]] - total[first[:-1]]
        known: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def alternatives(w: int) -> tuple[list[int], list[np.ndarray]]:
            """What the n best paths of a segment cost more than the best, and their ids; the first is the best one above."""
            if w not in known:
                best = flat[begin[w] : begin[w + 1]].tolist()
                found = n_best(v, spelled(w).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), n)
                rest = [(int(score[w]) - s, ids) for s, ids in found if ids != best][: n - 1]
                known[w] = [0, *[c for c, _ in rest]], [np.array(ids, np.int32) for ids in (best, *[ids for _, ids in rest])]
            return known[w]

        self.scores: list[list[int]] = []
        self.n_best: list[list[np.ndarray]] = []
        costs = second[which]
        for d in range(len(off) - 1):
            own = costs[first[d] : first[d + 1]]
            near = np.argsort(own, kind="stable")[: n - 1] if len(own) < 64 else _least(own, n - 1)
            near = [first[d] + i for i in sorted(near.tolist()) if own[i] < _FAR]
            table = [alternatives(int(which[q])) for q in near]
            chosen = combined([t[0] for t in table], n)
            self.scores.append([int(self.best[d]) - c for c, _ in chosen])
            lo, hi, paths = self.first[d], self.first[d + 1], []
            for _, entries in chosen:
                parts, done = [], lo
                for q, t, e in zip(near, table, entries, strict=True):
                    if e:
                        parts += [self.ids[done : pieces[q]], t[1][e]]
                        done = pieces[q + 1]
                paths.append(np.concatenate([*parts, self.ids[done:hi]]) if parts else self.ids[lo:hi])
            self.n_best.append(paths)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    if n <= 0:
        return np.zeros(0, np.int64)
    near = np.argpartition(x, n - 1)[:n]
    return near[np.argsort(x[near], kind="stable")]


_MODELS: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    """A model file of public_tokenizers, loaded once a worker."""
    import public_tokenizers

    if model not in _MODELS:
        _MODELS[model] = Pieces(public_tokenizers.path(model))
    return _MODELS[model]


def _digest(ids: np.ndarray) -> str:
    return hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()


def encode(docs: DataFrame, model: str, n: int = 4, keep: list[str] | None = None, with_ids: bool = True, with_n_best: bool = False) -> DataFrame:
    """The columns of `keep` with n_pieces, best_score, nbest_scores, nbest_sha256 (of the little-endian 32-bit ids of each of the n best), ids_sha256, round_trip and, if asked for, ids and nbest_ids."""
    ship(docs.sparkSession)
    keep = keep or ["doc_id"]
    source = docs.select(*keep, *([F.col("text").cast("string").alias("text")] if "text" not in keep else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(model)
        plain = [p if k == 1 else None for p, k in zip(v.piece, v.kind, strict=True)]
        for rows, data, off in chunks(batches, CHUNK):
            b = Batch(v, data, off, n)
            digests, same = [], []
            raw = data.tobytes()
            for d, paths in enumerate(b.n_best):
                ids = paths[0].tolist()
                digests.append([_digest(p) for p in paths])
                known = [plain[i] for i in ids]
                text = "".join(known).replace(MARK, " ")[1:] if None not in known else v.decode(ids)
                same.append(text.encode("utf-8", "surrogatepass") == raw[off[d] : off[d + 1]])
            scores = np.array([s for x in b.scores for s in x], np.int64)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in b.scores])])
            columns = {
                "n_pieces": pa.array(np.diff(b.first)), "best_score": pa.array(b.best), "nbest_scores": lists(scores, ends, pa.int64()), "nbest_sha256": pa.array(digests, pa.list_(pa.string())),
                "ids_sha256": pa.array([x[0] for x in digests], pa.string()), "round_trip": pa.array(same, pa.bool_()),
            }
            if with_ids:
                columns["ids"] = lists(b.ids, b.first, pa.int32())
            if with_n_best:
                flat = [p for paths in b.n_best for p in paths]
                inner = np.concatenate([[0], np.cumsum([len(p) for p in flat])])
                columns["nbest_ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lists(np.concatenate(flat) if flat else np.zeros(0, np.int32), inner, pa.int32()))
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], *columns.values()], names=[*keep, *columns])

    more = "n_pieces long, best_score long, nbest_scores array<long>, nbest_sha256 array<string>, ids_sha256 string, round_trip boolean"
    return source.mapInArrow(run, with_fields(source, keep, more + ", ids array<int>" * with_ids + ", nbest_ids array<array<int>>" * with_n_best))


def decode(encoded: DataFrame, model: str, keep: list[str] | None = None) -> DataFrame:
    """The columns of `keep` with the text of the column `ids`; null ids give a null text."""
    ship(encoded.sparkSession)
    keep = keep or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(model)
        for batch in batches:
            text = [None if x is None else v.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(text, pa.string())], names=[*keep, "text"])

    return encoded.select(*keep, "ids").mapInArrow(run, with_fields(encoded, keep, "text string"))
