"""Token counts by rank-synchronous array merging.

A text is put in the model's normal form (spaces become the word mark, one mark in front) and cut into
pre-tokens at places that no vocabulary piece spans. The distinct pre-tokens of a batch are held as ragged
numpy arrays of symbol ids; in each round every sequence applies its own lowest-rank pair
(the leftmost of equal ranks) at the same time, until no sequence has a pair left. What counts is the symbols
that survive, with one token for each byte of a character that the vocabulary lacks. Sequences of one length lie side
by side as rows; those of more than LONG symbols lie end to end in blocks that know their lowest rank, so that a round needn't
look at, or move, whole sequences.

Pair ranks come from the public model file, whose path is a parameter; nothing is trained.

Defined cases: null or empty text has no tokens; strings of special tokens inside a text are ordinary text,
as in the library; texts of any length are counted whole; repeated rows get equal counts; an empty table gives an empty result;
other columns, whatever their names, are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, record, ship, text_of

MARK = "▁"
NONE = np.iinfo(np.int32).max
#: Longer pre-tokens are cut at character pairs that no piece holds; what stays longer lies in blocks.
LONG = 64
#: Distinct pre-tokens that a worker remembers before it starts afresh.
MEMORY = 400_000


class PieceVocabulary:
    """Symbols, pairs and their ranks from a BPE sentencepiece model."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only BPE models with identity normalization and a dummy prefix are supported")
        pieces = [(p.piece, p.score) for p in model.pieces if p.type == 1]
        order = {s: r for r, s in enumerate(sorted({s for _, s in pieces}, reverse=True))}
        self.id = {p: i for i, (p, _) in enumerate(pieces)}
        self.bytes = [len(p.encode()) for p, _ in pieces]
        keys, ranks, merged = [], [], []
        for p, s in pieces:
            for cut in range(1, len(p)):
                a, b = self.id.get(p[:cut]), self.id.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    ranks.append(order[s])
                    merged.append(self.id[p])
        at = np.argsort(keys)
        self.rank, self.merged = np.array(ranks, np.int32)[at], np.array(merged, np.int32)[at]
        keys = np.array(keys, np.int64)[at]
        # open-addressing table for pair lookups: one gather hits nearly always
        self.bits = 20
        size = 1 << self.bits
        self.table_key, self.table_at = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        self.probes = 1
        for k, i in zip(keys.tolist(), range(len(keys)), strict=True):
            h, n = self._slot(k), 1
            while self.table_key[h] >= 0:
                h, n = (h + 1) & (size - 1), n + 1
            self.table_key[h], self.table_at[h] = k, i
            self.probes = max(self.probes, n)
        self.inside = {p[i : i + 2] for p, _ in pieces for i in range(len(p) - 1)}
        self.by_mark = not any(re.search(f"[^{MARK}]{MARK}", p) for p, _ in pieces)

    def _slot(self, key):
        return (key * 0x9E3779B1 >> 12) & ((1 << self.bits) - 1)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no pair) and merged symbol of each pair of symbols."""
        key = a.astype(np.int64) << 20 | b
        key[(a < 0) | (b < 0)] = -2
        slot = self._slot(key)
        rank, merged = np.full(key.shape, NONE, np.int32), np.zeros(key.shape, np.int32)
        left = np.ones(key.shape, bool)
        for _ in range(self.probes):
            found = self.table_key[slot]
            hit = left & (found == key)
            if hit.any():
                at = self.table_at[slot[hit]]
                rank[hit], merged[hit] = self.rank[at], self.merged[at]
            left &= (found >= 0) & ~hit
            if not left.any():
                break
            slot = (slot + 1) & ((1 << self.bits) - 1)
        return rank, merged

    def symbols(self, token: str) -> list[int]:
        """Ids of the characters; an unknown character is minus its bytes."""
        get = self.id.get
        return [get(c, -len(c.encode("utf-8", "surrogatepass"))) for c in token]


def merge_rows(v: PieceVocabulary, rows: np.ndarray) -> np.ndarray:
    """Rank-synchronous merging of sequences of one length (n x length): tokens of each."""
    n, width = rows.shape
    out = np.zeros(n, np.int64)
    own = np.arange(n)
    x = rows.astype(np.int32)
    rank, merged = v.pairs(x[:, :-1], x[:, 1:])
    while x.shape[1] > 1:
        best = rank.argmin(1)
        live = rank[np.arange(len(x)), best] != NONE
        if not live.all():
            done = x[~live]
            out[own[~live]] = np.where(done >= 0, 1, -done).sum(1)
            x, rank, merged, own, best = x[live], rank[live], merged[live], own[live], best[live]
            if not len(x):
                return out
        m, width = x.shape
        every = np.arange(m)
        # each row merges at its own place: the place's symbol is replaced, the next one goes
        x[every, best] = merged[every, best]
        keep = np.ones((m, width), bool)
        keep[every, best + 1] = False
        x = x[keep].reshape(m, width - 1)
        if width == 2:
            break
        keep = np.ones((m, width - 1), bool)
        keep[every, best] = False
        rank, merged = rank[keep].reshape(m, width - 2), merged[keep].reshape(m, width - 2)
        for place, ok in ((best - 1, best > 0), (best, best < width - 2)):
            at, p = every[ok], place[ok]
            rank[at, p], merged[at, p] = v.pairs(x[at, p], x[at, p + 1])
    out[own] = np.where(x >= 0, 1, -x).sum(1)
    return out


def merge_blocks(v: PieceVocabulary, sequences: list[list[int]], block: int) -> np.ndarray:
    """Rank-synchronous merging of sequences of different lengths, laid end to end in blocks: tokens of each."""
    blocks = np.array([-(-len(s) // block) for s in sequences])
    first = np.cumsum(blocks) - blocks
    owner = np.repeat(np.arange(len(sequences)), blocks)
    size = int(blocks.sum()) * block
    x, alive = np.zeros(size, np.int32), np.zeros(size, bool)
    for s, f in zip(sequences, first.tolist(), strict=True):
        x[f * block : f * block + len(s)] = s
        alive[f * block : f * block + len(s)] = True
    after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
    begin = first * block
    last = begin + np.array([len(s) for s in sequences]) - 1
    after[last], before[begin] = -1, -1
    rank, merged = np.full(size, NONE, np.int32), np.zeros(size, np.int32)
    inner = np.flatnonzero(alive & (after >= 0))
    rank[inner], merged[inner] = v.pairs(x[inner], x[inner + 1])
    grid = rank.reshape(-1, block)
    low = grid.min(1)
    while True:
        least = np.minimum.reduceat(low, first)
        live = np.flatnonzero(least != NONE)
        if not len(live):
            return np.add.reduceat(np.where(alive, np.where(x >= 0, 1, -x), 0).astype(np.int64), begin)
        # the leftmost block of each sequence that has its lowest rank, and the leftmost place there
        hits = np.flatnonzero(low == least[owner])
        at = hits[np.searchsorted(hits, first[live])]
        i = at * block + grid[at].argmin(1)
        j = after[i]
        k, p = after[j], before[i]
        x[i], alive[j], rank[j], after[i] = merged[i], False, NONE, k
        some = k >= 0
        before[k[some]] = i[some]
        rank[i] = NONE
        rank[i[some]], merged[i[some]] = v.pairs(x[i[some]], x[k[some]])
        some = p >= 0
        rank[p[some]], merged[p[some]] = v.pairs(x[p[some]], x[i[some]])
        touched = np.concatenate([at, j // block, p[some] // block])
        low[touched] = grid[touched].min(1)


def count_tokens(v: PieceVocabulary, tokens: list[str]) -> list[int]:
    """Tokens of each distinct pre-token."""
    by_length: dict[int, tuple[list[int], list[list[int]]]] = {}
    by_block: dict[int, tuple[list[int], list[list[int]]]] = {}
    out = [0] * len(tokens)
    for i, t in enumerate(tokens):
        s = v.symbols(t)
        if len(s) <= LONG:
            parts = [s]
        else:
            cuts = [0, *[j for j in range(1, len(t)) if t[j - 1 : j + 1] not in v.inside], len(t)]
            parts = [s[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for p in parts:
            if p:
                # blocks about as long as there are blocks in a sequence
                at, rows = by_length.setdefault(len(p), ([], [])) if len(p) <= LONG else by_block.setdefault(1 << (len(p).bit_length() + 1) // 2, ([], []))
                at.append(i)
                rows.append(p)
    merged = [(at, merge_rows(v, np.array(rows, np.int32))) for at, rows in by_length.values()]
    merged += [(at, merge_blocks(v, rows, block)) for block, (at, rows) in by_block.items()]
    for at, counts in merged:
        for i, n in zip(at, counts.tolist(), strict=True):
            out[i] += n
    return out


def pretoken_pattern(v: PieceVocabulary) -> re.Pattern:
    """Runs of marks with what follows them, where no piece has a mark after another character."""
    return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if v.by_mark else r"(?s).+")


_VOCABULARIES: dict[str, PieceVocabulary] = {}


def vocabulary(path: str) -> PieceVocabulary:
    """The model at `path`, loaded once a worker."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = PieceVocabulary(path)
    return _VOCABULARIES[path]


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text; `model` names a file of public_tokenizers."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        v = vocabulary(public_tokenizers.path(model))
        pattern = pretoken_pattern(v)
        known: dict[str, int] = {}
        for rows, _, off in chunks(batches):
            texts = rows.column("text").to_pylist()
            cut = [pattern.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
            if len(known) > MEMORY:
                known.clear()
            new = list({w for words in cut for w in words} - known.keys())
            known.update(zip(new, count_tokens(v, new), strict=True))
            n = np.array([sum(map(known.__getitem__, words)) for words in cut], np.int64)
            yield record(schema, rows.column("doc_id"), np.diff(off), n, n > limit)

    return text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
