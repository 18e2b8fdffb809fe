"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as three learned embeddings: of the hashed word, of its hashed first HEAD bytes, and the mean of those of its
character trigrams. Two gated recurrent layers read a window of words forward and backward, attention pools
their states, and a logistic unit gives the window's score. All windows of WINDOW words, each STRIDE after the one
before, are scored; a text's score is that of its worst window.

Labels say which texts are toxic, not where. So training alternates: score all windows of the training texts, take each
text's worst window (twice if the text is toxic, else with some by chance), and fit the network on those. The first WARM_EPOCHS
take windows by chance. Chance gives every text windows in proportion to its length, WARM_WINDOWS or CLEAN_WINDOWS in all.
At most TRAIN_ROWS labelled rows are used, picked by hash, each with its whole text. Tasks score their windows; only the windows that
are taken reach the driver, at most WARM_WINDOWS and two a row.

Networks of this size fit their training texts all but perfectly, so scores count a missed toxic text as ODDS flagged clean ones.

Defined cases: null or empty texts, and texts without words, are one window of no words, scored like any other; texts of any
length are scored whole; of windows with equal scores training takes the first; without training rows (an empty table has none)
every score is 0; a doc_id labelled more than once is toxic if any of its labels is; repeated rows get equal scores; other
columns, whatever their names, are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, chunks, mix, record, ship, text_of, word_hashes, word_spans

WINDOW, STRIDE = 48, 24
WORDS, WORD_SIZE, HEADS, HEAD_SIZE, TRIGRAMS, TRIGRAM_SIZE, HIDDEN = 1 << 13, 8, 1 << 13, 8, 1 << 10, 8, 8
#: Bytes of a word that its head has.
HEAD = 6
TRAIN_ROWS, EPOCHS = 4000, 8
#: The first epochs take windows by chance, so many of all texts; later ones take so many of the clean ones, besides the worst.
WARM_EPOCHS, WARM_WINDOWS, CLEAN_WINDOWS = 2, 12_000, 4_000
#: A toxic text that is missed counts as so many clean ones that are flagged: training is all but perfect, so 0.5 would miss too many.
ODDS = 4
#: Batches that an epoch has at least: a few windows are gone through more often.
LEAST_BATCHES = 60

_INPUT = WORD_SIZE + HEAD_SIZE + TRIGRAM_SIZE
_STRIP = np.ones(256, bool)  # bytes of a word proper: letters, digits, beyond ASCII
_STRIP[:128] = False
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _STRIP[_lo:_hi] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Vocabulary:
    """Distinct words of a run of texts: word hash, trigram buckets, and each text's words as indices."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        keep = _STRIP[data] | (data <= 32)
        before = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
        data, off = LOWER[data[keep]], before[off]
        starts, ends, self.first = word_spans(data, off)
        self.data, self.starts, self.ends = data, starts, ends
        h, one, self.word = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        self.hash = h
        size = (ends - starts)[one]
        letter = np.concatenate([data, np.zeros(HEAD, np.uint8)])[starts[one][:, None] + np.arange(HEAD)]
        self.head = mix((np.where(np.arange(HEAD) < size[:, None], letter, 0).astype(np.uint64) << np.arange(0, 8 * HEAD, 8, dtype=np.uint64)).sum(1, dtype=np.uint64))
        begin = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(starts[one] - begin[:-1], size) + np.arange(begin[-1])
        padded = np.concatenate([[0], data, [0]]).astype(np.int64)
        word = np.repeat(np.arange(len(one)), size)
        left = np.where(np.arange(len(at)) == begin[:-1][word], 0, padded[at])
        right = np.where(np.arange(len(at)) == begin[1:][word] - 1, 0, padded[np.minimum(at + 2, len(padded) - 1)])
        self.trigram = (left * 73856093 ^ padded[at + 1] * 19349663 ^ right * 83492791) % TRIGRAMS
        self.trigram_first = begin

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Word indices of all windows (one past the last word: padding) and each window's text."""
        n = np.diff(self.first)
        count = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
        text = np.repeat(np.arange(len(n)), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        at = (self.first[:-1][text] + nth * STRIDE)[:, None] + np.arange(WINDOW)
        words = np.append(self.word, len(self.hash))
        return words[np.where(at < self.first[1:][text][:, None], at, len(self.word))], text

    def spelled(self, text: int, nth: int) -> bytes:
        """The words proper of a text's nth window, with spaces between."""
        lo = self.first[text] + nth * STRIDE
        hi = min(lo + WINDOW, self.first[text + 1])
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[lo:hi], self.ends[lo:hi], strict=True))


class BiGRU:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        g = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        self.p = {"word": g(WORDS, WORD_SIZE, s=0.1), "head": g(HEADS, HEAD_SIZE, s=0.1), "trigram": g(TRIGRAMS, TRIGRAM_SIZE, s=0.1)}
        for d in "fb":
            self.p |= {f"{d}w": g(_INPUT, 3 * HIDDEN, s=_INPUT**-0.5), f"{d}u": g(HIDDEN, 3 * HIDDEN, s=HIDDEN**-0.5), f"{d}c": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"att": g(2 * HIDDEN, 2 * HIDDEN, s=0.3), "query": g(2 * HIDDEN, s=0.3), "out": g(2 * HIDDEN, s=0.3), "bias": np.zeros(1, np.float32)}
        self.trained = False

    def inputs(self, v: Vocabulary) -> np.ndarray:
        """A row for each distinct word, and a zero row for padding."""
        out = np.zeros((len(v.hash) + 1, _INPUT), np.float32)
        n = len(v.hash)
        if n:
            out[:n, :WORD_SIZE] = self.p["word"][v.hash % np.uint64(WORDS)]
            size = np.diff(v.trigram_first)
            total = np.add.reduceat(self.p["trigram"][v.trigram], v.trigram_first[:-1])
            out[:n, WORD_SIZE : WORD_SIZE + HEAD_SIZE] = self.p["head"][v.head % np.uint64(HEADS)]
            out[:n, WORD_SIZE + HEAD_SIZE :] = total / size[:, None]
        return out

    def _read(self, d: str, projected: np.ndarray, ids: np.ndarray, hold: list | None = None) -> np.ndarray:
        """States of one direction, (windows, WINDOW, HIDDEN). projected: input rows times the input weights."""
        u, size = self.p[f"{d}u"], HIDDEN
        h = np.zeros((len(ids), size), np.float32)
        out = np.empty((len(ids), WINDOW, size), np.float32)
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            x = projected[ids[:, t]]
            rec = h @ u
            zr = _sigmoid(x[:, : 2 * size] + rec[:, : 2 * size])
            z, r = zr[:, :size], zr[:, size:]
            c = np.tanh(x[:, 2 * size :] + r * rec[:, 2 * size :])
            new = h + z * (c - h)
            if hold is not None:
                hold.append((t, h, z, r, c, rec[:, 2 * size :]))
            h = out[:, t] = new
        return out

    def forward(self, rows: np.ndarray, ids: np.ndarray, hold: dict | None = None) -> np.ndarray:
        p = self.p
        hs = []
        for d in "fb":
            steps = [] if hold is not None else None
            hs.append(self._read(d, rows @ p[f"{d}w"] + p[f"{d}c"], ids, steps))
            if hold is not None:
                hold[d] = steps
        h = np.concatenate(hs, 2)
        k = np.tanh(h @ p["att"])
        a = k @ p["query"]
        a = np.where(ids == len(rows) - 1, np.float32(-30), a)
        a = np.exp(a - a.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        pooled = np.einsum("bt,bth->bh", a, h)
        if hold is not None:
            hold |= {"h": h, "k": k, "a": a, "pooled": pooled}
        return pooled @ p["out"] + p["bias"]

    def gradients(self, v: Vocabulary, rows: np.ndarray, ids: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        p, hold = self.p, {}
        logit = self.forward(rows, ids, hold)
        d = ((_sigmoid(logit) - target) / len(ids)).astype(np.float32)
        h, k, a, pooled = (hold[x] for x in ("h", "k", "a", "pooled"))
        g = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
        dp = d[:, None] * p["out"]
        dh = a[:, :, None] * dp[:, None, :]
        da = np.einsum("bth,bh->bt", h, dp)
        ds = a * (da - (a * da).sum(1, keepdims=True))
        g["query"] = np.einsum("bt,btk->k", ds, k)
        dk = ds[:, :, None] * p["query"] * (1 - k * k)
        g["att"] = np.einsum("bth,btk->hk", h, dk)
        dh += dk @ p["att"].T
        drows = np.zeros_like(rows)
        for n, side in enumerate("fb"):
            u, w = p[f"{side}u"], p[f"{side}w"]
            gu, gx = np.zeros_like(u), np.zeros((len(rows), 3 * HIDDEN), np.float32)
            carry = np.zeros((len(ids), HIDDEN), np.float32)
            for t, before, z, r, c, rec in reversed(hold[side]):
                up = carry + dh[:, t, n * HIDDEN : (n + 1) * HIDDEN]
                dc = up * z * (1 - c * c)
                dz = up * (c - before) * z * (1 - z)
                dr = dc * rec * r * (1 - r)
                gate = np.concatenate([dz, dr, dc * r], 1)
                gu += before.T @ gate
                carry = up * (1 - z) + gate @ u.T
                np.add.at(gx, ids[:, t], np.concatenate([dz, dr, dc], 1))
            g[f"{side}u"], g[f"{side}w"], g[f"{side}c"] = gu, rows.T @ gx, gx.sum(0)
            drows += gx @ w.T
        used = np.flatnonzero(drows[:-1].any(1))
        for name in ("word", "head", "trigram"):
            g[name] = np.zeros_like(p[name])
        np.add.at(g["word"], (v.hash[used] % np.uint64(WORDS)).astype(np.int64), drows[used, :WORD_SIZE])
        np.add.at(g["head"], (v.head[used] % np.uint64(HEADS)).astype(np.int64), drows[used, WORD_SIZE : WORD_SIZE + HEAD_SIZE])
        size = np.diff(v.trigram_first)[used]
        at = np.repeat(v.trigram_first[:-1][used] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        np.add.at(g["trigram"], v.trigram[at], np.repeat(drows[used, WORD_SIZE + HEAD_SIZE :] / size[:, None], size, axis=0))
        return g

    def pick(self, data: np.ndarray, off: np.ndarray, key: np.ndarray, toxic: np.ndarray, epoch: int, shares: tuple[float, float] = (1.0, 1.0)) -> list[list[bytes]]:
        """The windows of each whole text that an epoch trains on. shares: of a text's windows that chance takes in the first epochs, and of a clean text's later."""
        v = Vocabulary(data, off)
        ids, text = v.windows()
        edge = np.searchsorted(text, np.arange(len(off)))
        score = self.logits(v, ids) if epoch >= WARM_EPOCHS else None

        def by_chance(i: int, share: float) -> np.ndarray:
            n = int(edge[i + 1] - edge[i])
            h = mix(key[i] ^ mix(np.arange(n, dtype=np.uint64) + np.uint64(epoch + 1 << 40)))
            return np.argsort(h, kind="stable")[: math.ceil(n * share)]

        def own(i: int) -> np.ndarray:
            if score is None:
                return by_chance(i, shares[0])
            worst = score[edge[i] : edge[i + 1]].argmax()
            return np.array([worst, worst]) if toxic[i] else np.append(by_chance(i, shares[1]), worst)

        return [[v.spelled(i, int(n)) for n in own(i)] for i in range(len(off) - 1)]

    def start(self, toxic: int, clean: int) -> None:
        """Begin at the odds of the training texts."""
        self.p["bias"][0] = np.log((toxic + 1) / (clean + 1))

    def train(self, rounds: Iterable[tuple[list[bytes], np.ndarray]], epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, decay: float = 0.6, seed: int = 3) -> None:
        """Each round has the windows of an epoch and their labels, and is asked for when the one before is done. decay: shared by the windows of an epoch."""
        rng = np.random.default_rng(seed)
        m, s, step = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for epoch, (windows, target) in enumerate(rounds):
            v = Vocabulary(np.frombuffer(b"".join(windows), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in windows])]).astype(np.int64))
            ids, _ = v.windows()
            passes = -(-LEAST_BATCHES // -(-len(ids) // batch))
            for b in (x for _ in range(passes) for x in _batches(rng.permutation(len(ids)), batch)):
                need, local = np.unique(ids[b], return_inverse=True)
                part = _part(v, need)
                local = local.reshape(len(b), WINDOW)
                local = np.where(ids[b] == len(v.hash), len(part.hash), local)
                g = self.gradients(part, self.inputs(part), local, target[b].astype(np.float32))
                step += 1
                for k, x in self.p.items():
                    gk = g[k] + decay / len(ids) * x if k != "bias" else g[k]
                    m[k] += 0.1 * (gk - m[k])
                    s[k] += 0.001 * (gk * gk - s[k])
                    x -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        self.trained = True

    def logits(self, v: Vocabulary, ids: np.ndarray) -> np.ndarray:
        rows = self.inputs(v)
        return np.concatenate([self.forward(rows, ids[lo : lo + 2048]) for lo in range(0, len(ids), 2048)])

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Scores of whole texts."""
        if not self.trained:
            return np.zeros(len(off) - 1)
        v = Vocabulary(data, off)
        ids, text = v.windows()
        worst = np.maximum.reduceat(self.logits(v, ids), np.searchsorted(text, np.arange(len(off) - 1)))
        return _sigmoid(worst.astype(np.float64) + np.log(ODDS))


def _batches(order: np.ndarray, size: int) -> Iterator[np.ndarray]:
    return (order[lo : lo + size] for lo in range(0, len(order), size))


def _part(v: Vocabulary, words: np.ndarray) -> Vocabulary:
    """The vocabulary of these words only (padding left out)."""
    words = words[words < len(v.hash)]
    out = Vocabulary.__new__(Vocabulary)
    size = np.diff(v.trigram_first)[words]
    out.hash, out.head = v.hash[words], v.head[words]
    out.trigram_first = np.concatenate([[0], np.cumsum(size)])
    out.trigram = v.trigram[np.repeat(v.trigram_first[:-1][words] - out.trigram_first[:-1], size) + np.arange(size.sum())]
    return out


def chance_shares(texts: DataFrame) -> tuple[float, float]:
    """The shares of windows that chance takes of texts (toxic, text), so that they come to WARM_WINDOWS and CLEAN_WINDOWS."""
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    n = F.lit(1) + F.greatest(F.lit(0), F.ceil((words - WINDOW) / STRIDE))
    every, clean = texts.agg(F.sum(n), F.sum(F.when(F.col("toxic") == 0, n))).first()
    return tuple(min(1.0, most / max(1, have or 0)) for most, have in ((WARM_WINDOWS, every), (CLEAN_WINDOWS, clean)))


def windows_of(texts: DataFrame, model: BiGRU, epoch: int, shares: tuple[float, float] = (1.0, 1.0)) -> tuple[list[bytes], np.ndarray]:
    """What an epoch trains on: some windows of each text (key, toxic, text) and its label for each of them."""
    schema = pa.schema([("key", pa.int64()), ("toxic", pa.int32()), ("windows", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches):
            key, toxic = np.asarray(rows.column("key")), np.asarray(rows.column("toxic"))
            yield record(schema, rows.column("key"), rows.column("toxic"), pa.array(model.pick(data, off, key.view(np.uint64), toxic, epoch, shares), pa.list_(pa.binary())))

    got = texts.mapInArrow(run, "key long, toxic int, windows array<binary>").toArrow().sort_by("key")  # at most WARM_WINDOWS windows and two of each of TRAIN_ROWS texts
    windows = got.column("windows").to_pylist()
    return [w for own in windows for w in own], np.repeat(got.column("toxic").to_numpy(), [len(own) for own in windows])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = TRAIN_ROWS) -> BiGRU:
    """Train on labelled documents (labels: doc_id, toxic) whose id fulfils `usable`."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.filter(usable & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(rows)
    found = text_of(docs, "doc_id").join(F.broadcast(picked), "doc_id").filter("text is not null")  # at most TRAIN_ROWS ids
    model = BiGRU()
    with Scratch(spark) as scratch:
        texts = found.groupBy("text").agg(F.max("toxic").alias("toxic")).select(F.xxhash64("text").alias("key"), "toxic", "text")
        texts = scratch.written(texts.sortWithinPartitions("key"), "training")
        if texts.count() > rows:  # ids with several texts
            last = texts.select("key").orderBy("key").limit(rows).agg(F.max("key")).first()[0]
            texts = texts.filter(F.col("key") <= last)
        n, toxic = texts.agg(F.count(F.lit(1)), F.sum("toxic")).first()
        if n:
            model.start(toxic, n - toxic)
            shares = chance_shares(texts)
            model.train(windows_of(texts, model, epoch, shares) for epoch in range(EPOCHS))
    return model


def predict(docs: DataFrame, model: BiGRU) -> DataFrame:
    """doc_id and score of every whole text."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches):
            yield record(schema, rows.column("doc_id"), model.score(data, off))

    return text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, score double")
