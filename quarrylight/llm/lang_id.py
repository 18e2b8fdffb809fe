"""Language ID by a byte convolutional network in numpy.

Texts are cut into fixed windows of WINDOW bytes (each with the few bytes after it that the widest
filter needs, so no n-gram is missed). Bytes are embedded, convolved with filters of several widths,
max-pooled over the window, and a softmax layer gives the languages. A text's prediction is the mean of
its windows' probabilities, weighted by their letters.

Training uses distinct labelled texts, taken by hash and each with all its windows: at most TRAIN_TEXTS texts and
TRAIN_WINDOWS windows a language, for every language that is labelled. These bounds are the only sample
(a text of more than TRAIN_WINDOWS windows is never in it); every byte of every text is scored.

Defined cases: null text, or text without a letter, gives `und` with score 0; texts of any length are scored whole; of equally
likely languages the first in alphabetical order wins; a table without labels, or without rows, learns nothing and gives `und`
throughout; repeated rows get equal results; columns that aren't in `keep`, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, chunks, record, ship, text_of, with_fields

WINDOW = 192
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 12, 8
#: Labelled texts and their windows a language, and passes over the windows. Every language that is labelled can be predicted.
TRAIN_TEXTS, TRAIN_WINDOWS, EPOCHS = 400, 3000, 4
UNKNOWN = "und"

_SPAN = WINDOW + max(WIDTHS) - 1
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts as rows of lower-cased bytes, zero beyond the text, and each row's text."""
    lengths = np.diff(off)
    n = -(-lengths // WINDOW)
    text = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    at = (off[text] + nth * WINDOW)[:, None] + np.arange(_SPAN)
    padded = np.concatenate([LOWER[data], np.zeros(1, np.uint8)])
    return padded[np.where(at < off[text + 1][:, None], at, len(data))], text


class ByteCNN:
    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.embed = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.embed[0] = 0
        self.filters = [rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def _parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, self.out_bias]

    def train(self, rows: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on the cross-entropy; only the window place that wins the max-pooling gets a gradient."""
        rng = np.random.default_rng(seed)
        par = self._parameters()
        m, v, step = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par], 0
        for epoch in range(epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(rows), batch):
                x, y = rows[order[lo : lo + batch]], target[order[lo : lo + batch]]
                b = len(x)
                e = self.embed[x]
                pooled, won = [], []
                for w, k in zip(WIDTHS, self.filters, strict=True):
                    cols = np.concatenate([e[:, j : j + WINDOW] for j in range(w)], axis=2)
                    z = cols @ k
                    best = z.argmax(1)
                    pooled.append(np.take_along_axis(z, best[:, None], 1)[:, 0])
                    won.append(best)
                z = np.concatenate(pooled, 1) + self.bias
                a = np.maximum(z, 0)
                s = a @ self.out + self.out_bias
                p = np.exp(s - s.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(b), y] -= 1
                p /= b
                grads = [np.zeros_like(self.embed)]
                dz = (p @ self.out.T) * (z > 0)
                for i, (w, k) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                    d = dz[:, i * FILTERS : (i + 1) * FILTERS]
                    at = won[i][:, :, None] + np.arange(w)
                    seen = x[np.arange(b)[:, None, None], at]
                    cols = self.embed[seen].reshape(b, FILTERS, w * EMBEDDING)
                    grads.append(np.einsum("bf,bfc->cf", d, cols))
                    np.add.at(grads[0], seen, (d[:, :, None] * k.T).reshape(b, FILTERS, w, EMBEDDING))
                grads[0][0] = 0
                grads += [dz.sum(0), a.T @ p, p.sum(0)]
                step += 1
                r = rate * (1 - epoch / epochs)
                for q, g, mm, vv in zip(par, grads, m, v, strict=True):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    q -= r * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)

    def tables(self) -> list[np.ndarray]:
        """For each byte offset, what each byte adds to the filters that reach so far: a convolution by lookup."""
        out = []
        for j in range(max(WIDTHS)):
            out.append(np.concatenate([self.embed @ k[j * EMBEDDING : (j + 1) * EMBEDDING] for w, k in zip(WIDTHS, self.filters, strict=True) if w > j], 1).astype(np.float32))
        return out

    def probabilities(self, rows: np.ndarray, tables: list[np.ndarray] | None = None, batch: int = 128) -> np.ndarray:
        tables = tables or self.tables()
        out = np.zeros((len(rows), len(self.labels)), np.float32)
        for lo in range(0, len(rows), batch):
            x = rows[lo : lo + batch]
            z = tables[0][x[:, :WINDOW]]
            for j, t in enumerate(tables[1:], 1):
                z[:, :, -t.shape[1] :] += t[x[:, j : j + WINDOW]]
            s = np.maximum(z.max(1) + self.bias, 0) @ self.out + self.out_bias
            p = np.exp(s - s.max(1, keepdims=True))
            out[lo : lo + batch] = p / p.sum(1, keepdims=True)
        return out


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    total = np.concatenate([[0], np.cumsum((_LETTER & (np.arange(256) < 128))[data], dtype=np.int64)])
    found = total[off[1:]] > total[off[:-1]]
    for i in np.flatnonzero(~found & (np.diff(off) > 0)):
        found[i] = any(c.isalpha() for c in bytes(data[off[i] : off[i + 1]]).decode("utf-8", "replace"))
    return found


def fit(docs: DataFrame, usable: Column, texts: int = TRAIN_TEXTS, most_windows: int = TRAIN_WINDOWS) -> ByteCNN:
    """Train on rows where `usable` holds and lang isn't null."""
    ship(docs.sparkSession)
    labelled = text_of(docs, F.col("lang").cast("string").alias("lang"), usable.alias("usable")).filter("usable and lang is not null and octet_length(text) > 0")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row a language
    labels = sorted(counts)
    if not labels:
        return ByteCNN([UNKNOWN])
    # ten times the bound by hash, then distinct texts in the order of their hash: a bounded sample without a sort of all rows
    share = F.try_element_at(F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, min(1.0, 10 * texts / n))]), F.col("lang"))
    near = labelled.withColumns({"h": F.xxhash64("text"), "size": F.ceil(F.octet_length("text") / WINDOW)})
    near = near.filter((F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)) & (F.col("size") <= most_windows)).groupBy("lang", "h").agg(F.min("size").alias("size"))
    by = Window.partitionBy("lang").orderBy("h")
    near = near.withColumns({"nth": F.row_number().over(by), "windows": F.sum("size").over(by)})
    picked = near.filter((F.col("nth") <= texts) & (F.col("windows") <= most_windows)).select("lang", "h")
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("rows", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches):
            w, text = windows(data, off)
            first = np.searchsorted(text, np.arange(len(off)))
            yield record(schema, rows.column("lang"), rows.column("h"), [w[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)])

    whole = labelled.withColumn("h", F.xxhash64("text")).join(F.broadcast(picked), ["lang", "h"])  # at most TRAIN_TEXTS rows a language
    whole = whole.groupBy("lang", "h").agg(F.min("text").alias("text"))
    got = whole.mapInArrow(cut, "lang string, h long, rows binary").orderBy("lang", "h").collect()
    x = [np.frombuffer(r["rows"], np.uint8).reshape(-1, _SPAN) for r in got]
    y = np.repeat([labels.index(r["lang"]) for r in got], [len(w) for w in x])
    model = ByteCNN(labels)
    if x:
        model.train(np.concatenate(x), y)
    return model


def predict(docs: DataFrame, model: ByteCNN, keep: list[str] | None = None) -> DataFrame:
    """The columns of `keep` with lang_pred and score for every whole text."""
    ship(docs.sparkSession)
    tables, keep = model.tables(), keep or ["doc_id"]
    labels = model.labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches):
            n = rows.num_rows
            total = np.zeros((n, len(labels)))
            for lo, hi in _groups(off):
                w, text = windows(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                letters = _LETTER[w[:, :WINDOW]].sum(1) + 1e-3
                np.add.at(total, text + lo, model.probabilities(w, tables) * letters[:, None])
            total /= np.maximum(total.sum(1, keepdims=True), 1e-12)
            known = has_letter(data, off) & (labels != [UNKNOWN])
            best = total.argmax(1)
            score = np.clip(np.where(known, total[np.arange(n), best], 0.0), 0, 1)
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], pa.array([labels[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]), pa.array(score)], names=[*keep, "lang_pred", "score"])

    source = docs.select(*keep, *([F.col("text").cast("string").alias("text")] if "text" not in keep else []))
    return source.mapInArrow(run, with_fields(source, keep, "lang_pred string, score double"))


def _groups(off: np.ndarray, size: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `size` bytes, to bound the window arrays."""
    at, n = 0, len(off) - 1
    while at < n:
        to = min(max(int(np.searchsorted(off, off[at] + size, "right")) - 1, at + 1), n)
        yield at, to
        at = to
