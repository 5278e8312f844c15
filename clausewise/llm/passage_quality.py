"""Quality classifier by attention over a document's passages (multiple-instance learning).

A document is a bag of passages of ``PASSAGE`` words, all of them. Each passage is encoded
by a layer over its rates of character classes, hashed byte pairs and word statistics;
gated attention weighs the passages, and a logistic unit scores their weighted sum. Only
documents have labels; encoder, attention and score are learned together from a bounded
sample of labelled rows (``max_rows``, those with the smallest hash of their id).

Null and empty text are one empty passage and get a score; without labelled rows all scores
are 0.5; repeated rows score alike; a row with a null label is not learned from; other
columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewise.llm.common import whole_text
from clausewise.llm.language_id import _portions

PASSAGE = 64
PAIRS = 64
#: Bytes by class; what no class names is the last but one, beyond ASCII the last.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n",
           b"\t\x0b\x0c\r\0", b".", b",", b";:", b"!", b"?", b"|", b"#*$%&<>", b"\"'`", b"()[]{}", b"-_/\\=+~^@")
N_CLASSES = len(CLASSES) + 2
WIDTH = N_CLASSES + PAIRS + 6


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.int32)
    table[128:] = len(CLASSES) + 1
    for i, chars in enumerate(CLASSES):
        table[list(chars)] = i
    return table


_CLASS = _class_table()
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r\0"))


def passages(texts: list[str], words: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every text, and the position of its text.

    A passage is a range of bytes: from its first word to the next passage's, the first
    one of a text from the text's beginning.
    """
    b = np.frombuffer(b"\0".join([t.replace("\0", " ").encode("utf-8", "replace") for t in texts] + [b""]), np.uint8)
    blank = _SPACE[b]
    ends = np.flatnonzero(b == 0)  # one behind each text
    turn = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    begin, end = turn[::2], turn[1::2]
    n_words = np.diff(np.searchsorted(begin, ends), prepend=0)
    n_pass = np.maximum(1, -(-n_words // words))
    owner = np.repeat(np.arange(len(texts)), n_pass)
    total = len(owner)
    first_pass, first_word = np.cumsum(n_pass) - n_pass, np.cumsum(n_words) - n_words
    nth = np.arange(total) - first_pass[owner]
    word_of = np.minimum(first_word[owner] + nth * words, max(0, len(begin) - 1))
    start = np.where(nth == 0, np.concatenate([[0], ends[:-1] + 1])[owner], begin[word_of] if len(begin) else 0)
    size = np.diff(np.append(start, len(b)))
    at = np.repeat(np.arange(total, dtype=np.int32), size)
    kind = at * np.int32(N_CLASSES) + _CLASS[b]
    rates = np.bincount(kind, minlength=total * N_CLASSES).reshape(total, N_CLASSES)
    pair = (b[:-1].astype(np.uint32) * np.uint32(257) + b[1:]) * np.uint32(0x9E3779B1) >> np.uint32(26)
    own = b[:-1] != 0  # not from one text to the next
    pairs = np.bincount((at[:-1] * np.int32(PAIRS) + pair.astype(np.int32))[own],
                        minlength=total * PAIRS).reshape(total, PAIRS)
    # Word statistics: count, mean and spread of lengths, distinct words, words repeated at once.
    other = np.zeros((total, 6))
    if len(begin):
        word_pass = np.repeat(np.arange(total), np.diff(np.searchsorted(begin, start), append=len(begin)))
        length = end - begin
        code = length.astype(np.uint64)
        for place in (0, 1, 2, 3, 4, 6, -1, -2, -3):  # enough of a word to tell it from others
            where = np.minimum(begin + place, end - 1) if place >= 0 else np.maximum(end + place, begin)
            code = (code * np.uint64(0x9E3779B97F4A7C15)) ^ b[where]
        n = np.bincount(word_pass, minlength=total)
        m = np.maximum(1, n)
        mean = np.bincount(word_pass, length, total) / m
        spread = np.sqrt(np.maximum(0, np.bincount(word_pass, length.astype(float) ** 2, total) / m - mean ** 2))
        key = np.sort((word_pass.astype(np.uint64) << np.uint64(32)) | ((code ^ (code >> np.uint64(29))) & np.uint64(0xFFFFFFFF)))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        distinct = np.bincount((key[new] >> np.uint64(32)).astype(np.int64), minlength=total)
        again = np.concatenate([[False], (code[1:] == code[:-1]) & (word_pass[1:] == word_pass[:-1])])
        other[:] = np.stack([np.log1p(n), mean / 10, spread / 10, distinct / m,
                             np.bincount(word_pass[again], minlength=total) / m,
                             np.log1p(n_words[owner])], axis=1)
    size = np.maximum(1, size)[:, None]
    return np.concatenate([rates / size, pairs / size, other], axis=1).astype(np.float32), owner


class Attention:
    """Encoder, gated attention and score; ``fit`` by Adam, gradients by hand."""

    def __init__(self, hidden: int = 32, gate: int = 16, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"E": r.normal(0, WIDTH ** -0.5, (WIDTH, hidden)), "e": np.zeros(hidden),
                  "V": r.normal(0, hidden ** -0.5, (hidden, gate)), "U": r.normal(0, hidden ** -0.5, (hidden, gate)),
                  "w": r.normal(0, gate ** -0.5, gate), "s": r.normal(0, hidden ** -0.5, hidden), "c": np.zeros(1)}
        self.mean, self.scale, self.fitted = np.zeros(WIDTH), np.ones(WIDTH), False

    def _forward(self, x: np.ndarray, start: np.ndarray, owner: np.ndarray) -> dict:
        p = self.p
        h = np.maximum(0, x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        a = (t * g) @ p["w"]
        a = np.exp(a - np.maximum.reduceat(a, start)[owner])
        a /= np.add.reduceat(a, start)[owner]
        z = np.add.reduceat(a[:, None] * h, start, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["s"] + p["c"], -30, 30)))
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": y}

    def _gradients(self, x, start, owner, label) -> dict:
        p, f = self.p, self._forward(x, start, owner)
        dy = (f["y"] - label) / len(label)
        dz = dy[:, None] * p["s"]
        da = (dz[owner] * f["h"]).sum(axis=1)
        da = f["a"] * (da - np.add.reduceat(f["a"] * da, start)[owner])
        dt, dg = da[:, None] * p["w"] * f["g"], da[:, None] * p["w"] * f["t"]
        dt, dg = dt * (1 - f["t"] ** 2), dg * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz[owner] + dt @ p["V"].T + dg @ p["U"].T) * (f["h"] > 0)
        return {"E": x.T @ dh, "e": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
                "w": (da[:, None] * f["t"] * f["g"]).sum(axis=0), "s": f["z"].T @ dy, "c": np.array([dy.sum()])}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 64,
            rate: float = 0.005, decay: float = 1e-4, seed: int = 7) -> Attention:
        if not len(bags):
            return self
        every = np.concatenate(bags)
        self.mean, self.scale, self.fitted = every.mean(axis=0), every.std(axis=0) + 1e-3, True
        bags = [(x - self.mean) / self.scale for x in bags]
        r = np.random.default_rng(seed)
        m, v, step = {k: 0 * a for k, a in self.p.items()}, {k: 0 * a for k, a in self.p.items()}, 0
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for at in range(0, len(bags), batch):
                some = order[at:at + batch]
                size = np.array([len(bags[i]) for i in some])
                start = np.concatenate([[0], np.cumsum(size)[:-1]])
                grad = self._gradients(np.concatenate([bags[i] for i in some]), start,
                                       np.repeat(np.arange(len(some)), size), labels[some])
                step += 1
                for k, g in grad.items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def score(self, x: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Score of each of n texts and the largest weight a passage of it has."""
        if not self.fitted:
            return np.full(n, 0.5), np.zeros(n)
        start = np.searchsorted(owner, np.arange(n))
        f = self._forward((x - self.mean) / self.scale, start, owner)
        return f["y"], np.maximum.reduceat(f["a"], start)


def _thinned(x: np.ndarray, most: int) -> np.ndarray:
    """At most so many rows: means of neighbours, so the whole text still counts."""
    if len(x) <= most:
        return x
    return np.stack([part.mean(axis=0) for part in np.array_split(x, most)])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 4000,
        max_passages: int = 64) -> Attention:
    """Attention model from at most ``max_rows`` labelled rows. In learning, a text of more
    than ``max_passages`` passages is that many means of neighbouring passages."""
    chosen = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = docs.select("doc_id", whole_text().alias("_text")).join(F.broadcast(chosen), "doc_id")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = list(pdf["_text"])
            for a, b in _portions(texts, 2_000_000):
                x, owner = passages(texts[a:b])
                at = np.searchsorted(owner, np.arange(b - a + 1))
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[a:b], "label": pdf["_label"].iloc[a:b], "bag": [
                    _thinned(x[at[i]:at[i + 1]], max_passages).astype("<f4").tobytes() for i in range(b - a)]})

    got = rows.mapInPandas(encode, "doc_id long, label int, bag binary")
    # Repeated ids would exceed the bound.
    found = got.orderBy(F.xxhash64("doc_id"), "doc_id", "bag").limit(max_rows).collect()
    bags = [np.frombuffer(r["bag"], "<f4").reshape(-1, WIDTH).astype(float) for r in found]
    return Attention().fit(bags, np.array([r["label"] for r in found], float))


def score(docs: DataFrame, model: Attention) -> DataFrame:
    """The input's columns with score and attention (the largest weight of a passage)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    keep = docs.drop("score", "attention")
    schema = T.StructType([*keep.schema.fields, T.StructField("score", T.DoubleType()),
                           T.StructField("attention", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for a, b in _portions(texts, 2_000_000):
                out = pdf.iloc[a:b].copy()
                out["score"], out["attention"] = model.score(*passages(texts[a:b]), b - a)
                yield out

    return keep.mapInPandas(run, schema)
