"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal steps.

Two streams of n-grams (one and two words) share one hashed space: the words in lower case, and the
forms of the words, in which runs of letters and digits are replaced by their kind and a word that
repeats the one before it is marked. A feature's value is its damped count, each stream scaled to
length one, so that long and short texts weigh alike. The follow-the-regularised-leader update keeps
per-coordinate step sizes and sets weak weights to exactly zero; scoring is a sparse dot product.

The fit reads at most ``TRAIN_ROWS`` labelled rows; of a text with more than ``TRAIN_FEATURES`` n-grams it takes
those that weigh most (documented bounds: 0.4 GB on the driver); every document is scored over its whole
text, however long. Defined cases: a null or empty text scores by the bias alone; with no labelled rows
of either kind every score is 0.5. Of repeated label rows the largest label counts; repeated rows are
scored each, extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlake.llm.common import dealt, labelled, spread, words_of

TRAIN_ROWS = 6000
TRAIN_FEATURES = 8192
BITS = 20
# Capitals (two or more, Latin-1 ones as UTF-8 writes them), other letters, digits.
KINDS = ((re.compile(rb"(?:[A-Z]|\xc3[\x80-\x96\x98-\x9e]){2,}"), b"A"), (re.compile(rb"[A-Za-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0"))
KNOWN_FORMS = 300_000
_forms: dict[bytes, bytes] = {}


def form(word: bytes) -> bytes:
    """The word with its letters and digits replaced by their kind; capital A stands for all capitals."""
    if (found := _forms.get(word)) is None:
        if len(_forms) > KNOWN_FORMS:
            _forms.clear()
        found = word
        for pattern, kind in KINDS:
            found = pattern.sub(kind, found) if kind != b"a" else pattern.sub(lambda m: b"A" if m[0] == b"A" else b"a", found)
        _forms[word] = found = found[:16]
    return found


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hashed index, value) of a text's n-grams."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    forms = [form(w) for w in words]
    forms[1:] = [b"=" + f if a == b else f for a, b, f in zip(words, words[1:], forms[1:])]
    lower = [w.lower() for w in words]
    index, value = [], []
    for mark, stream in ((b"w", lower), (b"f", forms)):
        counts = Counter(stream)
        counts.update(zip(stream, stream[1:]))
        keys = [mark + (k if isinstance(k, bytes) else b" ".join(k)) for k in counts]
        v = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
        index.append(np.fromiter((zlib.crc32(k) & ((1 << BITS) - 1) for k in keys), np.int32, len(keys)))
        value.append(v / np.sqrt(v @ v))
    return np.concatenate(index), np.concatenate(value)


def folded(index: np.ndarray, value: np.ndarray, most: int = TRAIN_FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """A vector of at most ``most`` entries: of a longer one those that weigh most, which have its common n-grams, scaled to its length."""
    if len(index) <= most:
        return index, value
    kept = np.sort(np.argsort(-value, kind="stable")[:most])
    return index[kept], value[kept] * np.float32(np.sqrt(value @ value) / np.sqrt(value[kept] @ value[kept]))


class Ftrl:
    """Logistic regression with FTRL-proximal updates; index 2**BITS is the bias."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.3, l2: float = 1.0) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, i: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, i: np.ndarray, x: np.ndarray, y: int) -> None:
        i, x = np.append(i, 1 << BITS), np.append(x, 1.0)
        w = self.weights(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        step = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha
        np.add.at(self.z, i, g - step * w)
        np.add.at(self.n, i, g * g)


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [folded(*features(t)) for t in b.text]
        yield pd.DataFrame({"doc_id": b.doc_id.to_numpy(), "y": b.y.to_numpy(), "i": [r[0] for r in rows], "x": [r[1] for r in rows]})


def train(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, rows: int = TRAIN_ROWS, epochs: int = 4) -> np.ndarray:
    """Weights of the model, with the bias last. At most ``rows`` sparse vectors come to the driver."""
    sample = dealt(labelled(docs, labels, label, learn_from, rows))
    got = sample.mapInPandas(_vectors, "doc_id long, y int, i array<int>, x array<float>").toPandas()
    if got.y.nunique() < 2:
        return np.zeros((1 << BITS) + 1, np.float32)
    got = got.sort_values("doc_id", ignore_index=True)
    model, order = Ftrl(), np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(got)):
            model.learn(got.i[k], got.x[k], got.y[k])
    return model.weights(slice(None)).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row: the probability of label 1."""
    at = np.flatnonzero(weights[:-1]).astype(np.int32)
    kept, bias = weights[at], float(weights[-1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = np.zeros(1 << BITS, np.float32)
        w[at] = kept
        for b in batches:
            logit = np.array([bias + float(w[i] @ x) for i, x in map(features, b.text)])
            yield pd.DataFrame({"doc_id": b.doc_id, "score": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))})

    return spread(docs.select("doc_id", "text")).mapInPandas(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    weights = train(docs, labels, label, ~held_out)
    return score(docs, weights).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
