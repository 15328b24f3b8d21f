"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; documents drawn from the whole table, whatever their
label, are the unlabelled set. With class prior p the risk is p * R(positives as 1) plus the larger of
0 and R(unlabelled as 0) - p * R(positives as 0): unlabelled documents count as negatives less the
toxic share among them, and that part is kept from turning negative, which is what would let a
flexible model overfit. Features are the words of a text and the beginnings that
some of its words share (a toxic stem shows in words that no training text has); the ``FEATURES`` most telling ones are chosen by their document
frequencies, summed by Spark.

Bounds: at most ``POSITIVES`` and ``UNLABELLED`` documents are read for the fit, and the class prior is
the toxic share of the labelled rows to learn from. Every document is scored over its whole text, however
long. Defined cases: a null or empty text scores by the bias alone; without a positive every score is 0
(to thirteen digits). Repeated rows are scored each; extra columns are ignored. Features that tie for the
last place go by their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlake.llm.common import cut_lineage, dealt, spread

POSITIVES = 4000
UNLABELLED = 12000
FEATURES = 512
# A feature counts if its document shares lie at least so many standard deviations apart.
MIN_APART = 4.0
# ... and it is so many times as common among the positives.
MIN_LIFT = 3.0
STEMS = (4, 5, 6)
TIMES = (1, 2, 3)
LETTERS = re.compile(r"[^\W\d_]+")
# So many texts are expanded at a time: their features take many times the memory of the texts.
EXPANDED = 64


def features(text: str | None, stems: set[str] | None = None) -> set[str]:
    """The words of a text in lower case, and ``k^stem`` for each beginning that k words or more share.

    Where ``stems`` is given, only these beginnings are counted.
    """
    counts = Counter(LETTERS.findall(text.lower())) if text else Counter()
    begun: Counter[str] = Counter()
    for word, n in counts.items():
        for k in STEMS:
            stem = word[:k]
            if len(stem) == k and (stems is None or stem in stems):
                begun[stem] += n
    return counts.keys() | {f"{k}^{stem}" for stem, n in begun.items() for k in TIMES if n >= k}


def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The features of documents to learn from, ``EXPANDED`` documents at a time."""
    for b in batches:
        for at in range(0, len(b), EXPANDED):
            some = b.iloc[at : at + EXPANDED]
            yield pd.DataFrame({"doc_id": some.doc_id, "positive": some.positive, "features": [sorted(features(t)) for t in some.text]})


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        self.stems = {f.split("^")[1] for f in self.weights if "^" in f}

    def score(self, text: str | None) -> float:
        found = features(text, self.stems) & self.weights.keys()
        logit = self.bias + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def nnpu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, l2: float = 1e-3) -> np.ndarray:
    """Weights (bias last) that lower the non-negative risk under the logistic loss, by Adam steps.

    While the negative part of the risk is below zero, the step goes up that part instead.
    """
    p, u = (np.hstack([a, np.ones((len(a), 1), np.float32)]) for a in (p, u))
    w, m, v = (np.zeros(p.shape[1]) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g = su @ u / len(u) - prior * (sp @ p / len(p))
        g = prior * ((sp - 1) @ p / len(p)) + g if negative >= 0 else -g
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sample(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column) -> DataFrame:
    """(positive, text) of the documents to learn from; the drawn ids are bounded and so broadcast."""

    def draw(ids: DataFrame, n: int) -> DataFrame:
        return ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)

    own = labels.filter(learn_from)
    positive = draw(own.filter(F.col(label) == 1), POSITIVES).withColumn("positive", F.lit(1))
    unlabelled = draw(docs.filter(learn_from), UNLABELLED).withColumn("positive", F.lit(0))
    return docs.select("doc_id", "text").join(F.broadcast(positive.unionByName(unlabelled)), "doc_id")


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, label: str = "toxic") -> Model:
    own = labels.filter(learn_from & F.col(label).isin(0, 1))
    prior, rows = own.agg(F.avg(label), F.count("*")).first()
    if not prior or not rows:
        return Model({}, -30.0)
    prior = min(prior, 0.9)
    sample = dealt(_sample(docs, labels, label, learn_from)).mapInPandas(expand, "doc_id long, positive int, features array<string>")
    sample = cut_lineage(sample)  # read three times below; the texts are read once
    sizes = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    if not n_p or not n_u:
        return Model({}, -30.0)
    in_p, in_u = F.sum("positive") / n_p, F.sum(1 - F.col("positive")) / n_u
    # How far the shares of documents with the feature lie apart, in standard deviations of chance.
    apart = (in_p - in_u) / F.sqrt(in_u / n_p + in_u / n_u + 1 / (n_p * n_p))
    chosen = (
        sample.select("positive", F.explode("features").alias("feature"))
        .groupBy("feature").agg(apart.alias("apart"), (in_p > MIN_LIFT * in_u).alias("lifted"), F.sum("positive").alias("n"))
        .filter((F.col("n") >= 3) & F.col("lifted") & (F.col("apart") >= MIN_APART)).orderBy(F.desc("apart"), "feature").limit(FEATURES)
    )
    names = [r["feature"] for r in chosen.collect()]
    has = F.array_intersect("features", F.array(*map(F.lit, names)).cast("array<string>"))
    got = sample.select("doc_id", "positive", has.alias("has")).toPandas().sort_values(["positive", "doc_id"], ignore_index=True)
    at = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(got), len(names)), np.float32)
    for row, has_features in enumerate(got["has"]):
        x[row, [at[f] for f in has_features]] = 1
    w = nnpu(x[got.positive == 1], x[got.positive == 0], prior)
    return Model(dict(zip(names, map(float, w[:-1]))), float(w[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "score": [model.score(t) for t in b.text]})

    return spread(docs.select("doc_id", "text")).mapInPandas(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3) -> DataFrame:
    model = train(docs, labels, ~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3) -> DataFrame:
    """Documents that the model calls toxic go; the rest keep their columns. Texts are not shuffled."""
    model = train(docs, labels, ~held_out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[model.score(t) < threshold for t in b.text]]

    return docs.mapInPandas(run, docs.schema)
