"""Which texts of a dictionary stand in which documents: rolling hashes of all windows, set at a time.

Entries fall into classes by length: an entry of 2^k to 2^(k+1) - 1 characters is known by windows of half of 2^k. A
polynomial hash rolls over a text once for each class that the dictionary has. Of every run of windows
that 2^k characters hold only the least hash counts (a minimizer): an entry's first 2^k characters have the
same one wherever they stand, so a document has a row for a few per cent of its windows and still meets every
entry in it. Rows meet the dictionary by hash and are verified by the characters beside them.

A bitmap of the dictionary's hashes, of fixed size, keeps most windows of no entry in their task. The
dictionary itself is joined, broadcast up to ``MOST_BROADCAST`` entries and by Spark's choice beyond.

Defined cases: null and empty texts hold nothing, null and empty entries stand nowhere; repeated entries and
repeated documents are found each; an entry may stand in a text many times, overlapping itself. A very long text
is searched whole, in one task, in a few arrays as long as it is. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlake.sources.shared import cut_lineage

BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
INVERSE = pow(BASE, -1, 1 << 64)
MARK_BITS = 20
MOST_BROADCAST = 200_000
FOUND = "id long, k int, h long, at long, lead int, beside string"
ENTRY = "entry long, k int, h long, anchor int, size int, entry_text string"


def size_class(length: int) -> tuple[int, int, int]:
    """(k, characters of a window, windows of a run) for entries of 2^k characters and more."""
    k = length.bit_length() - 1
    window = max(1, (1 << k) >> 1)
    return k, window, (1 << k) - window + 1


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of all windows of a text, in any length."""

    def __init__(self, text: str) -> None:
        codes = codes_of(text)
        self.size = len(codes)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * powers(BASE, self.size), dtype=np.uint64)])
        self.down = powers(INVERSE, self.size)

    def windows(self, window: int, k: int) -> np.ndarray:
        """A mixed hash for each place where a window of class ``k`` fits."""
        n = self.size - window + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = (self.sums[window:] - self.sums[:n]) * self.down[:n] + np.uint64(k)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def sliding(op: np.ufunc, x: np.ndarray, width: int, filler: int) -> np.ndarray:
    """``op`` over every ``width`` neighbours, in two passes over blocks of that width."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    blocks = np.append(x, np.full(-len(x) % width, filler, x.dtype)).reshape(-1, width)
    before = op.accumulate(blocks, axis=1).ravel()
    after = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(after[:n], before[width - 1 : width - 1 + n])


def minimizers(hashes: np.ndarray, run: int) -> np.ndarray:
    """Places whose hash is the least of some run of windows."""
    least = sliding(np.minimum, hashes, run, (1 << 64) - 1)
    if not len(least):
        return np.zeros(0, np.int64)
    edge = np.zeros(run - 1, np.uint64)
    return np.flatnonzero(sliding(np.maximum, np.concatenate([edge, least, edge]), run, 0) == hashes)


def anchor(text: str) -> tuple[int, int, int]:
    """(k, hash, place) by which an entry is known: the least hash of its first run of windows."""
    k, window, run = size_class(len(text))
    first = Rolling(text[: window + run - 1]).windows(window, k)
    at = int(first.argmin())
    return k, int(first[at].view(np.int64)), at


def entries(dictionary: DataFrame) -> DataFrame:
    """(entry, k, h, anchor, size, entry_text) of a dictionary (entry, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(e, *anchor(t), len(t), t) for e, t in zip(b["entry"], b["text"])]
            yield pd.DataFrame(rows, columns=["entry", "k", "h", "anchor", "size", "entry_text"]).astype({"k": "int32", "anchor": "int32", "size": "int32"})

    return dictionary.select("entry", "text").filter("text <> '' AND entry IS NOT NULL").mapInPandas(run, ENTRY)


def occurrences(docs: DataFrame, dictionary: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(id, entry, at): every place, in characters from 0, where an entry of a dictionary (entry, text) stands in a text of docs (id, text)."""
    known = cut_lineage(entries(dictionary))
    classes = sorted(r["k"] for r in known.select("k").distinct().collect())  # at most 31
    marks = np.zeros(1 << MARK_BITS, bool)  # the distinct marks are at most as many
    marks[[r[0] for r in known.select(F.shiftrightunsigned("h", 64 - MARK_BITS)).distinct().collect()]] = True
    shared = docs.sparkSession.sparkContext.broadcast((classes, marks))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes, marks = shared.value
        for b in batches:
            out = []
            for doc, text in zip(b["id"], b["text"]):
                rolling = Rolling(text)
                for k in classes:
                    _, window, width = size_class(1 << k)
                    hashes = rolling.windows(window, k)
                    places = minimizers(hashes, width)
                    places = places[marks[(hashes[places] >> np.uint64(64 - MARK_BITS)).astype(np.int64)]]
                    for at, h in zip(places.tolist(), hashes[places].view(np.int64).tolist()):
                        begin = max(0, at - width + 1)
                        out.append((doc, k, h, at, at - begin, text[begin : at + (2 << k)]))
            if out:
                yield pd.DataFrame(out, columns=["id", "k", "h", "at", "lead", "beside"]).astype({"k": "int32", "lead": "int32"})

    windows = docs.select("id", "text").filter("text <> '' AND id IS NOT NULL").mapInPandas(run, FOUND)
    if known.count() <= most_broadcast:
        known = F.broadcast(known)
    first = F.col("lead") - F.col("anchor")
    met = windows.join(known, ["k", "h"]).filter(first >= 0)
    same = F.substring("beside", first + 1, F.col("size")) == F.col("entry_text")
    return met.filter(same).select("id", "entry", (F.col("at") - F.col("anchor")).alias("at"))


def held(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, entry, times): how often each entry stands in each text that has it."""
    return occurrences(docs, dictionary).groupBy("id", "entry").agg(F.count("*").alias("times"))
