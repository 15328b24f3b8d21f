"""Best-fit packing of tokenized documents into fixed-length sequences by large-item matching.

Lengths are integers from 1 to the capacity, so the packing is decided on the histogram of lengths:
at most ``capacity`` rows reach the driver, whatever the corpus. Pieces above a third of the capacity
go at most two to a sequence, paired by greedy matching (the longest with the longest that still
fits); shorter pieces then fill the tightest gap that holds them, longest first. The plan says which
ranks of a length go to which sequences, and every piece finds its own place by its rank.

Defined cases: a null text is an empty one; an empty text is one token, the end id. A document longer
than the capacity is cut into full pieces behind a first, shorter one. Repeated rows are packed each.
A very long text is encoded whole before it is cut. Pieces of one length that tie go by doc_id, place
and checksum. Extra columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantlake.llm.common import cut_lineage, spread
from grantlake.llm.tokens import encoder, release

CAPACITY = 2048
END_ID = 0
CACHED = 400_000  # pieces a worker keeps while it encodes
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, cached: int = CACHED) -> DataFrame:
    """A row per piece of each document; the texts stay where they are read."""
    end = end_id.to_bytes(4, "little")

    def tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer, cached).encode
        for b in batches:
            rows = []
            for doc_id, text in zip(b.doc_id, b.text):
                ids = encode(text or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})
        release()

    return spread(docs.select("doc_id", "text")).mapInPandas(tokenize, PIECES)


class Plan:
    """Places for every rank of every length. Sequences that look alike are planned as one group.

    slots: (length, first rank, items in each sequence, first sequence, offset).
    """

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY) -> None:
        self.capacity, self.left, self.used = capacity, dict(histogram), dict.fromkeys(histogram, 0)
        self.sequences, self.slots = 0, []
        # gap -> groups of sequences that have that gap: [first sequence, how many]
        self.gaps: dict[int, list[list[int]]] = {}
        self.open: list[int] = []
        large = [n for n in sorted(histogram, reverse=True) if 3 * n > capacity]
        self._match(large)
        for n in sorted((n for n in histogram if 3 * n <= capacity), reverse=True):
            self._fill(n)

    def _place(self, n: int, sequence: int, count: int, each: int, offset: int) -> None:
        self.slots.append((n, self.used[n], each, sequence, offset))
        self.used[n] += count * each
        self.left[n] -= count * each

    def _gap(self, gap: int, sequence: int, count: int) -> None:
        if gap and count:
            if gap not in self.gaps:
                self.gaps[gap] = []
                insort(self.open, gap)
            self.gaps[gap].append([sequence, count])

    def _new(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def _match(self, large: list[int]) -> None:
        ascending = large[::-1]
        for a in large:
            while self.left[a]:
                at = bisect_left(ascending, min(a, self.capacity - a) + 1) - 1
                while at >= 0 and (not self.left[ascending[at]] or ascending[at] == a and self.left[a] < 2):
                    at -= 1
                if at < 0:
                    count, first = self.left[a], self._new(self.left[a])
                    self._place(a, first, count, 1, 0)
                    self._gap(self.capacity - a, first, count)
                    continue
                b = ascending[at]
                count = self.left[a] // 2 if a == b else min(self.left[a], self.left[b])
                first = self._new(count)
                self._place(a, first, count, 1, 0)
                self._place(b, first, count, 1, a)
                self._gap(self.capacity - a - b, first, count)

    def _fill(self, n: int) -> None:
        while self.left[n]:
            at = bisect_left(self.open, n)
            if at == len(self.open):
                each = self.capacity // n
                first = self._new(-(-self.left[n] // each))
                count, rest = divmod(self.left[n], each)
                if count:
                    self._place(n, first, count, each, 0)
                    self._gap(self.capacity - each * n, first, count)
                if rest:
                    self._place(n, first + count, 1, rest, 0)
                    self._gap(self.capacity - rest * n, first + count, 1)
                continue
            gap = self.open[at]
            group = self.gaps[gap][-1]
            each = min(gap // n, self.left[n])
            count = min(group[1], self.left[n] // each)
            self._place(n, group[0], count, each, self.capacity - gap)
            self._gap(gap - each * n, group[0], count)
            group[0] += count
            group[1] -= count
            if not group[1]:
                self.gaps[gap].remove(group)
            if not self.gaps[gap]:
                del self.gaps[gap]
                self.open.remove(gap)


def ranked(kept: DataFrame) -> DataFrame:
    """``rank`` of each piece within its length, over all rows, without one task for a common length.

    Pieces are numbered within (partition, length); each partition starts where those before it end.
    The partitions must not change between the two readings, so ``kept`` is a checkpoint.
    """
    at = kept.withColumn("_p", F.spark_partition_id())
    own = Window.partitionBy("_p", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = at.groupBy("_p", "length").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = at.withColumn("_own", F.row_number().over(own) - 1)
    return numbered.join(starts, ["_p", "length"]).withColumn("rank", F.col("_first") + F.col("_own")).drop("_p", "_own", "_first")


def pack(kept: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset. ``kept``: checkpointed pieces with lengths up to the capacity."""
    histogram = {r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = np.array(sorted(Plan(histogram, capacity).slots), dtype=np.int64).reshape(-1, 5)
    keys = (slots[:, 0] << 45) + slots[:, 1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length, rank = b.length.to_numpy(np.int64), b["rank"].to_numpy(np.int64)
            of = slots[np.searchsorted(keys, (length << 45) + rank, side="right") - 1]
            turn, row = np.divmod(rank - of[:, 1], of[:, 2])
            yield b.drop(columns="rank").assign(sequence_id=of[:, 3] + turn, offset=of[:, 4] + row * length)

    return ranked(kept).select(*PIECE_NAMES, "rank").mapInPandas(place, f"{PIECES}, sequence_id long, offset long")


PIECE_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, cached: int = CACHED) -> DataFrame:
    """``cached``: pieces a worker keeps while it encodes; memory against time, the result is the same."""
    return pack(cut_lineage(pieces(docs, tokenizer, capacity, end_id, cached)), capacity)
