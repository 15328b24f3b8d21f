"""Invertible Bloom lookup sketches of documents.

A text is cut into paragraphs: lines, cut again after sentence ends and every ``MAX_WORDS`` words. The
digest of each paragraph (and of its how-manieth repeat) goes into one cell of each of three tables; a
cell keeps the count, the XOR of the digests and the XOR of their checks. Two sketches of one size
subtract cell by cell: what both texts have cancels, and peeling cells that hold one digest recovers
which digests differ and on which side. If peeling gets stuck, both sketches are made again at twice
the size. Likeness is the share of paragraphs in common among all paragraphs of both.

A document's next one in doc_id order is the next row of a sorted range of doc_id. The last document of
each range waits beside the results, as does the first: these two texts a range are joined afterwards.
So texts are shuffled once, no task needs more than its range, and that only as a stream.

Defined cases: a null text is an empty one; an empty text has an empty sketch, and two empty texts have
likeness 1. The document with the largest doc_id is followed by that with the smallest; a single
document is followed by itself. Rows with one doc_id follow each other in order of their texts; those
with a null doc_id come first. A very long text is sketched whole, in one task. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from operator import sub, xor

import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantlake.llm.common import cut_lineage

MAX_WORDS = 12
BASE_CELLS = 24
RANGE_ROWS = 4096
MAX_RANGES = 100_000
PARAGRAPH_END = re.compile(r"\n|(?<=[.!?])\s+")
OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def paragraphs(text: str) -> list[str]:
    found = []
    for line in PARAGRAPH_END.split(text):
        words = line.split()
        found += [" ".join(words[at : at + MAX_WORDS]) for at in range(0, len(words), MAX_WORDS)]
    return found


def digests(text: str) -> set[int]:
    """64-bit digests of the paragraphs; the repeats of one paragraph count as different."""
    return {xxhash.xxh64_intdigest(p, seed=k) for p, n in Counter(paragraphs(text)).items() for k in range(n)}


def check(digest: int) -> int:
    """A second hash, by which a cell with one digest is told from a cell with several."""
    return (digest * 0x9E3779B97F4A7C15 + 0x7F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 29


class Sketch:
    """Cells in three tables of equal size: how many digests lie in a cell, and the XOR of digests with checks."""

    def __init__(self, cells: int, of: set[int] = frozenset()) -> None:
        self.size = n = cells // 3
        self.counts, self.sums = [0] * (3 * n), [0] * (3 * n)
        counts, sums = self.counts, self.sums
        for d in of:
            both = check(d) << 64 | d
            for at in (d % n, n + (d >> 21) % n, 2 * n + (d >> 42) % n):
                counts[at] += 1
                sums[at] ^= both

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch(0)
        out.size = self.size
        out.counts = list(map(sub, self.counts, other.counts))
        out.sums = list(map(xor, self.sums, other.sums))
        return out

    def peel(self) -> tuple[set[int], set[int]] | None:
        """Digests on the left side alone and on the right side alone; None if some can't be recovered."""
        n, counts, sums = self.size, self.counts, self.sums
        left, right = set(), set()
        todo = [at for at, c in enumerate(counts) if c in (1, -1)]
        while todo:
            at = todo.pop()
            sign, both = counts[at], sums[at]
            d = both & 0xFFFFFFFFFFFFFFFF
            places = (d % n, n + (d >> 21) % n, 2 * n + (d >> 42) % n)
            if sign not in (1, -1) or both >> 64 != check(d) or at not in places:
                continue
            (left if sign == 1 else right).add(d)
            for p in places:
                counts[p] -= sign
                sums[p] ^= both
                if counts[p] in (1, -1):
                    todo.append(p)
        return None if any(counts) or any(sums) else (left, right)


class Sketches:
    """One text's sketches at the sizes asked for, each made once."""

    def __init__(self, text: str) -> None:
        self.digests, self.made = digests(text), {}

    def at(self, cells: int) -> Sketch:
        if cells not in self.made:
            self.made[cells] = Sketch(cells, self.digests)
        return self.made[cells]

    def fingerprint(self) -> str:
        """Digest of the smallest sketch: equal for equal texts."""
        small = self.at(BASE_CELLS)
        cells = repr((len(self.digests), small.counts, small.sums)).encode()
        return hashlib.blake2b(cells, digest_size=16).hexdigest()

    def difference(self, other: Sketches) -> tuple[set[int], set[int]]:
        """Paragraph digests of this text alone and of the other alone, recovered from sketches.

        The first size suits a difference of half the paragraphs; each failure doubles it.
        """
        cells = BASE_CELLS
        while cells < 0.7 * (len(self.digests) + len(other.digests)):
            cells *= 2
        while (found := self.at(cells).minus(other.at(cells)).peel()) is None:
            cells *= 2
        return found

    def likeness(self, other: Sketches) -> float:
        both = len(self.digests) + len(other.digests)
        apart = sum(map(len, self.difference(other)))
        return (both - apart) / (both + apart) if both else 1.0


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FOUND = f"{OUT}, part int, edge string, text string"
NAMES = [c.split()[0] for c in OUT.split(", ")]


def compared(doc_id: int | None, text: str, own: Sketches, following: str, its: Sketches) -> tuple:
    """A result row: a text against its edited text and against the following one."""
    changed = edited(text, following)
    other = Sketches(changed)
    return (
        doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
        own.fingerprint(), other.fingerprint(), own.likeness(other), own.likeness(its),
    )


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows of a range: each document meets the one after it; the first and the last are passed on."""
    part, before = TaskContext.get().partitionId(), None

    def edge(kind: str, row: tuple) -> tuple:
        return (row[0], *[None] * 6, part, kind, row[1])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*NAMES, "part", "edge", "text"]).astype({"doc_id": "Int64", "n_chars": "Int64", "part": "Int32"})

    for b in batches:
        rows = []
        for doc_id, text in zip(b["doc_id"], b["text"]):
            here = (doc_id, text, Sketches(text))
            rows.append(edge("first", here) if before is None else (*compared(*before, text, here[2]), None, None, None))
            before = here
        yield frame(rows)
    if before is not None:
        yield frame([edge("last", before)])


def _compare_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [compared(d, t, Sketches(t), f, Sketches(f)) for d, t, f in zip(b["doc_id"], b["text"], b["following"])]
        yield pd.DataFrame(rows, columns=NAMES).astype({"doc_id": "Int64"})


def versions(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike sketches find them. One text shuffle.

    Rows without a doc_id are spread over ranges by how their texts begin, which agrees with their order.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = min(MAX_RANGES, max(own.count() // range_rows + 1, docs.sparkSession.sparkContext.defaultParallelism))
    dealt = own.repartitionByRange(ranges, "doc_id", F.when(F.col("doc_id").isNull(), F.substring("text", 1, 32)))
    # Kept, as the limits of the ranges are drawn anew whenever they are dealt.
    found = cut_lineage(dealt.sortWithinPartitions("doc_id", "text").mapInPandas(_compare, FOUND))
    last = found.filter("edge = 'last'").select("part", "doc_id", "text")
    numbers, every = last.select("part"), Window.partitionBy()
    after = numbers.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(every)).alias("next"))
    first = found.filter("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    edges = last.join(after, "part").join(first, "next").select("doc_id", "text", "following")
    return found.filter("edge IS NULL").select(*NAMES).unionByName(edges.mapInPandas(_compare_edges, OUT))
