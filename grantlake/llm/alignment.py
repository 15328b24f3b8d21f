"""Alignment of two tokenizers over the same bytes, and how often their tokens end together.

A text is encoded by a byte-level tokenizer A (with a blank in front) and by a SentencePiece model B (which
adds that blank). A label string has one character a byte: none, A-end, B-end or both. A regular
expression scans it for spans up to each both-label; the labels in a span tell how many tokens of A
and of B make up the group. The last tokens of a group end together: they are a link.

Neither tokenizer merges across a blank or a line feed that follows a visible character (for B that is
read from its vocabulary; a model that could is given whole texts), so both end there, and the groups of
a text are the groups of its pieces in a row. Pieces repeat far more often than texts: each task keeps the
aligned pieces seen lately and aligns the new ones of some texts at a time.

Counts of id pairs are sums over all documents. A document's different pairs with their numbers are
written once to the shared folder and read twice: to be counted, and to look the counts up. The counts
are broadcast up to ``MOST_BROADCAST`` pairs and joined by Spark's choice beyond; a pair that all documents
have is at most one row a document there, which AQE splits.

Defined cases: a null or empty text, or one whose tokens don't give back its bytes (U+2581 in it), has no
tokens: zeros and an empty digest. Repeated rows are rows of their own and count each. A very long text
is aligned whole, in one task. A null doc_id stays null. Extra columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlake.llm.common import cut_lineage, shared_folder, spread
from grantlake.llm.tokens import AFTER_SPACE, CUT, library, token_bytes

# Labels of a byte.
NONE, A_END, B_END = 0, 1, 2
BOTH = A_END | B_END
SPAN = re.compile(rb"[\x00-\x02]*\x03")
BLANK = "▁"
CACHED_PIECES = 250_000
BATCH_CHARS = 1 << 20
MOST_BROADCAST = 1_000_000  # pairs of 17 bytes
#: Pieces whose number of tokens of A is in the upper half of a long, that of B in the lower.
HALF = 32
FOUND = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"


def label_string(n: int, a_lengths: Iterable[int], b_lengths: Iterable[int]) -> bytes:
    """A label a byte of a text of ``n`` bytes, from the lengths of the tokens in order."""
    labels, at = bytearray(n), 0
    for length in a_lengths:
        at += length
        labels[at - 1] |= A_END
    at = 0
    for length in b_lengths:
        at += length
        labels[at - 1] |= B_END
    return bytes(labels)


def spans(labels: bytes) -> Iterator[tuple[int, int]]:
    """How many tokens of A and of B end in each span up to a both-label."""
    for m in SPAN.finditer(labels):
        span = m.group()
        yield span.count(A_END) + 1, span.count(B_END) + 1


def align(a_ids: list[int], a_tokens: list[bytes], b_ids: list[int], b_tokens: list[bytes]) -> list[tuple[list[int], list[int]]] | None:
    """The groups of ids (A's, B's) of one text; None where the tokens don't give the same bytes."""
    whole = b"".join(a_tokens)
    if whole != b"".join(b_tokens):
        return None
    found, i, j = [], 0, 0
    for n, m in spans(label_string(len(whole), map(len, a_tokens), map(len, b_tokens))):
        found.append((a_ids[i : i + n], b_ids[j : j + m]))
        i, j = i + n, j + m
    return found


class Aligner:
    """Aligned pieces of two vocabularies, those seen lately kept."""

    def __init__(self, a_path: str, b_path: str, most: int = CACHED_PIECES) -> None:
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = library(a_path, plain=True), SentencePieceProcessor(model_file=b_path)
        self.a_bytes = token_bytes(self.a)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.wide = len(pieces)  # a pair of ids is a * wide + b
        self.blank = self.b.piece_to_id(BLANK)
        self.cuts = not any(re.search(f"[^{BLANK}]{BLANK}|\n", p) for p in pieces)
        self.most, self.known, self.older = most, {}, {}

    def record(self, a_ids: list[int], b_ids: list[int], text: bytes) -> tuple[str, bytes, int] | None:
        """(groups as text, codes of the links, numbers of tokens); None where the tokens don't give the text."""
        a_tokens = [self.a_bytes[i] for i in a_ids]
        if b"".join(a_tokens) != text or (groups := align(a_ids, a_tokens, b_ids, [self.b_bytes[i] for i in b_ids])) is None:
            return None
        told = ";".join([f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups])
        links = np.array([a[-1] * self.wide + b[-1] for a, b in groups], "<i8").tobytes()
        return told, links, len(a_ids) << HALF | len(b_ids)

    def whole(self, text: str) -> tuple[str, bytes, int] | None:
        """The record of a text, by both libraries as it is."""
        return self.record(self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text), f" {text}".encode())

    def pieces(self, text: str) -> list[str]:
        """What stands between the cuts of a blank and the text: each with the blank or line feed before it."""
        text = f" {text}"
        if AFTER_SPACE.search(text):
            return CUT.split(text)
        return [p if p[:1] == "\n" else f" {p}" for p in text.replace("\n", " \n").split(" ")[1:]]

    def learn(self, pieces: set[str]) -> None:
        """Afterwards ``known`` has all of these pieces."""
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        new = []
        for p in pieces - self.known.keys():
            if p in self.older:
                self.known[p] = self.older[p]
            else:
                new.append(p)
        a = self.a.encode_batch(new, add_special_tokens=False)
        b = self.b.encode([p[1:] if p[0] == " " else p for p in new], num_threads=1)
        for p, x, y in zip(new, a, b):
            # A line feed merges with nothing, so the blank that B has put before it is a token of its own.
            if p[0] != " ":
                y = y[1:] if y[:1] == [self.blank] else [0]
            self.known[p] = self.record(x.ids, y, p.encode())

    def texts(self, batch: list[str | None]) -> Iterator[tuple[list[str], list[bytes], int] | None]:
        """For each text of a batch its groups, links and numbers of tokens; None where it has no tokens."""
        if not self.cuts:
            for text in batch:
                one = self.whole(text) if text else None
                yield one and ([one[0]], [one[1]], one[2])
            return
        cut = [self.pieces(text) if text else [] for text in batch]
        self.learn(set().union(*cut))
        for text, pieces in zip(batch, cut):
            found = list(map(self.known.__getitem__, pieces))
            if None in found:
                one = self.whole(text)
                found = [one] if one else []
            told, links, sizes = zip(*found) if found else ((), (), ())
            yield (told, links, sum(sizes)) if found else None


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """One a worker process."""
    gc.set_threshold(200_000, 20, 50)
    return Aligner(a_path, b_path)


def batches_of(texts: Iterable[str | None], chars: int = BATCH_CHARS) -> Iterator[list[str | None]]:
    """Some texts at a time: up to ``chars`` characters, or one longer text."""
    batch, n = [], 0
    for text in texts:
        if batch and n + len(text or "") > chars:
            yield batch
            batch, n = [], 0
        batch.append(text)
        n += len(text or "")
    if batch:
        yield batch


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row per document: the numbers of its tokens and groups, a digest of its groups, its different links with their numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, row = aligner(a_path, b_path), TaskContext.get().partitionId() << 40
        for b in batches:
            out = []
            for texts in batches_of(b.text):
                for found in own.texts(texts):
                    told, links, sizes = found or ((), (), 0)
                    links = np.frombuffer(b"".join(links), "<i8")
                    pairs, times = np.unique(links, return_counts=True)
                    digest = hashlib.sha256(";".join(told).encode()).hexdigest() if found else ""
                    out.append((row + len(out), sizes >> HALF, sizes & (1 << HALF) - 1, len(links), digest, pairs, times.astype(np.int32)))
            row += len(out)
            frame = pd.DataFrame(out, columns=["row", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])
            yield frame.assign(doc_id=b.doc_id.to_numpy())[[c.split()[0] for c in FOUND.split(", ")]]

    return spread(docs.select("doc_id", "text")).mapInPandas(run, FOUND)


def link_counts(links: DataFrame, wide: int) -> DataFrame:
    """(pair, count, best) of the links (pair, times): ``best`` if no other pair with the B id has a larger count."""
    counts = cut_lineage(links.groupBy("pair").agg(F.sum("times").alias("count")))
    b = F.pmod("pair", F.lit(wide))
    highest = counts.groupBy(b.alias("b")).agg(F.max("count").alias("highest"))
    return counts.withColumn("b", b).join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def align_documents(docs: DataFrame, a_path: str, b_path: str, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """A row per document: numbers of tokens, groups and links, how common its links are in the corpus, a digest of its groups."""
    from sentencepiece import SentencePieceProcessor

    path, wide = shared_folder(docs.sparkSession), SentencePieceProcessor(model_file=b_path).vocab_size()
    aligned(docs, a_path, b_path).write.parquet(path)
    found = docs.sparkSession.read.parquet(path)
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    counts = cut_lineage(link_counts(links, wide))
    if counts.count() <= most_broadcast:
        counts = F.broadcast(counts)
    sums = links.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("count")).alias("_sum")
    )
    none = F.lit(0).cast("long")
    return found.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("_best", none).alias("n_best"), F.coalesce("_sum", none).alias("count_sum"), "groups_sha256"
    )
