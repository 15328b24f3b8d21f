"""Token ids in files of fixed-width bit-packed blocks.

Each id takes as many bits as the largest id of the vocabulary needs. A block holds the ids of whole
documents behind a short head; the offsets of its documents stand beside it, so that a reader unpacks
a block, or any document in it, with a few numpy operations and without reading what comes before.
Blocks are binary values in a Parquet table: Spark's commit keeps the files whole when executors are
lost, and any store that Spark reaches can hold them. Rows are written in ascending doc_id order;
``part`` and ``seq`` number the blocks in that order, ``before`` is the number of ids in the part's
earlier blocks: a reader adds the totals of the parts before and never has to move a block.

Defined cases: a null text is an empty one and gives the end id alone; documents with a null doc_id
come first; rows with the same doc_id stand together, ordered by text, in one task. A very long text is
encoded whole and never cut: its block grows with it, up to the 2 GB that a binary value may have
(about a billion ids of 16 bits). Extra columns are ignored. An empty table gives an empty table of
blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grantlake.llm.tokens import encoder

HEAD = struct.Struct("<4sHHQ")  # mark, version, bits of an id, number of ids
MARK = b"FWID"
BLOCK_IDS = 1 << 18
MOST_PARTS = 1_000_000  # of 16 bytes each
BLOCKS = "part int, seq int, before long, n_ids long, doc_ids array<long>, ends array<long>, block binary"


def bits_for(vocabulary: int) -> int:
    """Bits of the largest id, at least one."""
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive little-endian fields of ``bits`` bits behind a head."""
    ids = ids.astype(np.uint32)
    if bits == 16:
        body = ids.astype("<u2").tobytes()
    else:
        body = np.packbits((ids[:, None] >> np.arange(bits, dtype=np.uint32) & 1).astype(np.uint8), bitorder="little").tobytes()
    return HEAD.pack(MARK, 1, bits, len(ids)) + body


def unpack_ids(block: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """ids[start:stop] of a block; only the bytes that hold them are unpacked."""
    mark, version, bits, n = HEAD.unpack_from(block)
    if mark != MARK or version != 1:
        raise ValueError("not a block of fixed-width ids")
    stop = n if stop is None else min(stop, n)
    if stop <= start:
        return np.zeros(0, dtype="<u4")
    if bits == 16:
        return np.frombuffer(block, "<u2", stop - start, HEAD.size + 2 * start).astype("<u4")
    first = start * bits // 8
    raw = np.frombuffer(block, np.uint8, (stop * bits + 7) // 8 - first, HEAD.size + first)
    own = np.unpackbits(raw, bitorder="little")[start * bits - 8 * first :][: (stop - start) * bits]
    return (own.reshape(-1, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


def blocks(docs: DataFrame, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Packed blocks in ascending doc_id order: one shuffle, by ranges of doc_id."""
    end = end_id.to_bytes(4, "little")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq = TaskContext.get().partitionId(), 0
        own = encoder(tokenizer)
        bits = bits_for(max(own.vocabulary, end_id + 1))
        doc_ids, ends, ids, n, before = [], [], [], 0, 0

        def block() -> pd.DataFrame:
            packed = pack_ids(np.frombuffer(b"".join(ids), "<u4"), bits)
            return pd.DataFrame({"part": [part], "seq": [seq], "before": [before], "n_ids": [n], "doc_ids": [doc_ids], "ends": [ends], "block": [packed]})

        for b in batches:
            for doc_id, text in zip(b.doc_id, b.text):
                ids.append(own.encode(text or "") + end)
                n += len(ids[-1]) // 4
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                ends.append(n)
                if n >= block_ids:
                    yield block()
                    doc_ids, ends, ids, n, seq, before = [], [], [], 0, seq + 1, before + n
        if ids:
            yield block()

    by_range = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id"))
    return by_range.sortWithinPartitions("doc_id", "text").mapInPandas(write, BLOCKS)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    blocks(docs, tokenizer, end_id, block_ids).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``first``: the number of ids in all blocks before them.

    Only the totals of the parts are summed, one row a write task; they are broadcast up to MOST_PARTS of
    them and joined by Spark's choice beyond, so that blocks stay where they are read.
    """
    found = spark.read.schema(BLOCKS).parquet(path)
    parts = found.groupBy("part").agg(F.max(F.col("before") + F.col("n_ids")).alias("_n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    if parts.count() <= MOST_PARTS:
        totals = F.broadcast(totals)
    return found.join(totals, "part").withColumn("first", F.col("_before") + F.col("before")).drop("_before")


def documents_of(read_blocks: DataFrame) -> DataFrame:
    """A row per document, unpacked from its block: start, n_tokens and a checksum of its ids."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first, doc_ids, ends, block in zip(b["first"], b.doc_ids, b.ends, b.block):
                raw, ends = unpack_ids(block).tobytes(), np.asarray(ends, np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                crcs = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts, ends)]
                yield pd.DataFrame({"doc_id": pd.array(list(doc_ids), "Int64"), "start": first + starts, "n_tokens": ends - starts, "ids_crc32": crcs})

    return read_blocks.select("first", "doc_ids", "ends", "block").mapInPandas(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long")
