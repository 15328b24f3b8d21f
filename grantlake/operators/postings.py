"""Inverted indexes of the SQL word arm: postings of title trigrams, and compressed bitmaps of words and categories.

Both cut ids into ranges, so a gram or word that a third of all rows have is many blocks. A block
holds its ids in a few bytes each: postings as the gaps between sorted ids in 7-bit groups, bitmaps as the shortest of
a list, the runs, or a bit a row. Blocks are sorted by gram or word, so that a search reads the row
groups of its own ones.

A title search counts how many of a query's grams each id has by merging the query's blocks range by range;
as a block also holds the number of grams of each title, the count decides the similarity and no title is
read. Equal titles can be one class (``title_blocks``): then different titles alone are indexed and merged, and
what they find is expanded to all ids at the end. A word search joins blocks by or and and before any row is read.

Defined cases: ids are keys; of rows that repeat an id the least title counts, while their words are put
together. Null ids are in no index. A null or empty title or query has no grams and matches nothing; a query without
words matches nothing, one without categories all of them; a null or empty category passes every list. Very
long titles have at most as many grams as characters. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlake.functions.text import trigrams
from grantlake.sources.shared import cut_lineage

GRAM_RANGE_BITS, BIT_RANGE_BITS = 14, 16
GATHERED = 1 << 21
LIMIT = 0.2


# ---- bytes of a block ----


def numbers_in_groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of non-negative integers in 7-bit groups, where each ends): the lowest group first; the high bit says that another follows."""
    x = np.asarray(x, np.uint64)
    sizes = np.ones(len(x), np.int64)
    for k in range(1, -(-int(x.max(initial=0)).bit_length() // 7)):
        sizes += x >= np.uint64(1) << np.uint64(7 * k)
    ends = np.cumsum(sizes)
    out, start = np.zeros(int(ends[-1]) if len(x) else 0, np.uint8), ends - sizes
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        part = (x[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[start[has] + k] = part | np.where(sizes[has] > k + 1, 128, 0).astype(np.uint64)
    return out, ends


def pack_numbers(x: np.ndarray) -> bytes:
    return numbers_in_groups(x)[0].tobytes()


def unpack_numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], raw[:-1] < 128]))
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted different integers from 0 on as the gaps between them."""
    return pack_numbers(np.diff(x, prepend=0))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(data))


def pack_bits(places: np.ndarray, size: int = 1 << BIT_RANGE_BITS) -> bytes:
    """Sorted different places of a range in the shortest form: a list, the runs or all bits; the first byte tells which."""
    places = np.asarray(places, np.int64)
    begins = np.flatnonzero(np.diff(places, prepend=-2) != 1)
    lengths = np.diff(np.append(begins, len(places)))
    forms = [
        (b"l", places.astype("<u2").tobytes),
        (b"r", np.stack([places[begins], lengths - 1], axis=1).astype("<u2").tobytes),
        (b"b", lambda: np.packbits(np.bincount(places, minlength=size).astype(bool), bitorder="little").tobytes()),
    ]
    lengths_of = (2 * len(places), 4 * len(begins), size // 8)
    kind, data = forms[int(np.argmin(lengths_of))]
    return kind + data()


def pack_lists(lists: list[np.ndarray]) -> tuple[list[int], list[bytes]]:
    """(how many different places, pack_bits of them in order) for many lists of places in any order, most of them short: packed in one go where a list is shortest."""
    owner = np.repeat(np.arange(len(lists)), np.fromiter(map(len, lists), np.int64, len(lists)))
    places = np.unique(owner << BIT_RANGE_BITS | np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64))
    owner, low = places >> BIT_RANGE_BITS, places & ((1 << BIT_RANGE_BITS) - 1)
    n = np.bincount(owner, minlength=len(lists))
    runs = np.bincount(owner[(np.diff(places, prepend=-2) != 1) | (np.diff(owner, prepend=-1) != 0)], minlength=len(lists))
    listed = (2 * n <= 4 * runs) & (2 * n <= (1 << BIT_RANGE_BITS) // 8)
    ends, data = np.cumsum(n), low.astype("<u2").tobytes()
    bounds = zip((ends - n).tolist(), ends.tolist(), listed.tolist())
    return n.tolist(), [b"l" + data[2 * s : 2 * e] if short else pack_bits(low[s:e]) for s, e, short in bounds]


def unpack_bits(block: bytes, size: int = 1 << BIT_RANGE_BITS) -> np.ndarray:
    """A boolean for each place of a range."""
    kind, data = block[:1], block[1:]
    if kind == b"b":
        return np.unpackbits(np.frombuffer(data, np.uint8), count=size, bitorder="little").astype(bool)
    out = np.zeros(size, bool)
    if kind == b"l":
        out[np.frombuffer(data, "<u2")] = True
        return out
    runs = np.frombuffer(data, "<u2").reshape(-1, 2).astype(np.int64)
    steps = np.zeros(size + 1, np.int8)
    np.add.at(steps, runs[:, 0], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1] + 1, -1)
    return np.cumsum(steps[:-1]).astype(bool)


# ---- titles ----


def gram_index(rows: DataFrame) -> DataFrame:
    """(gram, range, n, ids, sizes) of titles (id, title): a block per gram and range of ids. A range's ids of one gram are at most 2^14."""
    titles = rows.filter("id IS NOT NULL").groupBy("id").agg(F.min("title").alias("title"))
    own = titles.select("id", trigrams(F.coalesce("title", F.lit(""))).alias("g"))
    low = F.col("id").bitwiseAND((1 << GRAM_RANGE_BITS) - 1).cast("int")
    each = own.select(F.explode("g").alias("gram"), F.shiftright("id", GRAM_RANGE_BITS).alias("range"), low.alias("low"), F.size("g").alias("size"))
    blocks = each.groupBy("gram", "range").agg(F.sort_array(F.collect_list(F.struct("low", "size"))).alias("p"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = b["low"].map(len)
            ids, sizes = [pack_sorted(np.asarray(x)) for x in b["low"]], [pack_numbers(np.asarray(x)) for x in b["size"]]
            yield pd.DataFrame({"gram": b["gram"], "range": b["range"], "n": n.astype("int32"), "ids": ids, "sizes": sizes})

    packed = blocks.select("gram", "range", F.col("p.low").alias("low"), F.col("p.size").alias("size")).mapInPandas(run, "gram string, range long, n int, ids binary, sizes binary")
    # Kept, as the limits of the ranges are drawn from it before it is dealt.
    return cut_lineage(packed).repartitionByRange("gram", "range").sortWithinPartitions("gram", "range")


def _asked(queries: DataFrame) -> DataFrame:
    """(query, asked, gram) of queries (query, title)."""
    own = queries.select("query", trigrams(F.coalesce("title", F.lit(""))).alias("g"))
    return own.select("query", F.size("g").alias("asked"), F.explode("g").alias("gram"))


def candidates(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, touched): how many postings a search merges for each query that has any."""
    return _asked(queries).join(index, "gram").groupBy("query").agg(F.sum("n").alias("touched"))


def similar_titles(index: DataFrame, queries: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(query, id, similarity) of all ids whose title's trigram similarity with a query (query, title) is above ``limit``."""
    if limit < 0:
        raise ValueError("titles that share no gram aren't looked at")

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        low = np.concatenate([unpack_sorted(x) for x in group["ids"]])
        sizes = np.concatenate([unpack_numbers(x) for x in group["sizes"]])
        shared = np.bincount(low)
        size = np.zeros(len(shared), np.int64)
        size[low] = sizes
        asked = int(group["asked"].iloc[0])
        # Fewer than this can't do, whatever the title's size.
        found = np.flatnonzero(shared > limit * asked - 1e-9) if limit else np.flatnonzero(shared)
        like = shared[found] / (asked + size[found] - shared[found])
        found, like = found[like > limit], like[like > limit]
        ids = (int(group["range"].iloc[0]) << GRAM_RANGE_BITS) + found
        return pd.DataFrame({"query": np.full(len(ids), group["query"].iloc[0]), "id": ids, "similarity": like})

    met = _asked(queries).join(index, "gram").select("query", "asked", "range", "ids", "sizes")
    return met.groupBy("query", "range").applyInPandas(merge, "query long, id long, similarity double")


COPY_RANGE_BITS, QUERY_RANGE_BITS = 16, 20


def title_blocks(rows: DataFrame, bits: int = COPY_RANGE_BITS) -> DataFrame:
    """(rep, title, ids) of titles (id, title): the ids of equal titles in blocks, one a range of ids; ``rep`` is the least id that has the title."""
    titles = rows.filter("id IS NOT NULL").groupBy("id").agg(F.coalesce(F.min("title"), F.lit("")).alias("title"))
    blocks = titles.groupBy("title", F.shiftright("id", bits).alias("range")).agg(F.collect_list("id").alias("ids"))
    reps = blocks.groupBy("title").agg(F.min(F.array_min("ids")).alias("rep"))
    return blocks.join(reps, "title").select("rep", "title", "ids")


def classes(blocks: DataFrame) -> DataFrame:
    """(id, title) of the different titles of blocks."""
    return blocks.groupBy(F.col("rep").alias("id")).agg(F.first("title").alias("title"))


ROW_QUERIES, ROW_IDS = 128, 512


def _pieces(ids: str, most: int) -> Column:
    """An array cut into arrays of at most ``most`` values, a row each."""
    starts = F.sequence(F.lit(0), F.floor((F.size(ids) - 1) / most).cast("int"))
    return F.explode(F.transform(starts, lambda k: F.slice(ids, k * most + 1, most)))


def met_blocks(found: DataFrame, blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """(queries, ids, similarity): all ids and queries whose titles met, at most ROW_QUERIES by ROW_IDS of them a row, dealt evenly.

    Spark holds all rows that it makes from one, so this bounds a task's memory however many copies a title has.
    """
    own = blocks.select(F.col("rep").alias("id"), _pieces("ids", ROW_IDS).alias("ids"))
    asking = asked.select(F.col("rep").alias("query"), _pieces("ids", ROW_QUERIES).alias("queries"))
    met = found.join(own, "id").join(asking, "query")
    # A given number of parts, as parts of few bytes hold many pairs.
    return met.repartition(4 * max(8, met.sparkSession.sparkContext.defaultParallelism), F.xxhash64("id", "query", F.get("ids", F.lit(0)), F.get("queries", F.lit(0)))).select("queries", "ids", "similarity")


def with_copies(found: DataFrame, blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, id, similarity) of all ids and queries whose titles met. Blocks are shuffled and expanded where they are read: no pair of rows is.

    What is computed from a similarity belongs into ``found``: here it would be computed for every pair of copies.
    """
    met = met_blocks(found, blocks, asked)
    return met.select(F.explode("queries").alias("query"), "ids", "similarity").select("query", F.explode("ids").alias("id"), "similarity")


# ---- words and categories ----


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(field, value, range, low) of rows (id, keywords, category): the places of a word or category, put together for some millions of them at once."""

    def blocks(field: str, held: list[tuple[pa.Array, np.ndarray]]) -> pa.RecordBatch:
        coded = pa.concat_arrays([values for values, _ in held]).dictionary_encode()
        code, ids = coded.indices.to_numpy(zero_copy_only=False), np.concatenate([ids for _, ids in held])
        order = np.lexsort((ids, code))
        code, ids = code[order], ids[order]
        ranges = ids >> BIT_RANGE_BITS
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(code) != 0) | (np.diff(ranges) != 0)]))
        ends = pa.py_buffer((2 * np.append(starts, len(ids))).astype(np.int32))
        low = pa.Array.from_buffers(pa.binary(), len(starts), [None, ends, pa.py_buffer((ids & ((1 << BIT_RANGE_BITS) - 1)).astype("<u2"))])
        columns = [pa.array([field]).take(pa.array(np.zeros(len(starts), np.int32))), coded.dictionary.take(pa.array(code[starts])), pa.array(ranges[starts]), low]
        return pa.RecordBatch.from_arrays(columns, ["field", "value", "range", "low"])

    words, categories, many = [], [], 0
    for b in batches:
        ids = b.column("id").to_numpy()
        lists = b.column("keywords")
        values = pc.list_flatten(lists)
        own = ids[pc.list_parent_indices(lists).to_numpy()]
        known = values.is_valid()
        words.append((values.filter(known), own[known.to_numpy(zero_copy_only=False)]))
        categories.append((b.column("category"), ids))
        many += len(own) + len(ids)
        if many >= GATHERED:
            yield from (blocks(f, held) for f, held in (("word", words), ("category", categories)) if sum(len(v) for v, _ in held))
            words, categories, many = [], [], 0
    yield from (blocks(f, held) for f, held in (("word", words), ("category", categories)) if sum(len(v) for v, _ in held))


def bitmap_index(rows: DataFrame) -> DataFrame:
    """(field, value, range, n, bits) of rows (id, keywords, category). A null category is stored as an empty value."""
    given = rows.filter("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), "keywords", F.coalesce("category", F.lit("")).alias("category"))
    parts = given.mapInArrow(gathered, "field string, value string, range long, low binary")
    blocks = parts.groupBy("field", "value", "range").agg(F.collect_list("low").alias("low"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, bits = pack_lists([np.frombuffer(b"".join(x), "<u2") for x in b["low"]])
            yield b[["field", "value", "range"]].assign(n=np.asarray(n, np.int32), bits=bits)

    packed = blocks.mapInPandas(run, "field string, value string, range long, n int, bits binary")
    return cut_lineage(packed).repartitionByRange("field", "value", "range").sortWithinPartitions("field", "value", "range")


def matching_rows(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id) of the rows that have any of a query's words and any of its categories, or no category. ``queries``: (query, words, categories)."""
    limits = F.coalesce(F.size("categories"), F.lit(0)) > 0
    allowed = F.when(limits, F.array_distinct(F.concat("categories", F.array(F.lit(""))))).otherwise(F.array().cast("array<string>"))
    asked = queries.select("query", limits.alias("limited"), F.lit("word").alias("field"), F.explode(F.array_distinct("words")).alias("value"))
    asked = asked.unionByName(queries.select("query", limits.alias("limited"), F.lit("category").alias("field"), F.explode(allowed).alias("value")))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        either = {"word": np.zeros(1 << BIT_RANGE_BITS, bool), "category": np.zeros(1 << BIT_RANGE_BITS, bool)}
        for field, bits in zip(group["field"], group["bits"]):
            either[field] |= unpack_bits(bits)
        found = either["word"] & either["category"] if group["limited"].iloc[0] else either["word"]
        ids = (int(group["range"].iloc[0]) << BIT_RANGE_BITS) + np.flatnonzero(found)
        return pd.DataFrame({"query": np.full(len(ids), group["query"].iloc[0]), "id": ids})

    met = asked.join(index, ["field", "value"]).select("query", "limited", "range", "field", "bits")
    return met.groupBy("query", "range").applyInPandas(merge, "query long, id long")
