"""Phrases of words that stand together more often than their parts would by chance.

Each shard (some million words of a task) becomes an array of word ids; a word of one language never has the
id of a word of another, and the ends of pieces have an id of their own. Prefix doubling with numpy
ranks the suffixes by their first 1, 2, then ``max_words`` words, as longer prefixes are never asked for.
Neighbours in the suffix array share a prefix of the length that their ranks tell (LCP); an interval of
neighbours that share n words is a phrase of n words, its length the phrase's count.

Counts are merged over all shards twice. First those of all phrases by a hash of ``HASH_BITS`` bits: a shard sorts
its hashes and writes the gaps between them, cut into ranges of hashes, which takes about three bytes a phrase
and a row a range. A count above the least that is asked for says no more than that one. The hashes that
reach it are marked in a bitmap of fixed size, which every task gets. Then those of phrases by (lang, phrase), of the marked phrases alone. A phrase that is frequent is
always marked; marks and hashes that meet only let more phrases through to the second count, which is
exact. All later steps work on the phrases that are frequent.

A candidate is cut after its first k words into a left part l and a right part r; its score is
floor(1000000 a² / (l r)), the lowest over k, in exact decimals. Each part is at least as frequent as
the candidate, so all parts are among the frequent phrases.

Defined cases: a null text or one without words has no phrases; a null lang is ``und``; repeated rows count
each; the lang and the text alone matter, so extra columns and null or repeated ids make no difference. A very
long text is cut into words in one task; its shard grows with it. An empty table gives an empty result.
Counts must stay below 10^16 for the decimals to hold a²; beyond that Spark raises.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantlake.llm.common import cut_lineage, spread
from grantlake.operators.postings import numbers_in_groups, unpack_numbers

MAX_WORDS = 3
LEAST_COUNT = 10
TOP = 2000
MOSTLY_INSIDE = 50  # per cent of a candidate's occurrences inside a longer one, from which it is dropped
SHARD_WORDS = 1 << 21
HASH_BITS = 40
RANGE_BITS, RANGE_SPLITS = 13, 4096
MARK_BITS = 28  # a bitmap of 32 MB
BATCH_ROWS = 100_000
UNKNOWN_LANG = "und"
# The characters that end a piece.
ENDS = b".,;:!?\n\x0b\x0c\r"
TO_WORDS = bytes.maketrans(ENDS + b"\t", b"\n" * len(ENDS) + b" ")
END, EMPTY = 0, 1  # ids of the end of a piece and of nothing between two blanks
FOUND = "lang string, phrase string, n long"


def word_ids(text: bytes, ids: defaultdict) -> np.ndarray:
    """The ids of a text's words, ``END`` between pieces and at the end."""
    tokens = (text.lower().translate(TO_WORDS).replace(b"\n", b" \n ") + b" \n").split(b" ")
    found = np.fromiter(map(ids.__getitem__, tokens), np.int32, len(tokens))
    return found[found != EMPTY]


def suffix_array(ids: np.ndarray, max_words: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The places of all suffixes in the order of their first ``max_words`` words, and (n, the suffixes' ranks by n words) for n = 1, 2, 4 and so on."""
    ranks, words, n = [(1, ids.astype(np.int32))], 1, len(ids)
    order = np.argsort(ids) if max_words == 1 else None
    while words < max_words:
        step = min(words, max_words - words)
        last = ranks[-1][1]
        keys = last.astype(np.int64) * (int(last.max(initial=0)) + 2)
        keys[: n - step] += last[step:] + 1
        order = np.argsort(keys)
        keys = keys[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(np.concatenate([[False], keys[1:] != keys[:-1]]), dtype=np.int32)
        words += step
        ranks.append((words, rank))
    return order, ranks


def common_words(suffixes: np.ndarray, ranks: list[tuple[int, np.ndarray]], max_words: int) -> np.ndarray:
    """LCP: how many words, ``max_words`` at most, each suffix has in common with the one before it in the array; 0 for the first.

    Two suffixes agree in n words if their ranks by the longest known prefix of at most n words are equal, at their first
    word and where that prefix ends with the nth.
    """
    n = len(suffixes)
    lcp = np.zeros(n, np.int8)
    for words in range(1, max_words + 1):
        size, rank = max(r for r in ranks if r[0] <= words)
        own = rank[suffixes]
        same = own[1:] == own[:-1]
        if size < words:
            later = np.minimum(suffixes + words - size, n - 1)
            own = np.where(suffixes + words - size < n, rank[later], -1 - suffixes)
            same &= own[1:] == own[:-1]
        lcp[1:] += same
    return lcp


def ngrams(ids: np.ndarray, max_words: int = MAX_WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, a place of each different n-gram that holds no ``END``, its count) for n up to ``max_words``."""
    size = len(ids)
    if not size:
        return
    suffixes, ranks = suffix_array(ids, max_words)
    lcp = common_words(suffixes, ranks, max_words)
    # Words from each place to the next end of a piece.
    places = np.arange(size, dtype=np.int32)
    upto = np.minimum.accumulate(np.where(ids == END, places, size)[::-1])[::-1] - places
    for n in range(1, max_words + 1):
        first = np.flatnonzero(lcp < n)
        counts = np.diff(np.append(first, size))
        at = suffixes[first]
        whole = upto[at] >= n
        yield n, at[whole], counts[whole]


class Shard:
    """The word ids of some texts, by language."""

    def __init__(self) -> None:
        self.parts, self.size, number = [], 0, count(EMPTY + 1)
        self.by_lang = defaultdict(lambda: defaultdict(number.__next__, {b"\n": END, b"": EMPTY}))

    def add(self, lang: str, text: bytes) -> None:
        self.parts.append(word_ids(text, self.by_lang[lang]))
        self.size += len(self.parts[-1])

    def close(self) -> None:
        """Ids of all texts in a row, words and numbers of langs by id, hashes of (lang, word) by id."""
        self.ids = np.concatenate(self.parts)
        self.words, hashes, langs = [b"", b""], [0, 0], [0, 0]
        for k, (lang, known) in enumerate(self.by_lang.items()):
            seed = xxhash.xxh64_intdigest(lang)
            own = [w for w, i in known.items() if i > EMPTY]
            of = sorted(zip(map(known.__getitem__, own), own))
            self.by_lang[lang] = of
            langs += [k] * len(of)
            hashes += [xxhash.xxh64_intdigest(w, seed) for _, w in of]
            self.words += [w for _, w in of]
        # Ids were given in the order of the words' first coming, whatever their lang.
        places = np.array([0, 1, *(i for of in self.by_lang.values() for i, _ in of)], np.int64)
        order = np.argsort(places)
        self.words = [self.words[k] for k in order.tolist()]
        self.langs, self.hashes = np.array(langs, np.int32)[order], np.array(hashes, np.uint64)[order]

    def hashed(self, places: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the phrases of n words at some places."""
        out = self.hashes[self.ids[places]]
        for k in range(1, n):
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + self.hashes[self.ids[places + k]]
        out = (out ^ (out >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return out >> np.uint64(64 - HASH_BITS)

    def hash_rows(self, max_words: int, least: int, range_bits: int) -> Iterator[pa.RecordBatch]:
        """(range, hashes) of every phrase: the hashes of a range as ``reaching`` reads them."""
        found = [(self.hashed(places, n), counts) for n, places, counts in ngrams(self.ids, max_words)]
        h, n = np.concatenate([f[0] for f in found]), np.concatenate([np.minimum(f[1], least).astype(np.uint32) for f in found])
        del found
        order = np.argsort(h)
        h, n = h[order], n[order]
        del order
        low = np.uint64(HASH_BITS - range_bits)
        of = (h >> low).astype(np.int64)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        gaps = np.diff(h, prepend=np.uint64(0))
        gaps[first] = h[first] & ((np.uint64(1) << low) - np.uint64(1))
        # A gap is odd if the count follows, which is even; most counts are 1 and aren't written.
        many = n > 1
        at = np.arange(len(gaps)) + np.cumsum(many) - many
        numbers = np.zeros(len(gaps) + int(many.sum()), np.uint64)
        numbers[at] = gaps << np.uint64(1) | many
        numbers[at[many] + 1] = n[many].astype(np.uint64) << np.uint64(1)
        del gaps
        data, ends = numbers_in_groups(numbers)
        starts = np.append(np.append(0, ends)[at[first]], len(data)).tolist()
        data = data.tobytes()
        for at in range(0, len(first), BATCH_ROWS):
            here = range(at, min(at + BATCH_ROWS, len(first)))
            yield pa.RecordBatch.from_arrays([pa.array(of[first[here.start : here.stop]]), pa.array([data[starts[k] : starts[k + 1]] for k in here], pa.binary())], ["range", "hashes"])

    def phrase_rows(self, max_words: int, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
        """(lang, phrase, n) of every marked phrase, and the number of words of each lang beside a null phrase."""
        words, names = pa.array(self.words, pa.binary()).cast(pa.string()), pa.array(list(self.by_lang), pa.string())
        total = np.bincount(self.langs[self.ids[self.ids > EMPTY]], minlength=len(names))
        yield pa.RecordBatch.from_arrays([names, pa.nulls(len(names), pa.string()), pa.array(total, pa.int64())], ["lang", "phrase", "n"])
        for n, places, counts in ngrams(self.ids, max_words):
            may = marked(marks, self.hashed(places, n))
            places, counts = places[may], counts[may]
            for at in range(0, len(places), BATCH_ROWS):
                here = places[at : at + BATCH_ROWS]
                parts = [words.take(pa.array(self.ids[here + k])) for k in range(n)]
                phrase = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
                lang = names.take(pa.array(self.langs[self.ids[here]]))
                yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(counts[at : at + BATCH_ROWS], pa.int64())], ["lang", "phrase", "n"])


def reaching(ranges: np.ndarray, blocks: list[bytes], least: int, range_bits: int) -> np.ndarray:
    """The hashes in the blocks of whole ranges whose counts add up to ``least``."""
    data, lengths = b"".join(blocks), np.array([len(b) for b in blocks])
    x = unpack_numbers(data).view(np.uint64)
    follows = np.concatenate([[False], (x[:-1] & np.uint64(1)).astype(bool)])
    n = np.ones(len(x), np.uint64)
    n[:-1][follows[1:]] = x[1:][follows[1:]] >> np.uint64(1)
    gaps, n = x[~follows] >> np.uint64(1), n[~follows]
    # How many gaps each block has: numbers end with a byte below 128.
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) < 128)
    of = np.searchsorted(np.cumsum(lengths), ends[~follows], side="right")
    sizes = np.bincount(of, minlength=len(blocks))
    # A running sum that begins anew in every block.
    total = np.cumsum(gaps, dtype=np.uint64)
    begins = np.cumsum(sizes) - sizes
    h = total - np.repeat(total[begins] - gaps[begins], sizes) + (np.repeat(ranges.astype(np.uint64), sizes) << np.uint64(HASH_BITS - range_bits))
    order = np.argsort(h)
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first][np.add.reduceat(n, first) >= least]


def shards(docs: DataFrame, rows: Callable[[Shard], Iterator[pa.RecordBatch]], schema: str, shard_words: int = SHARD_WORDS) -> DataFrame:
    """What ``rows`` yields of each shard of the documents (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for b in batches:
            for lang, text in zip(b.column("lang"), b.column("text")):
                # The text's bytes as Arrow has them, which are UTF-8.
                if text.is_valid:
                    shard.add(lang.as_py() if lang.is_valid else UNKNOWN_LANG, text.as_buffer().to_pybytes())
                if shard.size >= shard_words:
                    shard.close()
                    yield from rows(shard)
                    shard = Shard()
        if shard.size:
            shard.close()
            yield from rows(shard)

    return spread(docs.select("lang", "text")).mapInArrow(run, schema)


def marked(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set in a bitmap of a power of two bits."""
    place = hashes & np.uint64(8 * len(marks) - 1)
    return (marks[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def frequent_marks(docs: DataFrame, least: int, max_words: int, mark_bits: int = MARK_BITS) -> np.ndarray:
    """A bitmap with a bit for the hash of every phrase that occurs ``least`` times or more."""
    # Ranges are as many at any size up to RANGE_SPLITS splits; beyond, they keep the largest one's size.
    range_bits = RANGE_BITS + max(0, spread(docs).rdd.getNumPartitions() // RANGE_SPLITS).bit_length()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, blocks = np.zeros(0, np.int64), []

        def found(upto: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(reaching(ranges[:upto], blocks[:upto], least, range_bits).astype(np.int64))], ["h"])

        for b in batches:
            ranges, blocks = np.append(ranges, b.column("range").to_numpy()), blocks + b.column("hashes").to_pylist()
            whole = int(np.searchsorted(ranges, ranges[-1])) if len(ranges) else 0
            if whole:
                yield found(whole)
                ranges, blocks = ranges[whole:], blocks[whole:]
        if blocks:
            yield found(len(blocks))

    packed = shards(docs, lambda shard: shard.hash_rows(max_words, least, range_bits), "range long, hashes binary")
    counts = packed.repartition("range").sortWithinPartitions("range").mapInArrow(merge, "h long")
    place = F.col("h").bitwiseAND((1 << mark_bits) - 1) + 1  # counted from one
    bits = counts.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros((1 << mark_bits) // 8, np.uint8)
    for r in bits.collect():  # 4 KB each, 32 MB at most
        out[(r["at"] - 1) * len(r["bits"]) :][: len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def frequent_phrases(docs: DataFrame, least: int = LEAST_COUNT, max_words: int = MAX_WORDS, mark_bits: int = MARK_BITS) -> DataFrame:
    """(lang, phrase, n) of the phrases that occur ``least`` times or more; beside a null phrase the number of all words."""
    marks = docs.sparkSession.sparkContext.broadcast(frequent_marks(docs, least, max_words, mark_bits))
    counts = shards(docs, lambda shard: shard.phrase_rows(max_words, marks.value), FOUND).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return cut_lineage(counts.filter((F.col("n") >= least) | F.col("phrase").isNull()))


def _words(phrase: str = "phrase"):  # noqa: ANN202
    return F.split(phrase, " ")


def scored(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of every candidate, by its lowest-scoring cut."""
    known = frequent.filter("phrase IS NOT NULL")
    candidates = known.filter(F.size(_words()) > 1).select("lang", "phrase", F.col("n").alias("a"), _words().alias("w"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1))).select(
        "lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("k"))).alias("left"), F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.size("w"))).alias("right")
    )
    of = lambda part, name: known.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
    met = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr("CAST(1000000 AS DECIMAL(7,0)) * (CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(16,0))) div (CAST(l AS DECIMAL(16,0)) * CAST(r AS DECIMAL(16,0)))")
    best = met.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("m"))
    return best.select("lang", "phrase", "m.a", "m.l", "m.r", "m.score")


def mine(docs: DataFrame, least: int = LEAST_COUNT, top: int = TOP, mark_bits: int = MARK_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's ``top`` phrases, those left out that mostly stand inside a longer one."""
    frequent = frequent_phrases(docs, least, mark_bits=mark_bits)
    found = cut_lineage(scored(frequent))
    longer = found.withColumn("w", _words()).filter(F.size("w") > 2)
    # Every shorter run of words inside a candidate, in the lengths that candidates have.
    lengths = F.sequence(F.lit(2), F.size("w") - 1)
    inside = F.flatten(F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda s: F.concat_ws(" ", F.slice("w", s, m)))))
    held = longer.select("lang", F.explode(F.array_distinct(inside)).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = found.join(held, ["lang", "phrase"], "left").filter(F.coalesce(F.col("longer") * 100 < F.col("a") * MOSTLY_INSIDE, F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = frequent.filter("phrase IS NULL").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


# ASCII capitals as TO_WORDS' lower() takes them; the ends and blanks as above.
SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
u AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
o AS (SELECT lang, unnest([w[i], CASE WHEN i + 1 <= len(w) THEN w[i] || ' ' || w[i + 1] END, CASE WHEN i + 2 <= len(w) THEN w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END]) AS phrase FROM u),
f AS (SELECT lang, phrase, count(*) AS n FROM o WHERE phrase IS NOT NULL GROUP BY ALL),
c AS (SELECT lang, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE n >= 10 AND contains(phrase, ' ')),
k AS (SELECT *, unnest(range(1, len(w))) AS k FROM c),
s AS (SELECT k.lang, k.phrase, a, k, x.n AS l, y.n AS r, (1000000::HUGEINT * a * a // (x.n::HUGEINT * y.n))::BIGINT AS score FROM k
 JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(w[:k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (SELECT lang, phrase, max(longer) AS longer FROM (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a AS longer FROM c WHERE len(w) = 3) GROUP BY ALL),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE NOT contains(phrase, ' ') GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n AS n, score
FROM b LEFT JOIN h USING (lang, phrase) JOIN t USING (lang) WHERE longer IS NULL OR 100 * longer < 50 * a QUALIFY rank <= 2000"""
