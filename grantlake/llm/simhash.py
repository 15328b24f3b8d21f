"""SimHash near-duplicates by multi-index hashing, and the classes they form.

Fingerprints are cut into two halves. Of two fingerprints at most three bits apart, one half differs in
at most one bit; so every half is looked up in the table of halves together with the small Hamming
ball of radius one around it, and the full distance of what is found is verified. Two halves one bit
apart have different parity, so only halves of even parity enumerate their ball: each pair is met
once from one side. Equal fingerprints are one node, whatever the number of their documents.

A half that more than ``LARGE_HALF`` different fingerprints share isn't paired up: its fingerprints look
up every value within the distance that is left over in the other half, so the work for a
fingerprint is bounded (5,489 lookups) and doesn't grow with the group.

Classes are found by alternating large-star and small-star steps on checkpointed edges; nothing but two
numbers a step reaches the driver.

``one_of_similar`` serves the pipeline: its classes link texts whose sets of five-word shingles have a
Jaccard similarity of 0.8 or more. Such texts mostly lie over three bits apart, so beside the pairs
of the multi-index search those that agree in one of ``BANDS`` bands of min-hashes are candidates (all but
0.04 % of the pairs at 0.8, fewer above), and each candidate is verified by its exact similarity, unless
others have linked it already. A band's value that more than ``LARGE_BAND`` different texts share isn't
paired up: each of them is first compared with the least and ``LEADERS`` others of them in each such band. Where
that leaves more than one class in a band, its texts meet in rare shingles instead: a set's shingles are
ordered from rare to frequent, and two sets of similarity 0.8 share one among the first few of each
(prefix filter), so what a template gives to all of them makes no pairs. This way is exact: the size of a
band changes the path alone.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; with fewer words
than a shingle the whole sequence is one shingle; a very long text is read whole, in chunks. Repeated
rows are rows of their own in one class. Rows of one doc_id with different texts are one document: what
its texts reach is one class. A row with a null doc_id gets its fingerprint's class but names none and
links none. Extra columns are ignored. An empty table gives an empty result.

Hot keys: a fingerprint that a third of all documents share, or a star's hub, is one narrow row on one
side of its joins; the long side is split by AQE's skew join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlake.llm.common import cut_lineage, spread, words_of

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
HALF_BITS = 32
LARGE_HALF = 4096
CHUNK = 1 << 16
SIMILAR_WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 20, 5
LARGE_BAND = 64
LEADERS = 4
MOST_BROADCAST = 1_000_000  # rows of two longs
LOAD_BITS = 20


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned SimHash of the word shingles; a bit is 1 if over half of the shingle hashes have it."""
    words = words_of(text)
    if not words:
        return 0
    words = [w.lower() for w in words]
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + shingle - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.text], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b.doc_id, "fp": fp})

    return spread(docs.select("doc_id", "text")).mapInPandas(run, "doc_id long, fp long")


def _key(segment: int, half: Column) -> Column:
    """A half with its segment's number in front, as one long."""
    return F.lit(segment << HALF_BITS).bitwiseOR(half)


def _half(fp: Column, segment: int) -> Column:
    return F.shiftrightunsigned(fp, HALF_BITS * segment).bitwiseAND((1 << HALF_BITS) - 1)


def _ball(df: DataFrame, segment: int, radius: Column) -> DataFrame:
    """Adds ``near``: every value of fp with up to ``radius`` bits of the half changed, each once."""
    low = HALF_BITS * segment
    out = df.withColumn("near", F.col("fp")).withColumn("_from", F.lit(0)).withColumn("_left", radius)
    for _ in range(MAX_BITS):
        bits = F.when((F.col("_left") > 0) & (F.col("_from") < HALF_BITS), F.sequence("_from", F.lit(HALF_BITS - 1)))
        flips = F.transform(F.coalesce(bits, F.array().cast("array<int>")), lambda i: F.struct(
            F.col("near").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i + low)).alias("near"), (i + 1).alias("_from"),
            (F.col("_left") - 1).alias("_left"),
        ))
        stay = F.array(F.struct("near", F.lit(HALF_BITS).alias("_from"), F.lit(0).alias("_left")))
        out = out.withColumn("_f", F.explode(F.concat(stay, flips))).withColumns({c: F.col(f"_f.{c}") for c in ("near", "_from", "_left")})
    return out.drop("_f", "_from", "_left")


def links(nodes: DataFrame, max_bits: int = MAX_BITS, large: int = LARGE_HALF) -> DataFrame:
    """(a, b) of the ids of different fingerprints at most ``max_bits`` <= 3 apart. ``nodes``: (fp, id), fp unique."""
    halves = F.array(*[F.struct(F.lit(s).alias("segment"), _key(s, _half(F.col("fp"), s)).alias("key")) for s in (0, 1)])
    table = nodes.withColumn("_h", F.explode(halves)).select("fp", "id", "_h.segment", "_h.key")
    crowded = table.groupBy("key").agg(F.count("*").alias("_n")).filter(F.col("_n") > large).select("key")
    even = F.bit_count(F.col("key").bitwiseAND((1 << HALF_BITS) - 1)) % 2 == 0
    ball = F.transform(F.sequence(F.lit(0), F.lit(HALF_BITS - 1)), lambda i: F.col("key").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    probes = table.withColumn("probe", F.explode(F.concat(F.array("key"), F.when(even, ball).otherwise(F.array().cast("array<long>")))))
    probes = probes.select("fp", "id", "segment", F.col("key").alias("own"), F.col("probe").alias("key"))
    of = table.select(F.col("fp").alias("fp2"), F.col("id").alias("id2"), "key")
    # A pair that meets in the same half is met from both sides: the lesser side keeps it.
    once = (F.col("own") != F.col("key")) | (F.col("fp") < F.col("fp2"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= max_bits
    plain = probes.join(crowded, "key", "left_anti").join(of, "key").filter(once & near).select("id", "id2")
    full = nodes.select(F.col("fp").alias("near"), F.col("id").alias("id2"))
    hot = probes.join(crowded, "key", "left_semi")
    # With the probed half put in place, the rest of the distance may lie in the other half.
    flipped = F.col("own").bitwiseXOR(F.col("key"))
    moved = F.when(F.col("segment") == 0, flipped).otherwise(F.shiftleft(flipped, HALF_BITS))
    left = F.lit(max_bits) - F.bit_count(flipped)
    hot = hot.withColumn("fp", F.col("fp").bitwiseXOR(moved)).withColumn("left", left)
    found = [_ball(hot.filter(F.col("segment") == s), 1 - s, F.col("left").cast("int")) for s in (0, 1)]
    looked_up = found[0].unionByName(found[1]).select("id", "near").join(full, "near").filter(F.col("id") != F.col("id2")).select("id", "id2")
    both = plain.unionByName(looked_up)
    return both.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each end of an edge.

    Each step points what is linked at a node to the least of them, first the greater neighbours,
    then the lesser ones; the edges end as stars around the least ids. Steps grow with the logarithm
    of the longest path.
    """
    edges = cut_lineage(edges.select("a", "b"))
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        up = large.join(least, "b")
        small = up.select(F.col("m").alias("a"), F.col("a").alias("b")).union(up.select(F.col("m").alias("a"), "b"))
        edges = cut_lineage(small.filter("a <> b").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))
        before = state


def classes(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    found = cut_lineage(fingerprints(docs, shingle))
    nodes = found.groupBy("fp").agg(F.min("doc_id").alias("id"))
    linked = components(links(nodes.filter(F.col("id").isNotNull()), max_bits))
    of = nodes.join(linked, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return found.join(of, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str | None, shingle: int = SIMILAR_WORDS) -> np.ndarray:
    """Sorted different hashes of the word shingles; none for a text without words."""
    words = [w.lower() for w in words_of(text)]
    runs = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)] * bool(words)
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in runs], np.uint64))


_DRAWN = np.random.default_rng(SEED)
FACTORS, SHIFTS = (_DRAWN.integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64, endpoint=False) for _ in range(2))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed long a band; two sets agree in a min-hash with the probability of their Jaccard similarity."""
    if not len(hashes):
        return []
    least = np.min([(hashes[at : at + 4096, None] * (FACTORS | np.uint64(1)) + SHIFTS).min(axis=0) for at in range(0, len(hashes), 4096)], axis=0)
    bands = least.reshape(BANDS, BAND_ROWS)
    return [xxhash.xxh64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(bands)]


def _similar_profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, th, node, fp, keys) of every row: ``th`` is a hash of the text, ``node`` one of its set of shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t) for t in b.text]
            fp = np.array([fingerprint(t, SIMILAR_WORDS) for t in b.text], np.uint64).view(np.int64)
            node = [xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in sets]
            yield pd.DataFrame({"doc_id": b.doc_id, "th": b.th, "node": node, "fp": fp, "keys": [band_keys(x) for x in sets]})

    own = spread(docs.select("doc_id", "text", F.xxhash64("text").alias("th")))
    return cut_lineage(own.mapInPandas(run, "doc_id long, th long, node long, fp long, keys array<long>"))


def band_members(nodes: DataFrame) -> DataFrame:
    """(key, node, lead, n) of the nodes that share a band's value: the least of them and their number. ``nodes``: (node, keys), node unique."""
    held = nodes.select("node", F.explode("keys").alias("key"))
    groups = held.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).filter("n > 1")
    return cut_lineage(held.join(groups, "key"))


def led_pairs(members: DataFrame, large: int = LARGE_BAND) -> DataFrame:
    """(a, b): each member with the least of its group; in a large group also with ``LEADERS`` others."""
    many = members.filter(F.col("n") > large)
    leaders = many.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(LEADERS)).alias("part")).agg(F.min("node").alias("b"))
    led = many.join(leaders, "key").filter("node <> b").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))
    return members.filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).union(led).distinct()


def open_pairs(members: DataFrame, classes_: DataFrame, large: int = LARGE_BAND) -> DataFrame:
    """(a, b) of members of a group that isn't large which are in different classes so far. ``classes_``: (id, component)."""
    own = members.filter(F.col("n") <= large).join(classes_.withColumnRenamed("id", "node"), "node", "left")
    own = own.select("key", "node", F.coalesce("component", "node").alias("c"))
    apart = own.groupBy("key").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).filter("_lo < _hi").select("key")
    own = own.join(apart, "key")
    other = own.select("key", F.col("node").alias("b"), F.col("c").alias("d"))
    return own.join(other, "key").filter("node < b AND c <> d").select(F.col("node").alias("a"), "b").distinct()


def crowded(members: DataFrame, classes_: DataFrame, large: int = LARGE_BAND) -> DataFrame:
    """(node) of the members of large groups that aren't one class. ``classes_``: (id, component)."""
    own = members.filter(F.col("n") > large).join(classes_.withColumnRenamed("id", "node"), "node", "left")
    own = own.select("key", "node", F.coalesce("component", "node").alias("c"))
    apart = own.groupBy("key").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).filter("_lo < _hi").select("key")
    return own.join(apart, "key").select("node").distinct()


def shingle_loads(sets: DataFrame, bits: int = LOAD_BITS) -> np.ndarray:
    """How many shingles of all sets fall into each of ``2 ** bits`` buckets by hash: a table of fixed size, 4 MB, added up in tasks."""
    chunk = 1 << max(0, bits - 6)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(1 << bits, np.int64)
        for b in batches:
            for hashes in b["hashes"]:
                np.add.at(own, np.asarray(hashes, np.int64) & (1 << bits) - 1, 1)
        parts = own.reshape(-1, chunk)
        yield pd.DataFrame({"chunk": np.arange(len(parts)), "n": [np.minimum(x, 1 << 31).astype("<u4").tobytes() for x in parts]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<u4").astype(np.int64) for x in group["n"])
        return pd.DataFrame({"chunk": group["chunk"][:1], "n": [np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes()]})

    parts = sets.select("hashes").mapInPandas(count, "chunk long, n binary").groupBy("chunk").applyInPandas(add, "chunk long, n binary").collect()
    out = np.zeros(1 << bits, np.uint32)
    for r in parts:
        out[r["chunk"] * chunk :][:chunk] = np.frombuffer(r["n"], "<u4")
    return out


def rare_prefixes(sets: DataFrame, similarity: float = SIMILARITY, bits: int = LOAD_BITS) -> DataFrame:
    """(node, size, place, shingle): of each set the rarest shingles, as many as a similar set of any size must share one of.

    Any order of shingles serves, if it is the same for all sets. This one goes by the load of a shingle's bucket, so
    frequent shingles come last; no shingle has to meet its count in a shuffle.
    """
    loads = sets.sparkSession.sparkContext.broadcast(shingle_loads(sets, bits))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load = loads.value
        for b in batches:
            for node, hashes in zip(b["node"], b["hashes"]):
                own = np.asarray(hashes, np.int64)
                kept = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1
                order = np.lexsort((own, load[own & (1 << bits) - 1]))[:kept]
                yield pd.DataFrame({"node": node, "size": len(own), "place": np.arange(1, len(order) + 1), "shingle": own[order]}).astype({"size": "int32", "place": "int32"})

    return sets.filter(F.size("hashes") > 0).select("node", "hashes").mapInPandas(run, "node long, size int, place int, shingle long")


def rare_leads(prefixes: DataFrame, large: int = LARGE_BAND) -> DataFrame:
    """(a, b): where a shingle is among the rare ones of more than ``large`` sets, each of them with the smallest."""
    often = prefixes.groupBy("shingle").agg(F.count("*").alias("n"), F.min(F.struct("size", "node")).alias("lead")).filter(F.col("n") > large)
    led = prefixes.join(often, "shingle").filter("node <> lead.node")
    return led.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()


def rare_pairs(prefixes: DataFrame, classes_: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) in different classes so far that share a rare shingle and may be similar by their sizes and its places.

    Of two similar sets, the smaller one has a shared shingle even among fewer of its rarest: all shared
    shingles are at least ``2 s / (1 + s)`` of it. At the first shared shingle the rest of both sets must be
    long enough for the overlap that is asked for.
    """
    own = prefixes.join(classes_.withColumnRenamed("id", "node"), "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    share = similarity / (1 + similarity)
    small = own.filter(F.col("place") <= F.col("size") - F.ceil(2 * share * F.col("size") - 1e-9) + 1)
    x, y = (df.select(F.col("shingle").alias(f"shingle_{end}"), *[F.col(c).alias(f"{c}_{end}") for c in ("node", "size", "place", "c")]) for df, end in ((small, "x"), (own, "y")))
    left = F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y")) + 1
    fits = (F.struct("size_x", "node_x") < F.struct("size_y", "node_y")) & (F.col("size_x") >= similarity * F.col("size_y") - 1e-9) & (left >= share * (F.col("size_x") + F.col("size_y")) - 1e-9)
    met = x.join(y, (F.col("shingle_x") == F.col("shingle_y")) & fits & (F.col("c_x") != F.col("c_y")))
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of the wanted nodes (node, th), from one text of each.

    The hashes of up to ``MOST_BROADCAST`` wanted texts are broadcast, so that only these texts are shuffled; of
    more of them, all texts are.
    """
    texts, named = docs.select("text", F.xxhash64("text").alias("th")), wanted
    if wanted.count() <= MOST_BROADCAST:
        named = F.broadcast(wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"node": b.node, "hashes": [shingle_set(t).view(np.int64) for t in b.text]})

    found = texts.join(named, "th").groupBy("node").agg(F.min("text").alias("text"))
    return cut_lineage(found.mapInPandas(run, "node long, hashes array<long>"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose sets are similar, by their exact Jaccard similarity."""
    of = lambda end, name: sets.select(F.col("node").alias(end), F.col("hashes").alias(name))
    both = F.size(F.array_intersect("x", "y"))
    met = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b")
    return cut_lineage(met.filter(both >= similarity * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b"))


def joined_classes(classes_: DataFrame, links_: DataFrame) -> DataFrame:
    """Classes (id, component) after more links (a, b): a class goes in as the links to its least, so few steps join it to others."""
    if links_.isEmpty():
        return classes_
    return cut_lineage(components(classes_.select(F.col("component").alias("a"), F.col("id").alias("b")).union(links_)))


def similar_classes(docs: DataFrame, profile: DataFrame, large: int = LARGE_BAND) -> DataFrame:
    """(id, component) of the nodes that have a similar one.

    First every candidate is compared with the least of each of its groups, then only those pairs are that
    these links leave in different classes: what is linked already need not be compared to be kept. Last
    come the texts of large groups that are still apart, by their rare shingles.
    """
    nodes = profile.groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.min("th").alias("th"))
    nodes = cut_lineage(nodes)
    members, by_print = band_members(nodes.select("node", "keys")), nodes.groupBy("fp").agg(F.min("node").alias("id"))
    same = nodes.join(by_print, "fp").filter("node <> id").select(F.least("id", "node").alias("a"), F.greatest("id", "node").alias("b"))
    first = cut_lineage(led_pairs(members, large).union(links(by_print)).union(same).distinct())
    ends = members.select("node").union(first.select("a")).union(first.select("b")).distinct()
    sets = shingle_sets(docs, cut_lineage(nodes.select("node", "th").join(ends, "node")))
    found = cut_lineage(components(verified(first, sets)))
    found = joined_classes(found, verified(open_pairs(members, found, large).join(first, ["a", "b"], "left_anti"), sets))
    apart = cut_lineage(crowded(members, found, large))
    if apart.isEmpty():
        return found
    prefixes = cut_lineage(rare_prefixes(sets.join(apart, "node", "left_semi")))
    found = joined_classes(found, verified(rare_leads(prefixes, large), sets))
    return joined_classes(found, verified(rare_pairs(prefixes, found), sets))


def one_of_similar(docs: DataFrame) -> DataFrame:
    """One row of each class of similar texts, the one with the least doc_id; rows without a doc_id come last in a class.

    Texts are shuffled once, to meet the ids that stay; rows that are equal in id and text meet once more.
    """
    profile = _similar_profiles(docs)
    linked = similar_classes(docs, profile).withColumnRenamed("id", "node")
    rows = profile.select("doc_id", "th", "node").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    alike = rows.groupBy("component", "doc_id", "th").agg(F.count("*").alias("n"))
    first = alike.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "n")).alias("r"))
    left = [c * (1 + max(map(len, docs.columns))) for c in "_~^"]  # no column of docs has a name as long
    first = first.select(F.col("r.doc_id").alias(left[0]), F.col("r.th").alias(left[1]), F.col("r.n").alias(left[2]))
    on = F.col("doc_id").eqNullSafe(F.col(left[0])) & (F.xxhash64("text") == F.col(left[1]))
    kept = docs.join(first, on)
    repeated = kept.filter(F.col(left[2]) > 1).dropDuplicates(["doc_id", left[1]])
    return kept.filter(F.col(left[2]) == 1).select(*docs.columns).unionByName(repeated.select(*docs.columns))
