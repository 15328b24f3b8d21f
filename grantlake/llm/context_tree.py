"""Language-model scores by context-tree weighting over bytes.

The model gives each byte of a lower-cased text (and an end mark) from the ``DEPTH`` bytes before it. A
byte is decomposed into eight binary choices; every node of that small tree has its own tree of byte
contexts, whose nodes hold Krichevsky-Trofimov estimates. Context-tree weighting mixes the estimates of
all depths, each node weighing "stop here" against "look further back" by how well the two explain all
training bytes. Block probabilities of the estimator depend on counts alone, so the counts of byte
strings of length ``DEPTH`` + 1 are all the model needs. At scoring time the mix ends at the deepest
context that training has seen. A plain unigram word model with add-one smoothing stands beside it.

How it runs: tasks count words and byte strings of what they read; counts meet by shard, in rounds of
at most ``FAN_IN`` rows. A byte string's shard depends on the ``CUT`` bytes before, so a shard holds whole
subtrees; the levels above are put together from sums by context and node (at most 2 * 65,536 * 255 of
them, in practice what a text's byte pairs are). To score, documents are dealt into blocks of bounded
size; each block asks the shards for its different words and strings only, and gets an array back. What
several blocks ask a shard is scored once. A shard that is asked for more than ``ASKED`` strings splits
its requests and copies its own table as often: the number asked is summed while counting, so copies
grow with the requests and not with the product of model and input. Nothing is sampled or capped.

Words are told apart by 64-bit hashes; a string's log10 probability travels in single precision. Defined
cases: a null or empty text is the end alone. Texts of repeated rows count each time; rows with one or
no doc_id are dealt by their texts. A long text is scored whole, in pieces that overlap by the context.
Without training documents every word has probability one in one and every byte one in 256. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlake.llm.common import shared_folder, spread

DEPTH = 6
CUT = 3
START, END = b"\xfe" * DEPTH, b"\xff"  # bytes that UTF-8 never uses
BLOCK_CHARS = 8_000_000
PART_BYTES = 2_000_000
MOST_PIECES = 256
SORTED = 10_000_000  # strings that are sorted at a time while counting
MOST_SHARDS = 4096
FAN_IN = 64
ASKED = 2_000_000
LOOKED_UP = 200_000
WORDS, STRINGS = 0, 1
COUNTS = "kind int, shard int, salt int, asked long, keys binary, counts binary"
REQUESTS = "kind int, shard int, salt int, block int, keys binary"
REPLIES = "kind int, shard int, block int, found binary"
OUT = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"


def content(text: str | None) -> bytes:
    return START + (text or "").encode("utf-8", "surrogatepass").lower() + END


def in_parts(texts: list[str | None], most_bytes: int | None = None) -> Iterator[list[tuple[int, bytes]]]:
    """(place of the text, piece): parts of bounded size. A long text is cut; each piece begins with the DEPTH bytes before it."""
    most_bytes = most_bytes or PART_BYTES
    part, n = [], 0
    for place, t in enumerate(texts):
        whole = content(t)
        for at in range(0, len(whole) - DEPTH, most_bytes):
            part.append((place, whole[at : at + most_bytes + DEPTH]))
            n += len(part[-1][1]) - DEPTH
            if n >= most_bytes or len(part) == MOST_PIECES:
                yield part
                part, n = [], 0
    if part:
        yield part


def strings(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all byte strings of the pieces in order, and how many each piece has.

    A key holds the bytes before, latest first, and then the byte itself: contexts are its prefixes.
    """
    sizes = np.array([len(p) - DEPTH for p in pieces], np.int64)
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    n = len(raw) - DEPTH
    keys = np.zeros(max(n, 0), np.uint64)
    for back in (*range(1, DEPTH + 1), 0):
        keys <<= np.uint64(8)
        keys |= raw[DEPTH - back : DEPTH - back + n]
    # What begins in one piece and ends in the next isn't a string of either.
    inside = np.ones(n + DEPTH, bool)
    begin = np.concatenate([[0], np.cumsum(sizes + DEPTH)[:-1]]).astype(np.int64)
    for k in range(DEPTH):
        inside[begin + k] = False
    return keys[inside[DEPTH:]], sizes


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words and the end, an empty word."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b""]


def hashed(words: Iterable[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of ``wanted``, ascending with repeats, among ascending different ``keys``: each different one is searched once."""
    first = firsts(wanted)
    return np.repeat(values[np.searchsorted(keys, wanted[first])], np.diff(np.append(first, len(wanted))))


def firsts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each different key begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[firsts(keys)]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order with their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = firsts(keys)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def planes(values: np.ndarray, ascending: bool = False) -> bytes:
    """64-bit values, or the steps between ascending ones, byte by byte of all: mostly zeros, which Spark's shuffle compresses."""
    values = values.astype(np.uint64)
    if ascending:
        values = np.diff(values, prepend=np.uint64(0))
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(raw: bytes, ascending: bool = False) -> np.ndarray:
    values = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(values, dtype=np.uint64) if ascending else values


def tallied(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys of all arrays in order and how often each occurs: one sort in place. The list is emptied."""
    keys = np.concatenate(arrays)
    arrays.clear()
    keys.sort()
    first = firsts(keys)
    return keys[first], np.diff(np.append(first, len(keys)))


def gathered(texts: list[str | None]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) of the words and of the byte strings of some texts."""
    counter: Counter[bytes] = Counter()
    for t in texts:
        counter.update(tokens(t))
    words = hashed(counter)
    words = summed(words, np.fromiter(counter.values(), np.int64, len(counter)))
    found, some, n = [], [], 0
    for part in in_parts(texts):
        some.append(strings([p for _, p in part])[0])
        n += len(some[-1])
        if n >= SORTED:
            found.append(tallied(some))
            n = 0
    if some:
        found.append(tallied(some))
    return words, found[0] if len(found) == 1 else summed(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def shard_of(kind: int, keys: np.ndarray, shards: int) -> np.ndarray:
    """Words by their hash, strings by the CUT bytes before."""
    if kind == STRINGS:
        keys = (keys >> np.uint64(8 * (DEPTH + 1 - CUT))) * np.uint64(0x9E3779B97F4A7C15)
    return ((keys >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def by_shard(kind: int, keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, where its keys are), in order of the keys."""
    of = shard_of(kind, keys, shards)
    order = np.argsort(of, kind="stable")
    begin = firsts(of[order])
    for lo, hi in zip(begin, [*begin[1:], len(of)]):
        yield int(of[order[lo]]), order[lo:hi]


# ---- the model of one shard -------------------------------------------------------------------------


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0: Stirling's series after moving x up by eight."""
    shift = sum(np.log(x + k) for k in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - shift


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - np.log(np.pi)


class Level:
    """All binary nodes of the contexts of one depth: key = context, then the node within the byte (1 to 255)."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray) -> None:
        """``pairs``: different (context, byte) in order. Their nodes at one bit are in order too, so runs are summed."""
        contexts, byte = pairs >> np.uint64(8), pairs & np.uint64(255)
        keys, zeros, ones = [np.zeros(0, np.uint64)], [np.zeros(0)], [np.zeros(0)]
        for bit in range(8 if len(pairs) else 0):
            key = node(contexts, byte, bit)
            first = firsts(key)
            total, own = np.add.reduceat(counts, first), np.add.reduceat(counts * (byte >> np.uint64(7 - bit) & np.uint64(1)), first)
            keys.append(key[first])
            ones.append(own)
            zeros.append(total - own)
        keys = np.concatenate(keys)
        order = np.argsort(keys)
        self.keys, zeros, ones = keys[order], np.concatenate(zeros)[order], np.concatenate(ones)[order]
        self.kt = kt(zeros, ones) if len(keys) else zeros
        self.p1 = (ones + 0.5) / (zeros + ones + 1)

    def weigh(self, deeper: np.ndarray | None) -> None:
        """Log of the weighted probability, and of the weight of stopping here, from the sum over deeper contexts."""
        if deeper is None:
            self.log_w, self.stop = self.kt, np.ones(len(self.kt))
        else:
            self.log_w = np.log(0.5) + np.logaddexp(self.kt, deeper)
            self.stop = np.exp(np.log(0.5) + self.kt - self.log_w)

    def parents(self, above: Level) -> np.ndarray:
        """For each node of ``above`` the summed log of the weighted probabilities below it."""
        up = (self.keys >> np.uint64(16) << np.uint64(8)) | (self.keys & np.uint64(255))
        return np.bincount(np.searchsorted(above.keys, up), self.log_w, len(above.keys))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)


def node(contexts: np.ndarray, byte: np.ndarray, bit: int) -> np.ndarray:
    return contexts << np.uint64(8) | (byte >> np.uint64(8 - bit) if bit else np.uint64(0)) | np.uint64(1 << bit)


def at_depth(keys: np.ndarray, depth: int) -> np.ndarray:
    return keys >> np.uint64(8 * (DEPTH + 1 - depth))


def shorter(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) pairs with their counts, the contexts one byte shorter."""
    return summed((pairs >> np.uint64(16) << np.uint64(8)) | (pairs & np.uint64(255)), counts)


def levels(pairs: np.ndarray, counts: np.ndarray, top: int, deepest: int = DEPTH, below: np.ndarray | None = None) -> dict[int, Level]:
    """Weighted levels from ``deepest`` up to ``top``; ``below`` are the sums beneath the nodes of the deepest one."""
    out = {}
    for depth in range(deepest, top - 1, -1):
        out[depth] = Level(pairs, counts)
        out[depth].weigh(out[depth + 1].parents(out[depth]) if depth < deepest else below)
        pairs, counts = shorter(pairs, counts)
    return out


def top_levels(rows: pd.DataFrame) -> dict[int, Level]:
    """The levels above the cut from sums: counts by context and byte (part 0), log probabilities below by context and node (part 1)."""
    seen, under = rows[rows.part == 0], rows[rows.part == 1]
    pairs, order = np.unique(seen["key"].to_numpy(np.uint64), return_index=True)
    counts = seen.value.to_numpy(float)[order]
    last = Level(pairs, counts)
    below = np.zeros(len(last.keys))
    at, known = last.find(under["key"].to_numpy(np.uint64))
    np.add.at(below, at[known], under.value.to_numpy(float)[known])
    return levels(pairs, counts, 0, CUT - 1, below)


def log10_probabilities(keys: np.ndarray, tree: dict[int, Level]) -> np.ndarray:
    """log10 of the probability of each string's last byte after the bytes before it, some strings at a time."""
    return np.concatenate([_looked_up(keys[at : at + LOOKED_UP], tree) for at in range(0, max(len(keys), 1), LOOKED_UP)])


def _looked_up(keys: np.ndarray, tree: dict[int, Level]) -> np.ndarray:
    byte, total = keys & np.uint64(255), np.zeros(len(keys))
    for bit in range(8):
        got, left = np.zeros(len(keys)), np.ones(len(keys))
        latest, open_ = np.full(len(keys), 0.5), np.ones(len(keys), bool)
        for depth in range(DEPTH + 1):
            level = tree[depth]
            at, known = level.find(node(at_depth(keys, depth), byte, bit))
            known &= open_
            open_ = known
            if not known.any():
                break
            p, stop = level.p1[at], level.stop[at]
            got = np.where(known, got + left * stop * p, got)
            left = np.where(known, left * (1 - stop), left)
            latest = np.where(known, p, latest)
        one = got + left * latest
        total += np.log10(np.where(byte >> np.uint64(7 - bit) & np.uint64(1), one, 1 - one))
    return total


# ---- Spark ------------------------------------------------------------------------------------------


def counted(train: DataFrame, shards: int, salts: int) -> DataFrame:
    """Keys and counts by kind and shard, and ``asked``: how many keys the blocks had in all. Summed in each task, then in rounds."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, n, turn = [], 0, TaskContext.get().partitionId()

        def rows(salt: int) -> pd.DataFrame:
            out = [
                (kind, s, salt, len(at), planes(keys[at], True), planes(counts[at]))
                for kind, (keys, counts) in enumerate(gathered(texts))
                for s, at in by_shard(kind, keys, shards)
            ]
            return pd.DataFrame(out, columns=["kind", "shard", "salt", "asked", "keys", "counts"])

        for b in batches:
            for t in b.text:
                texts.append(t)
                n += len(t or "")
                if n >= BLOCK_CHARS:
                    yield rows(turn % salts)
                    texts, n, turn = [], 0, turn + 7919
        if texts:
            yield rows(turn % salts)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([from_planes(k, True) for k in group["keys"]])
        keys, counts = summed(keys, np.concatenate([from_planes(c) for c in group.counts]))
        own = group[["kind", "shard", "salt"]].iloc[:1]
        return own.assign(asked=int(group.asked.sum()), keys=[planes(keys, True)], counts=[planes(counts)])

    found = spread(train.select("text")).mapInPandas(count, COUNTS)
    while True:
        found = found.groupBy("kind", "shard", "salt").applyInPandas(merge, COUNTS)
        if salts == 1:
            return found
        salts = -(-salts // FAN_IN)
        found = found.withColumn("salt", F.col("salt") % salts)


def word_totals(model: DataFrame) -> tuple[int, int]:
    """All training tokens and the different ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [from_planes(c) for c in b.counts]
            yield pd.DataFrame({"n": [int(c.sum()) for c in found], "v": [len(c) for c in found]})

    got = model.filter(F.col("kind") == WORDS).select("counts").mapInPandas(run, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return int(got[0] or 0), int(got[1] or 0)


def top_of(model: DataFrame) -> dict[int, Level]:
    """The levels above the cut; a row for each context of that length and byte or node reaches the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw_keys, raw_counts in zip(b["keys"], b.counts):
                pairs, counts = from_planes(raw_keys, True), from_planes(raw_counts).astype(float)
                at_cut = levels(pairs, counts, CUT)[CUT]
                for _ in range(DEPTH + 1 - CUT):
                    pairs, counts = shorter(pairs, counts)
                nodes = summed((at_cut.keys >> np.uint64(16) << np.uint64(8)) | (at_cut.keys & np.uint64(255)), at_cut.log_w)
                for part, (key, value) in enumerate(((pairs, counts), nodes)):
                    yield pd.DataFrame({"part": part, "key": key.astype(np.int64), "value": value})

    own = model.filter(F.col("kind") == STRINGS).select("keys", "counts")
    rows = own.mapInPandas(run, "part int, key long, value double")
    return top_levels(rows.groupBy("part", "key").agg(F.sum("value").alias("value")).orderBy("part", "key").toPandas())


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """Per row: held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities), bits_per_byte (code length)."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(int(chars) // BLOCK_CHARS + 1, 4 * spark.sparkContext.defaultParallelism)
    shards = max(8, min(blocks, MOST_SHARDS))
    path = shared_folder(spark)
    counted(docs.filter(~held_out), shards, -(-blocks // FAN_IN)).drop("salt").write.parquet(path)
    model = spark.read.schema("kind int, shard int, asked long, keys binary, counts binary").parquet(path)
    train_tokens, different = word_totals(model)
    top = spark.sparkContext.broadcast(top_of(model))
    # One number for each of at most 2 * MOST_SHARDS shards.
    salts = {(r.kind, r.shard): r.asked // ASKED + 1 for r in model.select("kind", "shard", "asked").collect()}

    def ask(group: pd.DataFrame) -> pd.DataFrame:
        block, texts = int(group.block.iloc[0]), list(group.text)
        different_words: set[bytes] = set()
        for t in texts:
            different_words.update(tokens(t))
        words = distinct(hashed(different_words))
        own = distinct(np.concatenate([distinct(strings([p for _, p in part])[0]) for part in in_parts(texts)]))
        rows = [
            (kind, s, block % salts.get((kind, s), 1), block, planes(keys[at], True))
            for kind, keys in enumerate((words, own))
            for s, at in by_shard(kind, keys, shards)
        ]
        return pd.DataFrame(rows, columns=["kind", "shard", "salt", "block", "keys"])

    def answer(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame(columns=["kind", "shard", "block", "found"])
        kind = int(asked.kind.iloc[0])
        keys = from_planes(known["keys"].iloc[0], True) if len(known) else np.zeros(0, np.uint64)
        counts = from_planes(known.counts.iloc[0]) if len(known) else np.zeros(0, np.uint64)
        wanted = [from_planes(raw, True) for raw in asked["keys"]]
        every = distinct(np.concatenate(wanted))
        if kind == STRINGS:
            tree = top.value | levels(keys, counts.astype(float), CUT)
            values = log10_probabilities(every, tree).astype(np.float32)
        else:
            at, values = np.searchsorted(keys, every), np.zeros(len(every), np.int64)
            hit = np.flatnonzero(at < len(keys))
            hit = hit[keys[at[hit]] == every[hit]]
            values[hit] = counts[at[hit]]
        found = [values[np.searchsorted(every, w)].tobytes() for w in wanted]
        return pd.DataFrame({"kind": asked.kind, "shard": asked.shard, "block": asked.block, "found": found})

    def finish(group: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame(columns=[c.split()[0] for c in OUT.split(", ")])
        texts = list(group.text)
        reply = {(k, s): f for k, s, f in zip(replies.kind, replies.shard, replies.found)}

        def answered(kind: int, keys: np.ndarray, dtype: type) -> np.ndarray:
            values = np.zeros(len(keys), dtype)
            for s, at in by_shard(kind, keys, shards):
                values[at] = np.frombuffer(reply[kind, s], dtype)
            return values

        def of_words() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Tokens, known ones and base score of each text; each different word is hashed once."""
            place: dict[bytes, int] = {}
            of = [np.array([place.setdefault(w, len(place)) for w in tokens(t)], np.int32) for t in texts]
            n_tokens, hashes = np.array(list(map(len, of)), np.int64), hashed(place)
            keys = distinct(hashes)
            counts = answered(WORDS, keys, np.int64)[np.searchsorted(keys, hashes)]
            logs, known = np.log10((counts + 1) / (train_tokens + different + 1)), (counts > 0).astype(np.int64)
            return n_tokens, np.array([known[o].sum() for o in of]), np.array([logs[o].sum() for o in of])

        n_tokens, n_known, base = of_words()
        # Strings are sorted together with their piece: each different one of a piece is looked up once.
        parts = []
        for part in in_parts(texts):
            found, sizes = strings([p for _, p in part])
            found = np.sort(found << np.uint64(8) | np.repeat(np.arange(len(part), dtype=np.uint64), sizes))
            first = firsts(found)
            often = np.diff(np.append(first, len(found))).astype(np.int32)
            parts.append(([place_ for place_, _ in part], sizes, found[first], often))
        keys = distinct(np.concatenate([distinct(f >> np.uint64(8)) for _, _, f, _ in parts]))
        values, scores, n_bytes = answered(STRINGS, keys, np.float32).astype(float), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for places, sizes, found, often in parts:
            each = looked_up(keys, values, found >> np.uint64(8)) * often
            np.add.at(scores, places, np.bincount((found & np.uint64(255)).astype(np.int64), each, len(places)))
            np.add.at(n_bytes, places, sizes)
        return pd.DataFrame({
            "doc_id": group.doc_id.astype("Int64"), "n_tokens": n_tokens, "n_known": n_known, "train_tokens": train_tokens,
            "base_score": base, "score": scores, "n_bytes": n_bytes,
        })

    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    dealt = docs.select("doc_id", "text", block.alias("block")).repartition(blocks, "block")
    asked = dealt.groupBy("block").applyInPandas(ask, REQUESTS)
    copies = F.sequence(F.lit(0), F.floor(F.col("asked") / ASKED).cast("int"))
    salted = model.select("kind", "shard", "keys", "counts", F.explode(copies).alias("salt"))
    key = ["kind", "shard", "salt"]
    replies = asked.groupBy(*key).cogroup(salted.groupBy(*key)).applyInPandas(answer, REPLIES)
    scored = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(finish, OUT)
    bits = -F.col("score") / float(np.log10(2)) / F.col("n_bytes")
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", bits.alias("bits_per_byte"))
