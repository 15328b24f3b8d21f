"""Pairs of texts that a number of edits may turn into each other, tile against tile.

Rows of one block are dealt into tiles of bounded rows and characters by a hash of their texts, and each pair of tiles
is compared in one place: memory is bounded by two tiles, and a block of any size is spread over all tasks. Inside
a pair of tiles two bounds leave out what can't be alike. First, shared bigrams: k edits leave the longer of two texts at
least its bigrams less 2k of them, and a product of matrices counts those of all pairs at once. Then the edit distance itself,
by the bit vectors of Myers, for many pairs at a time. Both bounds only ever err towards keeping a pair; who
calls measures the kept ones exactly. Pairs of tiles grow as the square of a block, at some nanoseconds for each pair of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlake.sources.shared import cut_lineage

TILE_ROWS, TILE_CHARACTERS = 8192, 1 << 20
TASK_ROWS, TASK_PAIRS, MOST_TASKS = 1 << 15, 1 << 24, 100_000
DIMENSIONS = 1024
STRIP, AT_ONCE = 512, 16384
WORD = 64
CLASSES = 256


def edits(limit: float, longer: np.ndarray) -> np.ndarray:
    """How many edits two texts of likeness ``limit`` may be apart, as ``ingest._edits``."""
    return np.floor((1 - limit) * longer + 1e-9).astype(np.int64)


class Texts:
    """Texts in order of length: their characters in one array, and the numbered bigrams of each."""

    def __init__(self, texts: list[str]) -> None:
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.order = np.argsort(size, kind="stable")
        self.size = size[self.order]
        joined = "".join([texts[k] for k in self.order.tolist()])
        self.codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        self.row = np.repeat(np.arange(len(texts)), self.size)
        self.starts = np.cumsum(self.size) - self.size

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature): a bigram together with how often the text had it before."""
        inside = self.row[1:] == self.row[:-1]
        keys = (self.row[1:] << 42 | self.codes[:-1] << 21 | self.codes[1:])[inside]
        keys.sort()
        begins = np.flatnonzero(np.diff(keys, prepend=-1))
        again = np.arange(len(keys)) - np.repeat(begins, np.diff(np.append(begins, len(keys))))
        gram = (keys & ((1 << 42) - 1)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return keys >> 42, gram ^ (again.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def counted(a: Texts, b: Texts) -> tuple[np.ndarray, np.ndarray]:
    """A row of counts for each text: the features that both sides have, the frequent ones each by itself, the others in shared columns."""
    (row_a, f_a), (row_b, f_b) = a.features(), b.features()
    both = np.intersect1d(f_a, f_b)
    n = len(both)
    most = max(DIMENSIONS, (1 << 22) // (len(a.size) + len(b.size)))
    column = np.arange(n)
    if n > most:
        often = np.searchsorted(both, np.concatenate([f_a[np.isin(f_a, both)], f_b[np.isin(f_b, both)]]))
        rank = np.empty(n, np.int64)
        rank[np.argsort(-np.bincount(often, minlength=n), kind="stable")] = np.arange(n)
        own = most // 2
        column = np.where(rank < own, rank, own + rank % (most - own))
    width = max(1, min(n, most))

    def table(rows: int, row: np.ndarray, feature: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(both, feature), max(0, n - 1))
        held = both[at] == feature if n else np.zeros(len(feature), bool)
        return np.bincount(row[held] * width + column[at[held]], minlength=rows * width).reshape(rows, width).astype(np.float32)

    return table(len(a.size), row_a, f_a), table(len(b.size), row_b, f_b)


class Distances:
    """Lower bounds of edit distances between texts of up to WORD characters on the left and any on the right."""

    def __init__(self, a: Texts, b: Texts) -> None:
        known = np.unique(np.concatenate([a.codes, b.codes]))
        self.a, self.b, self.width = a, b, min(CLASSES, len(known)) + 1
        of = lambda t: np.searchsorted(known, t.codes) % CLASSES  # noqa: E731  unlike characters of one class count as equal
        place = np.arange(len(a.codes)) - a.starts[a.row]
        short = place < WORD
        self.masks = np.zeros(len(a.size) * self.width, np.uint64)
        np.bitwise_or.at(self.masks, (a.row * self.width + of(a))[short], np.uint64(1) << place[short].astype(np.uint64))
        self.texts = np.append(of(b), 0)

    def least(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The distance of each pair of a left text, of WORD characters at most, and a right one."""
        out = np.empty(len(i), np.int64)
        for at in range(0, len(i), AT_ONCE):
            out[at : at + AT_ONCE] = self._some(i[at : at + AT_ONCE], j[at : at + AT_ONCE])
        return out

    def _some(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        order = np.argsort(-self.b.size[j], kind="stable")
        i, j = i[order], j[order]
        size_a, size_b = self.a.size[i], self.b.size[j]
        plus, minus = np.full(len(i), ~np.uint64(0)), np.zeros(len(i), np.uint64)
        base, text, one = i * self.width, self.b.starts[j], np.uint64(1)
        active = np.searchsorted(-size_b, -np.arange(size_b[0] if len(i) else 0), side="left")
        for step, n in enumerate(active.tolist()):
            pv, mv = plus[:n], minus[:n]
            eq = self.masks[base[:n] + self.texts[text[:n] + step]]
            xv = eq | mv
            xh = eq & pv
            xh += pv
            xh ^= pv
            xh |= eq
            ph = xh | pv
            np.invert(ph, out=ph)
            ph |= mv
            mh = pv & xh
            ph <<= one
            ph |= one
            mh <<= one
            np.bitwise_and(ph, xv, out=mv)
            xv |= ph
            np.invert(xv, out=xv)
            np.bitwise_or(mh, xv, out=pv)
        used = np.where(size_a > 0, ~np.uint64(0) >> (WORD - np.maximum(size_a, 1)).astype(np.uint64), np.uint64(0))
        found = np.empty(len(i), np.int64)
        found[order] = size_b + np.bitwise_count(plus & used).astype(np.int64) - np.bitwise_count(minus & used).astype(np.int64)
        return found


def maybe_alike(left: list[str], right: list[str], limit: float, half: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places (in left, in right) of all pairs of texts of likeness ``limit`` or more, and perhaps of some others.

    With ``half`` both sides are the same texts, and each pair of two places is found one way round.
    """
    a, b = Texts(left), Texts(right)
    counts_a, counts_b = counted(a, b)
    distances = Distances(a, b)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(a.size), STRIP):
        strip = a.size[at : at + STRIP]
        low = np.searchsorted(b.size, strip[0] - edits(limit, strip[0]))
        high = np.searchsorted(b.size, np.floor((strip[-1] + 1) / limit) + 1, side="right")
        low = max(low, at) if half else low
        if low >= high:
            continue
        # The least number of shared bigrams that any text of the strip needs with each text of the other side.
        every = np.arange(max(strip[-1], b.size[high - 1]) + 1)
        need = every - 1 - 2 * edits(limit, every)
        widths = np.unique(strip)
        least = np.min(need[np.maximum(widths[:, None], b.size[None, low:high])], axis=0) if len(widths) * (high - low) < 1 << 24 else np.full(high - low, need[strip[0] :].min())
        i, j = np.nonzero(counts_a[at : at + STRIP] @ counts_b[low:high].T >= least.astype(np.float32)[None, :])
        i, j = i + at, j + low
        k = edits(limit, np.maximum(a.size[i], b.size[j]))
        kept = (np.abs(a.size[i] - b.size[j]) <= k) & ((i < j) | (not half))
        i, j, k = i[kept], j[kept], k[kept]
        short = a.size[i] <= WORD
        near = np.ones(len(i), bool)
        near[short] = distances.least(i[short], j[short]) <= k[short]
        found.append((i[near], j[near]))
    none = np.zeros(0, np.int64)
    i, j = (np.concatenate([none, *[f[s] for f in found]]) for s in (0, 1))
    return a.order[i], b.order[j]


PAIR = ["block", "tile_a", "tile_b"]


def compare(group: pd.DataFrame) -> pd.DataFrame:
    """(a, b, block) of rows (block, tile_a, tile_b, limit, half, side, id, text): one or more pairs of tiles."""
    found = {"a": [group["id"].to_numpy()[:0]], "b": [group["id"].to_numpy()[:0]], "block": [group["block"].to_numpy()[:0]]}
    for _, rows in group.groupby(PAIR, sort=False):
        half = bool(rows["half"].iloc[0])
        left = rows[rows["side"] == 0]
        right = left if half else rows[rows["side"] == 1]
        i, j = maybe_alike(left["text"].tolist(), right["text"].tolist(), float(rows["limit"].iloc[0]), half)
        found["a"].append(left["id"].to_numpy()[i])
        found["b"].append(right["id"].to_numpy()[j])
        found["block"].append(np.full(len(i), rows["block"].iloc[0]))
    return pd.DataFrame({c: np.concatenate(x) for c, x in found.items()})


def tiled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their tile, (part, n, tiles) of each part) of rows (id, part, text)."""
    parts = rows.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("characters"))
    parts = parts.select("part", "n", F.greatest(F.lit(1), F.ceil(F.col("n") / TILE_ROWS), F.ceil(F.col("characters") / TILE_CHARACTERS)).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("text", "id"), F.col("tiles")).cast("int")
    return rows.join(parts.select("part", "tiles"), "part").select("id", "part", "text", tile.alias("tile")), parts


def pairs_in_blocks(left: DataFrame, right: DataFrame, blocks: DataFrame, ordered: bool = False) -> DataFrame:
    """(a, b, block) of rows (id, part, text) of two tables, where a block (part_a, part_b, block, limit) pairs their parts and the texts may be as alike as its limit.

    With ``ordered`` both tables are one, blocks have part_a <= part_b, and a pair of rows is found one way round.
    """
    (x, parts_x), (y, parts_y) = tiled(left), tiled(right)
    of = lambda parts, end: parts.select(F.col("part").alias(f"part_{end}"), F.col("n").alias(f"n_{end}"), F.col("tiles").alias(f"tiles_{end}"))
    tiles = lambda end: F.explode(F.sequence(F.lit(0), F.col(f"tiles_{end}") - 1)).alias(f"tile_{end}")
    met = blocks.select("part_a", "part_b", "block", "limit").join(of(parts_x, "a"), "part_a").join(of(parts_y, "b"), "part_b").select("*", tiles("a")).select("*", tiles("b"))
    own = (F.col("part_a") == F.col("part_b")) & F.lit(ordered)
    met = met.withColumn("half", own & (F.col("tile_a") == F.col("tile_b"))).filter(~own | ((F.col("tile_a") <= F.col("tile_b")) & (F.col("n_a") > 1)))
    met = cut_lineage(met)
    rows_a, rows_b = F.col("n_a") / F.col("tiles_a"), F.col("n_b") / F.col("tiles_b")
    size = met.agg(F.count("*").alias("n"), F.coalesce(F.sum(rows_a + rows_b), F.lit(0.0)).alias("rows"), F.coalesce(F.sum(rows_a * rows_b), F.lit(0.0)).alias("pairs")).first()
    wanted = max(size["rows"] / TASK_ROWS + size["pairs"] / TASK_PAIRS, min(size["n"], 3 * blocks.sparkSession.sparkContext.defaultParallelism), 1)
    tasks = int(min(MOST_TASKS, wanted))
    known = met.select("part_a", "part_b", *PAIR, "limit", "half", F.pmod(F.xxhash64(*PAIR), F.lit(tasks)).alias("task"))

    def side(rows: DataFrame, end: str, number: int) -> DataFrame:
        asked = known if end == "a" else known.filter("NOT half")
        on = [F.col("part") == F.col(f"part_{end}"), F.col("tile") == F.col(f"tile_{end}")]
        return rows.join(asked, on).select("task", *PAIR, "limit", "half", F.lit(number).alias("side"), "id", "text")

    dealt = side(x, "a", 0).unionByName(side(y, "b", 1)).repartition(tasks, "task")
    kind = left.schema["id"].dataType.simpleString()
    return dealt.groupBy("task").applyInPandas(compare, f"a {kind}, b {kind}, block long")
