"""An index of vectors for the vector arm: coarse cells, residual codes, probes, exact rerank.

``fit`` runs k-means on a bounded sample (``SAMPLE_ROWS`` unit vectors, the same ones each time): first the cells, then
a code book for each group of ``GROUP`` dimensions of what is left of a vector without its cell's center. ``build``
assigns every row to its cell in the task that reads it, as blocks of ids, codes and unit vectors; blocks are
then sorted by cell, so that a search of a few cells skips the others' row groups. A cell that holds a
third of all rows is many blocks.

``search`` takes any number of queries. A task has a group of queries, so few that their nearest are bounded, and one part of the
blocks, dealt evenly however full a cell is; they come one after another, and each is multiplied by those
queries that its cell is near to. Of all its blocks a task gives each query's nearest alone. The nearest by codes of every query are then compared by
their own vectors. The fit finds out on its sample how many probes the recall needs: few where vectors form
clusters, over half of the cells where they don't. With ``exact`` every cell is probed and vectors stand
for codes: then the result is the exact one.

Defined cases: a vector that is null, zero, not finite or not of the model's length has no cosine above zero
with anything, so it is in no block and gets no result. Repeated ids are rows of their own until the rerank, which
keeps the best of each. Of equal cosines the lesser id comes first. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000
MAX_CELLS = 4096
GROUP = 4
CODES = 256
ROUNDS = 12
BLOCK_ROWS = 4096
BLOCK_QUERIES = 256
TUNING_QUERIES, TUNING_TOP, TARGET = 256, 120, 0.96  # of the recall that the number of probes is chosen for
RERANK = 4  # candidates a wanted result, at least
CODES_TARGET = 0.98  # of the neighbours that the number of candidates is chosen for
BLOCK_PAIRS = 1 << 20  # that are multiplied at a time
HELD = 4_000_000  # pairs that a task holds before it keeps each query's nearest alone
WAITING = 1 << 18  # rows that a task of the build holds
EQUAL, EQUAL_DIGITS = 1e-12, 12  # what order of sums makes of equal cosines of double precision
BLOCKS = "cell int, ids array<long>, codes binary, vectors binary"


def unit(vectors: pd.Series | list, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of length one, which of the given ones they are)."""
    fits = np.array([v is not None and len(v) == dims for v in vectors], bool)
    x = np.array([v for v, f in zip(vectors, fits) if f], np.float32).reshape(-1, dims)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        x = (x[good] / norm[good, None]).astype(np.float32)
    return x, np.flatnonzero(fits)[good]


def nearest(x: np.ndarray, centers: np.ndarray, most: int = 1) -> np.ndarray:
    """For each row the ``most`` nearest centers, nearest first."""
    out = []
    for at in range(0, len(x), 8192):
        near = x[at : at + 8192] @ centers.T - (centers**2).sum(axis=1) / 2
        if most == 1 or len(centers) == 1:
            out.append(near.argmax(axis=1)[:, None])
        else:
            out.append(np.argsort(-near, axis=1, kind="stable")[:, :most])
    return np.concatenate(out) if out else np.zeros((0, most), np.int64)


def k_means(x: np.ndarray, k: int, seed: int = 7, rounds: int = ROUNDS) -> np.ndarray:
    """At most ``k`` centers; a center without rows goes to a row far from its own."""
    k = min(k, len(x))
    centers = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centers)[:, 0]
        order, n = np.argsort(own, kind="stable"), np.bincount(own, minlength=k)
        filled = n > 0
        starts = (np.cumsum(n) - n)[filled]
        centers[filled] = np.add.reduceat(x[order], starts, axis=0) / n[filled, None]
        if not filled.all():
            away = ((x - centers[own]) ** 2).sum(axis=1)
            centers[~filled] = x[np.argsort(-away, kind="stable")[: (~filled).sum()]]
    return centers


@dataclass
class Model:
    """Cell centers, and a code book for each group of dimensions (the last group is filled up with zeros)."""

    centers: np.ndarray  # cells x dims
    books: np.ndarray  # groups x codes x GROUP
    probes: int = 1
    rerank: int = RERANK

    @property
    def dims(self) -> int:
        return self.centers.shape[1]

    def grouped(self, residual: np.ndarray) -> np.ndarray:
        return np.pad(residual, ((0, 0), (0, -self.dims % GROUP))).reshape(len(residual), -1, GROUP)

    def encoded(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """A byte a group: the code nearest to the residual."""
        parts = self.grouped(x - self.centers[cells])
        return np.stack([nearest(parts[:, g], book)[:, 0] for g, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def decoded(self, codes: np.ndarray, cell: int) -> np.ndarray:
        parts = np.stack([book[codes[:, g]] for g, book in enumerate(self.books)], axis=1)
        return self.centers[cell] + parts.reshape(len(codes), -1)[:, : self.dims]


def probes_for(x: np.ndarray, centers: np.ndarray, of: int, top: int = TUNING_TOP, target: float = TARGET) -> int:
    """How many cells hold ``target`` of the ``top`` nearest among ``of`` rows, by what a sample of them shows.

    As many neighbours count in the sample as lie within the same distance there.
    """
    asked = x[:TUNING_QUERIES]
    wanted = min(max(len(x) - 1, 1), max(1, round(top * len(x) / max(of, 1))))
    cell, near = nearest(x, centers)[:, 0], asked @ x.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf  # a row is no neighbour of itself
    best = np.argpartition(-near, wanted - 1, axis=1)[:, :wanted]
    place = np.argsort(nearest(asked, centers, len(centers)), axis=1, kind="stable")
    ranks = np.sort(np.take_along_axis(place, cell[best], axis=1).ravel())
    return int(ranks[max(0, -(-int(target * len(ranks) * 1000) // 1000) - 1)]) + 1


def rerank_for(x: np.ndarray, model: Model, of: int, top: int = TUNING_TOP, target: float = CODES_TARGET) -> int:
    """How many candidates by codes a wanted result takes to hold ``target`` of the ``top`` nearest among ``of`` rows, by what a sample of them shows.

    Both the neighbours and the candidates are as many times fewer in the sample as it has fewer rows. The more rows there are, the nearer
    are neighbours to each other and the more candidates lie between them by codes.
    """
    asked, cell = x[:TUNING_QUERIES], nearest(x, model.centers)[:, 0]
    wanted = min(max(len(x) - 1, 1), max(1, round(top * len(x) / max(of, 1))))
    own = (np.arange(len(asked)), np.arange(len(asked)))  # a row is no neighbour of itself
    true = asked @ x.T
    true[own] = -np.inf
    best = np.argpartition(-true, wanted - 1, axis=1)[:, :wanted]
    codes = model.encoded(x, cell)
    coded = model.centers[cell] + np.concatenate([book[codes[:, g]] for g, book in enumerate(model.books)], axis=1)[:, : model.dims]
    near = asked @ coded.T
    near[own] = -np.inf
    rank = np.sort(np.concatenate([len(n) - np.searchsorted(np.sort(n), n[b], side="right") for n, b in zip(near, best)]))
    return max(RERANK, -(-(int(rank[max(0, -(-int(target * len(rank) * 1000) // 1000) - 1)]) + 1) // wanted))


def fit(rows: DataFrame, cells: int | None = None, sample: int = SAMPLE_ROWS, top: int = TUNING_TOP) -> Model:
    """A model from at most ``sample`` vectors (id, vector), drawn by a hash of the id. Their most frequent length counts.

    The numbers of probes and of candidates are those that find ``TARGET`` and ``CODES_TARGET`` of the ``top`` nearest, as far as the sample shows.
    """
    count = rows.count()
    some = rows.filter(F.size("vector") > 0).select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    if cells is None:
        cells = min(MAX_CELLS, max(1, isqrt(count)))
    lengths = some["vector"].map(len)
    dims = int(lengths.mode()[0]) if len(some) else 1
    x, _ = unit(some["vector"], dims)
    if not len(x):
        return Model(np.zeros((1, dims), np.float32), np.zeros((-(-dims // GROUP), 1, GROUP), np.float32))
    model = Model(k_means(x, cells), np.zeros((0, 0, 0), np.float32))
    parts = model.grouped(x - model.centers[nearest(x, model.centers)[:, 0]])
    books = [k_means(np.ascontiguousarray(parts[:, g]), CODES, seed=g) for g in range(parts.shape[1])]
    model.books, model.probes = np.stack(books), probes_for(x, model.centers, count, top)
    model.rerank = rerank_for(x, model, count, top)
    return model


def save(spark: SparkSession, model: Model, path: str) -> None:
    """A model as a table: a row per center and per code."""
    rows = [("probes", 0, 0, [float(model.probes)]), ("rerank", 0, 0, [float(model.rerank)])] + [("center", 0, k, c.tolist()) for k, c in enumerate(model.centers)]
    rows += [("code", g, k, c.tolist()) for g, book in enumerate(model.books) for k, c in enumerate(book)]
    spark.createDataFrame(rows, "kind string, of int, k int, v array<float>").write.parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    rows = spark.read.parquet(path).toPandas().sort_values(["kind", "of", "k"])
    of = lambda kind: rows[rows["kind"] == kind]
    codes = of("code")
    return Model(np.stack(of("center")["v"]).astype(np.float32), np.stack(codes["v"]).astype(np.float32).reshape(codes["of"].nunique(), -1, GROUP), int(of("probes")["v"].iloc[0][0]), int(of("rerank")["v"].iloc[0][0]))


def build(rows: DataFrame, model: Model, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of every row (id, vector), sorted by cell. Rows leave their task as blocks, once."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, waiting, size = shared.value, {}, 0

        def block(cell: int) -> tuple:
            parts = waiting.pop(cell)
            ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            codes = own.encoded(x, np.full(len(x), cell))
            return cell, ids, codes.tobytes(), x.tobytes()

        def frame(found: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(found, columns=["cell", "ids", "codes", "vectors"]).astype({"cell": "int32"})

        for b in batches:
            x, at = unit(b["vector"], own.dims)
            ids, cells, full = b["id"].to_numpy(np.int64)[at], nearest(x, own.centers)[:, 0], []
            for cell in np.unique(cells).tolist():
                here = cells == cell
                waiting.setdefault(cell, []).append((ids[here], x[here]))
                size += int(here.sum())
                if (many := sum(len(p[0]) for p in waiting[cell])) >= block_rows:
                    full.append(block(cell))
                    size -= many
            if full:
                yield frame(full)
            if size > WAITING:
                for cell in sorted(waiting):
                    yield frame([block(cell)])
                size = 0
        for cell in sorted(waiting):
            yield frame([block(cell)])

    blocks = rows.filter(F.col("id").isNotNull()).select("id", F.col("vector").cast("array<float>").alias("vector")).mapInPandas(run, BLOCKS)
    return blocks.repartitionByRange("cell").sortWithinPartitions("cell")


class Group:
    """Some queries, and of the rows that they have met the ``most`` nearest of each."""

    def __init__(self, model: Model, most: int, probes: int, exact: bool) -> None:
        self.model, self.most, self.probes, self.exact = model, most, probes, exact
        self.asked: list[tuple[np.ndarray, np.ndarray]] = []
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.x = 0, None

    def ask(self, names: np.ndarray, x: np.ndarray) -> None:
        self.asked.append((names, x))

    def begin(self) -> None:
        """All queries come before the first rows."""
        self.x = np.concatenate([x for _, x in self.asked])
        self.names, self.place = np.unique(np.concatenate([n for n, _ in self.asked]), return_inverse=True)
        self.bounds = np.full(len(self.names), -np.inf)
        if self.exact:
            self.x = self.x.astype(np.float64)
            return
        cells = len(self.model.centers)
        self.probed = np.zeros((len(self.x), cells), bool)
        for at in range(0, len(self.x), BLOCK_QUERIES):
            near = nearest(self.x[at : at + BLOCK_QUERIES], self.model.centers, min(self.probes, cells))
            np.put_along_axis(self.probed[at : at + BLOCK_QUERIES], near, True, axis=1)

    def meet(self, cell: int, ids: np.ndarray, code: np.ndarray) -> None:
        """Rows of a cell, or with ``exact`` of any."""
        if not self.asked:
            return
        if self.x is None:
            self.begin()
        of = np.arange(len(self.x)) if self.exact else np.flatnonzero(self.probed[:, cell])
        for at in range(0, len(ids) if len(of) else 0, BLOCK_ROWS):
            some = ids[at : at + BLOCK_ROWS]
            part = code[at : at + BLOCK_ROWS]
            x = part.astype(np.float64) if self.exact else self.model.decoded(part, cell)
            step = max(1, BLOCK_PAIRS // len(some))
            for k in range(0, len(of), step):
                self.compare(of[k : k + step], some, x)

    def compare(self, of: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        near = self.x[of] @ x.T
        place = self.place[of]
        least = self.bounds[place]
        if self.most < len(ids) and np.isneginf(least).any():
            least = np.maximum(least, np.partition(near, len(ids) - self.most, axis=1)[:, len(ids) - self.most])
        q, at = np.nonzero(near >= least[:, None] - (EQUAL if self.exact else 0))
        # Equal vectors have equal cosines whatever the order of the sums, so that of them the lesser ids are kept.
        values = near[q, at].round(EQUAL_DIGITS) if self.exact else near[q, at]
        self.held.append((place[q], ids[at], values.astype(np.float64)))
        self.size += len(q)
        if self.size > HELD:
            self.keep()

    def keep(self) -> None:
        """What is held, the nearest of each query alone; the last one's nearness bounds what can follow."""
        place, ids, near = (np.concatenate([h[k] for h in self.held]) for k in range(3))
        self.held.clear()
        order = np.argsort(place.astype(np.uint16) if len(self.names) <= 1 << 16 else place, kind="stable")
        place, ids, near = place[order], ids[order], near[order]
        ends = np.searchsorted(place, np.arange(len(self.names)), side="right")
        kept = np.ones(len(place), bool)
        for q in np.flatnonzero(np.diff(ends, prepend=0) >= self.most).tolist():
            own = slice(ends[q - 1] if q else 0, ends[q])
            values = near[own]
            self.bounds[q] = bound = np.partition(values, len(values) - self.most)[len(values) - self.most]
            kept[own] = values >= bound
            equal = np.flatnonzero(values == bound)
            if (spare := int(np.count_nonzero(kept[own])) - self.most) > 0:
                kept[own][equal[np.argsort(ids[own][equal], kind="stable")[len(equal) - spare :]]] = False
        self.held, self.size = [(place[kept], ids[kept], near[kept])], int(np.count_nonzero(kept))

    def best(self) -> Iterator[pd.DataFrame]:
        if self.size:
            self.keep()
            place, ids, near = self.held[0]
            starts = np.flatnonzero(np.diff(place, prepend=-1))
            ends = np.append(starts[1:], len(place))
            for at in range(0, len(starts), BLOCK_QUERIES):
                own = list(zip(starts[at : at + BLOCK_QUERIES], ends[at : at + BLOCK_QUERIES]))
                yield pd.DataFrame({"query": self.names[place[starts[at : at + BLOCK_QUERIES]]], "ids": [ids[s:e] for s, e in own], "near": [near[s:e] for s, e in own]})


def _first(found: DataFrame, most: int) -> DataFrame:
    """(query, id) of the ``most`` nearest of each query, from rows (query, ids, near) that hold the nearest of a part each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query, held = None, []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            ids, near = (np.concatenate([h[k] for h in held]) for k in range(2))
            ids = np.unique(ids[np.lexsort((ids, -near))[:most]])
            return np.full(len(ids), query), ids

        for b in batches:
            done = []
            for name, ids, near in zip(b["query"], b["ids"], b["near"]):
                if name != query and held:
                    done.append(merged())
                    held = []
                query = name
                held.append((ids, near))
            if done:
                yield pd.DataFrame({"query": np.concatenate([d[0] for d in done]), "id": np.concatenate([d[1] for d in done])})
        if held:
            yield pd.DataFrame(dict(zip(("query", "id"), merged())))

    return found.repartition("query").sortWithinPartitions("query").mapInPandas(run, "query long, id long")


def _vectors(queries: DataFrame, dims: int) -> DataFrame:
    """(query, asked) of queries (query, vector) that have a cosine: their unit vectors as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, at = unit(b["vector"], dims)
            yield pd.DataFrame({"query": b["query"].to_numpy()[at], "asked": [v.tobytes() for v in x]})

    return queries.filter("query IS NOT NULL").select(F.col("query").cast("long").alias("query"), F.col("vector").cast("array<float>").alias("vector")).mapInPandas(run, "query long, asked binary")


def _met(blocks: DataFrame, queries: DataFrame, dims: int, most: int, exact: bool) -> DataFrame:
    """(slot, row, cell, ids, code): queries, then blocks, by slot. Every query meets every block in one slot.

    A slot's queries are so few that their nearest are within HELD, its blocks come one after another. The fewer groups of
    queries there are, the more parts have the blocks, so that all cores have work; a group's nearest leave each of these parts.
    """
    groups = max(1, -(-queries.count() * 2 * most // HELD))
    parts = max(1, -(-2 * queries.sparkSession.sparkContext.defaultParallelism // groups))
    part_of, group_of = F.pmod(F.xxhash64("cell", F.get("ids", F.lit(0))), F.lit(parts)), F.pmod(F.xxhash64("query"), F.lit(groups))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    code = F.col("vectors" if exact else "codes").alias("code")
    own = blocks.select("cell", "ids", code, part_of.alias("part"), each(groups).alias("group"))
    asking = _vectors(queries, dims).select(F.lit(0).alias("cell"), F.array("query").alias("ids"), F.col("asked").alias("code"), group_of.alias("group"), each(parts).alias("part"))
    slot = (F.col("part") * groups + F.col("group")).cast("int").alias("slot")
    both = asking.select(slot, F.lit(False).alias("row"), "cell", "ids", "code").unionByName(own.select(slot, F.lit(True).alias("row"), F.lit(0).alias("cell") if exact else "cell", "ids", "code"))
    # More partitions than slots, as two slots of one hash are one task.
    return both.repartition(4 * parts * groups, "slot").sortWithinPartitions("slot", "row", "cell")


def scored(pairs: DataFrame) -> DataFrame:
    """(query, id, score) of pairs (query, id, asked, vector): ``text.cosine`` of both vectors to the last bit, as sums go in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, sizes = [], []
            for column in (b.column("asked"), b.column("vector")):
                flat.append(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                sizes.append(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            starts = [np.cumsum(n) - n for n in sizes]
            score = np.zeros(len(b))
            for n in np.unique(sizes[0][sizes[0] == sizes[1]]).tolist():
                own = np.flatnonzero((sizes[0] == n) & (sizes[1] == n))
                sums = [np.zeros(len(own)) for _ in range(3)]
                with np.errstate(all="ignore"):
                    for k in range(n):
                        x, y = flat[0][starts[0][own] + k], flat[1][starts[1][own] + k]
                        for total, part in zip(sums, (x * y, x * x, y * y)):
                            total += part
                    value = sums[0] / (np.sqrt(sums[1]) * np.sqrt(sums[2]))
                    score[own] = np.where(np.abs(value) <= 2, value, 0.0)
            yield pa.RecordBatch.from_arrays([b.column("query"), b.column("id"), pa.array(score)], ["query", "id", "score"])

    kinds = dict(pairs.dtypes)
    given = [F.col(c) if kinds[c] == "array<float>" else F.col(c).cast("array<double>").alias(c) for c in ("asked", "vector")]
    return pairs.select(F.col("query").cast("long").alias("query"), F.col("id").cast("long").alias("id"), *given).mapInArrow(run, "query long, id long, score double")


def search(blocks: DataFrame, model: Model, rows: DataFrame, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, rerank: int | None = None) -> DataFrame:
    """(query, id, score) of the ``k`` rows (id, vector) of largest cosine above 0 for each query (query, vector).

    ``probes``: how many cells a query looks into, by default as many as the model found to suffice; so for ``rerank``, the candidates
    a wanted result. ``exact``: all cells, and vectors stand for codes.
    """
    shared, most = rows.sparkSession.sparkContext.broadcast(model), k * max(rerank or (RERANK if exact else model.rerank), 2)
    looked = probes or model.probes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, slot, group = shared.value, None, None
        for b in batches:
            keys = np.stack([b[c].to_numpy(np.int64) for c in ("slot", "row", "cell")], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else []
            for s, e in zip(starts, np.append(starts[1:], len(keys))):
                if slot != keys[s, 0]:
                    if group is not None:
                        yield from group.best()
                    slot, group = keys[s, 0], Group(own, most, looked, exact)
                ids, data = np.concatenate(b["ids"].iloc[s:e].to_list()), b"".join(b["code"].iloc[s:e])
                if keys[s, 1]:
                    group.meet(int(keys[s, 2]), ids, np.frombuffer(data, np.float32 if exact else np.uint8).reshape(len(ids), -1))
                else:
                    group.ask(ids, np.frombuffer(data, np.float32).reshape(len(ids), -1))
        if group is not None:
            yield from group.best()

    found = _met(blocks, queries, model.dims, most, exact).mapInPandas(run, "query long, ids array<long>, near array<double>")
    first = _first(found, most)
    asked = queries.select("query", F.col("vector").alias("asked"))
    own = scored(first.join(rows.select("id", "vector"), "id").join(asked, "query"))
    best = own.filter("score > 0").groupBy("query", "id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return best.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= k).drop("_r")
