"""Findings of round 4."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from grantlake.operators import ann, postings


def unit_vectors(rows: int, dims: int, seed: int = 3) -> np.ndarray:
    x = np.random.default_rng(seed).normal(size=(rows, dims)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1)[:, None]


def plain_model(x: np.ndarray, cells: int) -> ann.Model:
    model = ann.Model(ann.k_means(x, cells), np.zeros((0, 0, 0), np.float32))
    parts = model.grouped(x - model.centers[ann.nearest(x, model.centers)[:, 0]])
    model.books = np.stack([ann.k_means(np.ascontiguousarray(parts[:, g]), 16, seed=g) for g in range(parts.shape[1])])
    return model


def test_copies_of_a_title_are_expanded_in_bounded_pieces(spark):
    """a title that very many rows share makes no row with all its pairs."""
    rows = spark.range(70_000).select("id", F.when(F.col("id") % 7 == 0, "red bolt").otherwise("red ring").alias("title"))
    blocks = postings.title_blocks(rows)
    asked = postings.title_blocks(rows.filter("id % 50 = 0"), postings.QUERY_RANGE_BITS)
    found = postings.similar_titles(postings.gram_index(postings.classes(blocks)), postings.classes(asked).withColumnRenamed("id", "query"))
    met = postings.met_blocks(found, blocks, asked)
    most, all_pairs = met.agg(F.max(F.size("queries") * F.size("ids")), F.sum(F.size("queries").cast("long") * F.size("ids"))).first()
    assert all_pairs == 1400 * 70_000
    assert most <= postings.ROW_QUERIES * postings.ROW_IDS
    assert postings.with_copies(found, blocks, asked).filter("query <= 50").agg(F.count("*"), F.count_distinct("query", "id")).first() == (2 * 70_000, 2 * 70_000)


def test_similarities_are_rounded_before_copies_are_expanded(spark):
    """once a pair of different titles, not once a pair of rows."""
    from grantlake.queries import QUERIES

    plan = QUERIES["trigram_index"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan[: plan.index("Repartition")]
    assert "round(" in plan


def test_a_query_is_dealt_once_a_part_however_many_cells_there_are(spark):
    """before, each query was copied to each of its cells, all of a task's at once."""
    x = unit_vectors(3000, 16)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<float>").cache()
    queries = rows.filter("id % 50 = 0").select(F.col("id").alias("query"), "vector")
    for cells in (4, 200):
        model = plain_model(x, cells)
        met = ann._met(ann.build(rows, model), queries, model.dims, 40, exact=True).cache()
        slots = met.agg(F.max("slot")).first()[0] + 1
        assert met.filter("NOT row").count() == 60 * slots  # one group of queries
        assert slots <= 2 * spark.sparkContext.defaultParallelism
        assert met.filter("row").agg(F.sum(F.size("ids"))).first()[0] == 3000
        assert met.groupBy("slot").agg(F.sum(F.when(F.col("row"), F.size("ids")))).count() == slots


def test_of_equal_vectors_the_least_ids_are_found(spark):
    """also where more rows are equal than a task keeps."""
    x = unit_vectors(2000, 16)
    x[::3] = x[0]
    ids = np.random.default_rng(1).permutation(2000)
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, vector array<float>").cache()
    query = rows.filter(f"id = {ids[0]}").select(F.col("id").alias("query"), "vector")
    model = plain_model(x, 8)
    found = {r.id for r in ann.search(ann.build(rows, model, block_rows=64), model, rows, query, 5, exact=True).collect()}
    assert found == set(np.sort(ids[::3])[:5].tolist())


def test_a_group_holds_a_bounded_number_of_pairs(monkeypatch):
    """what a task holds is bounded however many rows come, and the nearest are those of a plain sort."""
    monkeypatch.setattr(ann, "HELD", 3000)
    x = unit_vectors(4000, 16)
    x[5::7] = x[5]
    model, most = plain_model(x, 6), 20
    cell = ann.nearest(x, model.centers)[:, 0]
    for exact in (True, False):
        group = ann.Group(model, most, 6, exact)
        group.ask(np.arange(70), x[:70])
        for c in range(6):
            for at in range(0, len(x), 50):
                own = at + np.flatnonzero(cell[at : at + 50] == c)
                if len(own):
                    group.meet(c, own, x[own] if exact else model.encoded(x[own], cell[own]))
                    assert group.size <= 3000
        got = {int(q): sorted(i.tolist()) for b in group.best() for q, i in zip(b["query"], b["ids"])}
        assert {len(i) for i in got.values()} == {most}
        if exact:
            near = (x[:70].astype(np.float64) @ x.astype(np.float64).T).round(12)
            assert got == {q: sorted(np.lexsort((np.arange(len(x)), -near[q]))[:most].tolist()) for q in range(70)}


def test_a_build_holds_a_bounded_number_of_rows(spark, monkeypatch):
    """blocks that wait for more rows of their cell go when there are many."""
    monkeypatch.setattr(ann, "WAITING", 100)
    x = unit_vectors(3000, 16)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<float>").repartition(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    try:
        blocks = ann.build(rows, plain_model(x, 5)).cache()
        assert blocks.agg(F.max(F.size("ids"))).first()[0] <= 300
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.id for r in blocks.select(F.explode("ids").alias("id")).collect()) == list(range(3000))


def test_both_ways_of_a_search_share_one_index(spark, monkeypatch):
    """F2: ann_recall fitted and built the same index twice."""
    from grantlake.queries import QUERIES

    built, build = [], ann.build
    monkeypatch.setattr(ann, "build", lambda *a: built.append(a) or build(*a))
    row = QUERIES["ann_recall"](spark, "/root/testdata/sf0.01").first()
    assert (row.queries, row.wanted, row.enough) == (10, 1200, True)
    assert len(built) == 1


def test_scores_of_pairs_are_the_cosine_to_the_last_bit(spark):
    """F2, F3: the candidates' scores, by arrays instead of an array function a pair."""
    from grantlake.functions.text import cosine

    x = np.random.default_rng(4).normal(size=(400, 33)).astype(np.float32).tolist()
    odd = [None, [], [0.0] * 33, [1.0], [float("nan")] * 33, [float("inf")] * 33, [None] + [1.0] * 32, [3e38] * 33, [1e-45] * 33]
    vectors = x + odd * 3
    other = vectors[::-1]
    for kind in ("float", "double"):
        pairs = spark.createDataFrame([(k, -k, a, b) for k, (a, b) in enumerate([*zip(vectors, other), *((a, b) for a in odd for b in odd)])], f"query long, id long, asked array<{kind}>, vector array<{kind}>")
        want = {(r.query, r.id): r.s for r in pairs.select("query", "id", cosine(F.col("asked"), F.col("vector")).alias("s")).collect()}
        assert {(r.query, r.id): r.score for r in ann.scored(pairs).collect()} == want


def test_a_row_is_no_neighbour_of_itself_in_the_fit_of_probes():
    """F2: where the sample holds few neighbours of a row, the row itself made up the recall: one probe would have sufficed for one neighbour."""
    x = unit_vectors(3000, 16)
    assert ann.probes_for(x, ann.k_means(x, 50), 10**6) > 3
    assert ann.probes_for(x[:1], x[:1], 10**6) == 1
