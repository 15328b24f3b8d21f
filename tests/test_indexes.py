"""Indexes, the keyed store and the dictionary match against plain versions of what they answer."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grantlake.operators import ann, dictionary, postings
from grantlake.sources.keyed import KeyedStore
from grantlake.streaming.upsert import merge_into

LARGER = "/root/testdata/sf0.1"


def clustered(rows: int, dims: int, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(20, dims))[rng.integers(0, 20, rows)] + 0.6 * rng.normal(size=(rows, dims))).astype(np.float32)


@pytest.fixture(scope="module")
def vectors(spark):
    x = clustered(3000, 10)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(9000, None), (9001, [0.0] * 10), (9002, [1.0]), (9003, [float("nan")] * 10), (9004, [float("inf")] * 10), (None, [1.0] * 10), (5, rows[6][1])]
    return spark.createDataFrame(rows + odd, "id long, vector array<float>").cache()


def best(vectors, k: int) -> dict[int, list[int]]:
    usable = [(r.id, np.array(r.vector)) for r in vectors.collect() if r.id is not None and r.id < 9000]
    ids, x = np.array([i for i, _ in usable]), np.stack([v / np.sqrt(v @ v) for _, v in usable])
    asked, out = {}, {}
    for q in np.flatnonzero(ids % 50 == 0):
        asked[int(ids[q])] = x @ x[q]
    for q, near in asked.items():
        score = {}
        for i, s in zip(ids.tolist(), near.tolist()):
            score[i] = max(s, score.get(i, -2))
        out[q] = [i for i, s in sorted(score.items(), key=lambda z: (-round(z[1], 12), z[0])) if s > 0][:k]
    return out


def test_all_cells_give_the_exact_neighbours(spark, vectors, tmp_path):
    model = ann.fit(vectors, cells=24)
    ann.save(spark, model, f"{tmp_path}/model")
    again = ann.load(spark, f"{tmp_path}/model")
    assert np.array_equal(model.centers, again.centers)
    assert np.array_equal(model.books, again.books)
    assert model.probes == again.probes
    ann.build(vectors, again, block_rows=64).write.parquet(f"{tmp_path}/blocks")
    blocks = spark.read.parquet(f"{tmp_path}/blocks")
    assert blocks.agg(F.sum(F.size("ids"))).first()[0] == 3001
    queries = vectors.filter("id % 50 = 0").select(F.col("id").alias("query"), "vector")
    found = {}
    for r in ann.search(blocks, again, vectors, queries, 30, exact=True).collect():
        found.setdefault(r.query, []).append((-round(r.score, 12), r.id))
    wanted = best(vectors, 30)
    assert {q: [i for _, i in sorted(x)] for q, x in found.items()} == wanted
    some = {(r.query, r.id) for r in ann.search(blocks, again, vectors, queries, 30).collect()}
    every = {(q, i) for q, x in wanted.items() for i in x}
    assert model.probes < 24
    assert len(some & every) >= 0.9 * len(every)


def test_no_vectors_no_neighbours(spark, vectors):
    none = vectors.limit(0)
    model = ann.fit(none)
    assert ann.build(none, model).count() == 0
    assert ann.search(ann.build(none, model), model, none, none.select(F.col("id").alias("query"), "vector"), 3).count() == 0


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no driver tables here")
def test_recall_on_the_table(spark):
    from grantlake.queries import QUERIES

    exact, near = ({(r.query, r.id) for r in QUERIES[q](spark, LARGER).collect()} for q in ("exact_top120", "ann_top120"))
    assert len(exact & near) >= 0.9 * len(exact)


@given(st.lists(st.integers(0, 1 << 60)))
def test_numbers_in_groups_of_bits(x):
    assert postings.unpack_numbers(postings.pack_numbers(np.array(x, np.uint64))).tolist() == x
    own = np.array(sorted(set(x)), np.int64)
    assert postings.unpack_sorted(postings.pack_sorted(own)).tolist() == own.tolist()


@pytest.mark.parametrize("places", [[], [0], [65535], list(range(65536)), list(range(0, 65536, 2)), list(range(5000)), [1, 2, 3, 9, 65534, 65535], list(range(0, 65536, 7))])
def test_bits_of_a_range(places):
    block = postings.pack_bits(np.array(places, np.int64))
    assert np.flatnonzero(postings.unpack_bits(block)).tolist() == places
    assert len(block) <= 1 + min(2 * len(places), 8192)


def test_titles_by_grams_equal_a_scan(spark):
    from grantlake.functions.text import trigram_similarity

    rng = random.Random(2)
    words = ["small", "red", "ring", "bolt", "Ünïcode", "지원금", "청년", "x", "a1"]
    rows = [(k * 9001, " ".join(rng.choices(words, k=rng.randrange(0, 5)))) for k in range(300)] + [(7, None), (8, ""), (9, "..."), (None, "red ring"), (-5, "red ring"), (10, "red"), (10, "blue")]
    titles = spark.createDataFrame(rows, "id long, title string")
    queries = spark.createDataFrame([(1, "small red ring"), (2, "지원금 청년"), (3, ""), (4, None), (5, "zzz"), (6, "ring " * 40)], "query long, title string")
    index = postings.gram_index(titles)
    least = titles.filter("id IS NOT NULL").groupBy("id").agg(F.min("title").alias("title"))
    for limit in (0.2, 0.0, 0.6):
        got = {(r.query, r.id, round(r.similarity, 9)) for r in postings.similar_titles(index, queries, limit).collect()}
        pairs = least.crossJoin(queries.withColumnRenamed("title", "asked")).withColumn("s", trigram_similarity(F.coalesce("title", F.lit("")), F.coalesce("asked", F.lit(""))))
        assert got == {(r.query, r.id, round(r.s, 9)) for r in pairs.filter(F.col("s") > limit).collect()}
    touched = {r.query: r.touched for r in postings.candidates(index, queries).collect()}
    assert set(touched) == {1, 2, 6}
    assert postings.gram_index(titles.limit(0)).count() == 0


def test_bitmaps_equal_array_overlap(spark):
    rng = random.Random(3)
    rows = [(k * 331 - 1000, rng.choices(["a", "b", "c", "hot"], k=rng.randrange(4)) + ["hot"] * (k % 3 == 0), rng.choice(["x", "y", "", None])) for k in range(1000)]
    rows += [(None, ["a"], "x"), (10**12, None, "x"), (5, ["a"], "x"), (5, ["b"], "y")]
    data = spark.createDataFrame(rows, "id long, keywords array<string>, category string")
    asked = [(1, ["a", "b"], []), (2, ["hot"], ["x"]), (3, [], ["x"]), (4, ["none"], None), (5, ["c", "c"], ["y", "z"])]
    got = {(r.query, r.id) for r in postings.matching_rows(postings.bitmap_index(data), spark.createDataFrame(asked, "query long, words array<string>, categories array<string>")).collect()}
    merged = {}
    for i, w, c in rows:
        if i is not None:
            of = merged.setdefault(i, (set(), set()))
            of[0].update(w or [])
            of[1].add(c or "")
    assert got == {(q, i) for q, w, c in asked for i, (own, cats) in merged.items() if own & set(w) and (not c or cats & {*c, ""})}


@settings(max_examples=60, deadline=None)
@given(st.text("abé\U0001f600", max_size=80), st.integers(0, 70), st.integers(1, 40))
def test_an_entry_is_known_wherever_it_stands(text, at, size):
    entry = text[at : at + size]
    if not entry:
        return
    k, h, place = dictionary.anchor(entry)
    _, window, run = dictionary.size_class(len(entry))
    hashes = dictionary.Rolling(text).windows(window, k)
    found = dictionary.minimizers(hashes, run)
    assert at + place in found.tolist()
    assert int(hashes[at + place].view(np.int64)) == h
    plain = [p for p in range(len(hashes)) if any(hashes[p] == hashes[s : s + run].min() for s in range(max(0, p - run + 1), min(p, len(hashes) - run) + 1))]
    assert found.tolist() == plain


@pytest.mark.parametrize("most", [10, 0])
def test_dictionary_equals_contains(spark, most):
    rng = random.Random(5)
    base = "".join(rng.choices("abcd \n", k=3000))
    entries = [base[p : p + n] for p, n in zip(rng.sample(range(2500), 40), [1, 2, 3, 5, 8, 17, 64, 65, 127, 300] * 4)] + ["", None, "zzz", "aa", "é😀", "aa"]
    texts = [base, base[::-1], base[:70], "", None, "aaaa", "x é😀é😀", base[1000:1400] * 3]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(0, base), (None, base)], "id long, text string")
    known = spark.createDataFrame([(k, t) for k, t in enumerate(entries)], "entry long, text string")
    got = sorted((r.id, r.entry, r["at"]) for r in dictionary.occurrences(docs, known, most).collect())
    wanted = []
    for i, t in [*enumerate(texts), (0, base)]:
        for e, x in enumerate(entries):
            wanted += [(i, e, p) for p in range(len(t or "")) if x and (t or "").startswith(x, p)]
    assert got == sorted(wanted)
    assert dictionary.occurrences(docs.limit(0), known).count() == dictionary.occurrences(docs, known.limit(0)).count() == 0


def files_of(path) -> dict[str, float]:
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_an_upsert_leaves_other_buckets_alone(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/store")
    assert store.versions() == []
    with pytest.raises(ValueError, match="nothing"):
        store.read()
    rows = spark.range(1000).select("id", F.concat(F.lit("v"), "id").alias("value"))
    first = store.upsert(rows.union(spark.createDataFrame([(None, "none")], "id long, value string")), batch=0, buckets=32)
    before = files_of(f"{tmp_path}/store/data")
    changed = spark.createDataFrame([(3, "new"), (2000, "added"), (None, "other")], "id long, value string")
    second = store.upsert(changed, batch=1)
    touched = {b for b in second.folders if second.folders[b] != first.folders.get(b)}
    assert 1 <= len(touched) <= 3
    now = files_of(f"{tmp_path}/store/data")
    assert {f: t for f, t in now.items() if f in before} == before
    assert len(now) - len(before) == len(touched)
    again = files_of(f"{tmp_path}/store")
    store.upsert(changed.withColumn("value", F.lit("twice")), batch=1)
    assert files_of(f"{tmp_path}/store") == again
    values = {r.id: r.value for r in store.read().collect()}
    assert values == {**{k: f"v{k}" for k in range(1000)}, 3: "new", 2000: "added", None: "other"}
    assert {r.id: r.value for r in store.read(first.version).collect()}[3] == "v3"
    assert [r.value for r in store.get(3).collect()] == ["new"]
    assert len(store.get(3).inputFiles()) == 1
    assert sorted(r.value for r in store.get(4, None, -1).collect()) == ["other", "v4"]
    asked = spark.createDataFrame([(5,), (5,), (2000,), (None,)], "id long")
    assert sorted(r.value for r in store.get_all(asked).collect()) == ["added", "other", "v5"]
    assert [r.id for r in store.page(None, 3).collect()] == [0, 1, 2]
    assert [r.id for r in store.page(998, 3).collect()] == [999, 2000]
    with pytest.raises(ValueError, match="once"):
        store.upsert(changed.union(changed), batch=2)


def test_what_no_manifest_has_is_removed(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/store")
    rows = spark.range(100).withColumn("value", F.lit("a"))
    for k in range(4):
        store.upsert(rows.filter(f"id < {100 - k}").withColumn("value", F.lit(f"v{k}")), buckets=4)
    rows.write.parquet(f"{tmp_path}/store/data/v9-failed/bucket=0")
    (tmp_path / "store/manifest/v=9").mkdir()
    assert store.versions() == [0, 1, 2, 3]
    gone = store.vacuum(keep=2)
    assert "data/v9-failed" in gone
    assert "manifest/v=0" in gone
    assert store.versions() == [2, 3]
    assert {r.value for r in store.read(2).collect()} == {"v0", "v1", "v2"}
    assert store.read().count() == 100
    store.upsert(rows.limit(0))
    assert store.read().count() == 100


def test_a_stream_goes_into_the_store(spark, tmp_path):
    path, rows = f"{tmp_path}/store", "id long, last_modified string, ordinal long, value string"
    run = merge_into(path, buckets=8)
    run(spark.createDataFrame([(1, "2026-01-01", 1, "a"), (1, "2026-01-02", 0, "b"), (2, None, 3, "c")], rows), 0)
    run(spark.createDataFrame([(2, None, 4, "d"), (3, None, 5, "e")], rows), 1)
    run(spark.createDataFrame([(2, None, 4, "again")], rows), 1)
    assert {r.id: r.value for r in KeyedStore(spark, path).read().collect()} == {1: "b", 2: "d", 3: "e"}
