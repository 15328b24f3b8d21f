"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names, for every operator and stage."""

from __future__ import annotations

import hashlib
import os

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__

if not os.path.exists(os.path.join(os.path.dirname(__spark_entry__.__file__), "corpus_pipeline.py")):
    pytest.skip("the pipeline isn't here", allow_module_level=True)

import corpus_pipeline
from grantlake.llm.queries import QUERIES

#: Queries with a row or more for every document.
BY_DOCUMENT = [name for name in QUERIES if not name.startswith(("op12_", "op13_"))]
LONG = " ".join(f"word{k % 977} number{k}." for k in range(30000))
PLAIN = "One plain text with quite ordinary words that says little, " + " ".join(f"w{k}" for k in range(80))
ROWS = [
    (1, PLAIN, "en", "s", 100), (1, PLAIN, "en", "s", 100), (2, PLAIN + " more", None, None, None), (3, None, "en", "s", None), (4, "", "en", "s", 0),
    (5, " \n\t", "de", "t", 3), (None, "no id: a@b.co +1 555 123 4567", None, "t", 29), (None, None, None, None, None), (7, LONG, "en", "s", len(LONG)),
    (8, "x" * 50_000, "en", "s", 50_000), (9, "é" * 9 + "😀 한글　\x00 ²@³(at)", "fr", "", 20), (10, "two words", "es", "u", 9), (1 << 53, "10.0.0.1 4111 1111 1111 1111", "en", "u", 28),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "same turn"), (1, 1, "assistant", "same turn"), (2, None, "system", ""), (2, 5, None, "no role"), (2, 6, "tool </role>", "x"),
    (None, 0, "user", "no id"), (None, 1, "assistant", "</turn>\n### User: <|endoftext|> \\"), (3, 0, "assistant", "word " * 60_000), (4, 0, None, None),
]
#: Names that operators use for themselves.
CLASHING = ["row_id", "host", "_id", "_text", "fp", "id", "a", "b", "block", "part", "piece", "length", "rank", "score", "positive", "y", "removed", "component_id", "_n", "_p"]


def written(spark, folder, rows, labels=((1, 1, 0), (2, 0, 0), (3, None, None), (None, 1, 1), (7, 1, 0), (8, 0, 0), (10, 0, 0), (10, 0, 0))):
    docs = spark.createDataFrame(rows, DOCS)
    docs.select("*", *[F.lit(f"{c}!").alias(c) for c in CLASHING]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    turns = TURNS if rows else []
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").select("*", *[F.lit(f"{c}!").alias(c) for c in CLASHING if c != "part"]).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("edges"), ROWS)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("nothing"), [], [])


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_every_row_has_its_result(spark, edges, name):
    rows = QUERIES[name](spark, edges).collect()
    found = [r.doc_id for r in rows if not ("piece" in r and r.piece)]
    assert sorted(found, key=str) == sorted((r[0] for r in ROWS), key=str)
    if name.startswith(("op2", "op8")):
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("op13_")])
def test_empty_table(spark, nothing, name):
    assert QUERIES[name](spark, nothing).collect() == []


def test_empty_conversations(spark, nothing):
    assert [r.conv_id for r in QUERIES["op13_chat"](spark, nothing).collect()] == [-7]


def test_equal_and_empty_texts(spark, edges):
    classes = {r.doc_id: r for r in QUERIES["op1_simhash"](spark, edges).collect() if r.doc_id}
    assert {classes[k].component_id for k in (3, 4, 5)} == {3}
    assert classes[3].fingerprint == "0" * 16
    prints = {r.doc_id: r.fingerprint for r in QUERIES["op6_paragraph_sketches"](spark, edges).collect()}
    assert prints[3] == prints[4]
    figures = {r.doc_id: r for r in QUERIES["op10_quality_rules"](spark, edges).collect()}
    assert (figures[4].n_words, figures[4].base_failed, figures[4].kept) == (0, True, False)
    assert figures[1].kept and figures[7].kept
    ends = {r.doc_id: r for r in QUERIES["op7_token_files"](spark, edges).collect()}
    assert ends[4].n_tokens == ends[3].n_tokens == 1


def test_scores_of_repeated_rows_are_equal(spark, edges):
    for name, column in (("op2_quality_classifier", "score"), ("op3_context_tree", "score"), ("op5_pii", "spans"), ("op9_piece_lattice", "ids_crc32")):
        a, b = (r[column] for r in QUERIES[name](spark, edges).filter("doc_id = 1").collect())
        assert a == b


def test_long_texts_are_cut_behind_a_shorter_piece(spark, edges):
    rows = sorted((r for r in QUERIES["op4_best_fit_packing"](spark, edges).collect() if r.doc_id == 7), key=lambda r: r.piece)
    assert len(rows) > 10
    assert all(r.length == 2048 for r in rows[1:])
    assert [r.start for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]


@pytest.mark.parametrize("stage", [k for k, _ in enumerate(corpus_pipeline.STAGES[:-1])])
@pytest.mark.parametrize("folder", ["edges", "nothing"])
def test_stages_return_the_columns_of_documents(spark, request, stage, folder):
    path = request.getfixturevalue(folder)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = corpus_pipeline.STAGES[stage][1](spark, docs, path)
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r._text == "_text!" and r.host == "host!" for r in rows)
    assert len(rows) <= docs.count()


def test_pipeline_gives_every_kept_document_a_place(spark, edges, nothing):
    rows = corpus_pipeline.run(spark, edges).collect()
    assert {r.doc_id for r in rows} >= {7}
    assert {3, 4, 5}.isdisjoint(r.doc_id for r in rows)
    assert corpus_pipeline.run(spark, nothing).collect() == []


def test_the_last_stage_ignores_clashing_columns(spark, edges, nothing):
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    out = corpus_pipeline.pack_sequences(spark, docs, edges)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert sum(r.piece == 0 for r in out.collect()) == len(ROWS)
    assert corpus_pipeline.pack_sequences(spark, spark.read.parquet(f"{nothing}/documents.parquet"), nothing).collect() == []


def test_rows_without_an_id_are_judged_each(spark, edges):
    docs = spark.createDataFrame([(None, PLAIN, "en", "s", 1), (None, "a b c " * 40, "en", "s", 1), (1, PLAIN, "en", "s", 1), (1, "a b c " * 40, "en", "s", 1)], DOCS)
    assert sorted(map(str, (r.doc_id for r in corpus_pipeline.drop_low_quality(spark, docs, edges).collect()))) == ["1", "None"]


def test_texts_that_tokens_cant_give_back_have_none(spark, edges, tmp_path):
    found = {r.doc_id: r for r in QUERIES["op11_alignment"](spark, edges).collect()}
    for k in (3, 4):
        assert (found[k].n_a, found[k].n_b, found[k].n_links, found[k].count_sum, found[k].groups_sha256) == (0, 0, 0, 0, "")
    assert found[7].n_groups > 50_000
    path = written(spark, tmp_path, [(1, "a \u2581 b", "en", "s", 5), (2, "a b", "en", "s", 3)])
    found = {r.doc_id: r for r in QUERIES["op11_alignment"](spark, path).collect()}
    assert found[1].n_a == found[1].n_groups == 0
    assert found[2].n_groups == 2


def test_every_turn_is_read_back(spark, edges):
    found = {r.conv_id: r for r in QUERIES["op13_chat"](spark, edges).collect()}
    assert set(found) == {1, 2, 3, 4, None, -7}
    assert (found[1].n_turns, found[2].n_turns, found[None].n_turns, found[4].n_turns) == (4, 3, 2, 1)
    assert (found[1].loss_chars, found[3].loss_chars, found[4].loss_chars) == (18, 300_000, 0)
    assert found[1].turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\n\nassistant\nsame turn\nassistant\nsame turn\n").hexdigest()
    assert found[2].turns_sha256 == hashlib.sha256(b"system\n\n\nno role\ntool </role>\nx\n").hexdigest()


def test_langs_and_texts_without_words(spark, tmp_path):
    docs = [(k, "Ab ab\tcd. ab  cd", None, "s", 1) for k in range(10)] + [(None, None, "en", "s", 1), (None, " .,\n", "en", "s", 1), (1, "é\x00 é\x00, " * 12, "en", "s", 1)]
    rows = [tuple(r) for r in QUERIES["op12_phrases"](spark, written(spark, tmp_path, docs)).orderBy("lang", "rank").collect()]
    assert rows == [("en", 1, "é\x00 é\x00", 12, 24, 24, 24, 250_000), ("und", 1, "ab ab cd", 10, 30, 20, 50, 166_666)]


def test_names_of_the_tokenizers():
    assert os.path.isfile(public_tokenizers.path("byte_bpe_50k.json"))
