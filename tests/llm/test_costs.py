"""What the training-data operators may spend: calls of a library, rows held at a time; and the same results for less."""

from __future__ import annotations

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from grantlake.llm import context_tree, piece_lattice, toxicity
from grantlake.llm.tokens import PieceEncoder, library


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_before_marks_are_not_asked_of_the_library(name):
    words = ["Ofthe", "ñrrmi", "tionwh", "Über", "restou", "RESTOU"]
    marks = ["", ",", ".", "$$$", "###", ".%%%", "!!", "'", "\"", ")", "<|>", "_~`^", "[]", "@", "/:"]
    text = "a" + "".join(f"{cut}{w}{m}" for w in words for m in marks for cut in (" ", "\n"))
    plain = library(public_tokenizers.path(name)).encode(text, add_special_tokens=False).ids
    own = PieceEncoder(public_tokenizers.path(name))
    asked, ask = [], own._library
    own._library = lambda piece: asked.append(piece) or ask(piece)
    assert np.frombuffer(own.encode(text), "<u4").tolist() == plain
    assert len(asked) == len(set(asked)) <= len(marks)


def test_toxicity_expands_few_documents_at_a_time():
    n = 3 * toxicity.EXPANDED + 1
    batch = pd.DataFrame({"doc_id": range(n), "positive": 0, "text": ["some words to expand"] * (n - 1) + [None]})
    out = list(toxicity.expand(iter([batch])))
    assert max(map(len, out)) <= toxicity.EXPANDED < n
    assert pd.concat(out).doc_id.tolist() == list(range(n))
    assert out[0].features[0] == sorted(toxicity.features("some words to expand")) and out[-1].features.iloc[-1] == []


def test_parts_solved_together_equal_parts_solved_each(monkeypatch):
    letters = "abcé"
    rng = np.random.default_rng(3)
    pieces = {c: (300 + k, -2.0 - k % 2) for k, c in enumerate(letters[:3])}
    for _ in range(60):
        piece = "".join(rng.choice(list(letters), rng.integers(2, 6)))
        pieces.setdefault(piece, (400 + len(pieces), -float(rng.integers(1, 5))))  # whole scores: many ties
    units = sorted({"".join(rng.choice(list(letters + "x"), n, p=[0.33, 0.32, 0.32, 0.015, 0.015])) for n in rng.integers(1, 30, 1500)})
    one, all_ = piece_lattice.Lattice(pieces, 0), piece_lattice.Lattice(pieces, 0)
    wanted = {u: one.unit(u) for u in units}
    each, called = all_.part, []
    monkeypatch.setattr(all_, "part", lambda p: called.append(p) or each(p))
    all_.learn(units)
    assert {u: all_.units[u] for u in units} == wanted
    # Only long parts, few of a length, or those with a character that no piece holds are solved each.
    assert len(called) < len(units) / 2
    assert any(len(one.apart(u)) > 1 for u in units) and any("é" in p for p in called)


def test_strings_are_sorted_once_and_searched_once(monkeypatch):
    texts = ["the same words and the same strings", "the same words", None, "é other ones"]
    keys = np.concatenate([context_tree.strings([p for _, p in part])[0] for part in context_tree.in_parts(texts)])
    wanted = np.unique(keys, return_counts=True)
    sorts, tallied = [], context_tree.tallied
    monkeypatch.setattr(context_tree, "tallied", lambda arrays: sorts.append(len(arrays)) or tallied(arrays))
    monkeypatch.setattr(context_tree, "PART_BYTES", 16)
    for most, n in ((10_000, 1), (20, 2)):
        monkeypatch.setattr(context_tree, "SORTED", most)
        sorts.clear()
        _, found = context_tree.gathered(texts)
        assert all(np.array_equal(a, b) for a, b in zip(found, wanted))
        assert len(sorts) >= n and (n > 1 or len(sorts) == 1)
    values = np.arange(len(wanted[0])) / 7
    assert np.array_equal(context_tree.looked_up(wanted[0], values, np.sort(keys)), np.repeat(values, wanted[1]))
    assert not len(context_tree.looked_up(wanted[0], values, keys[:0]))
