"""op7's encoder: words of different case share a kept piece, and ids stay the library's."""

import numpy as np
import public_tokenizers
import pytest

from grantlake.llm.tokens import PieceEncoder, library

TEXTS = [
    "The the THE tHe.", "Élan élan ÉLAN, Ÿ ÿ", "İstanbul I ı i", "ΟΔΟΣ Σ ς οδος", "A <|EndOfText|> b", "A <|endoftext|> B", "á Á É", "“The” – THE…",
    "\nThe\n\nThe \tTHE", "ǅ Ǆ ǆ Ⱥ ẞ ß", "don'T DON'T", "", " ", "K Å K",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_the_library(name):
    path = public_tokenizers.path(name)
    own, plain = PieceEncoder(path), library(path)
    for text in TEXTS + [" ".join(TEXTS)]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_words_of_any_case_are_encoded_once():
    own = PieceEncoder(public_tokenizers.path("word_bpe_49k.json"))
    asked, plain = [], own._word
    own._word = lambda word, blank: asked.append(word) or plain(word, blank)
    own.encode("x Word word WORD wOrd")
    assert asked == ["x", "word"]
