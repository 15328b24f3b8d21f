"""Exact token ids from a public tokenizer file, with a per-worker cache of pieces.

Both tokenizer files used here first cut a text at white space and never merge across such a cut, so
the ids of a text are the ids of its pieces in a row. Pieces repeat far more often than texts do;
only pieces not seen lately reach the tokenizers library. A cut is made only before a blank or a
line feed that follows a visible character; all other white space stays inside its piece.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
from array import array
from collections.abc import Callable
from functools import cache
from operator import attrgetter

# A blank or line feed after other white space: such texts are cut by CUT, the others by str.split.
AFTER_SPACE = re.compile(r"\s[ \n]")
CUT = re.compile(r"(?<=\S)(?=[ \n])")
# Latin letters that every Unicode version knows as letters and that are their own composed form.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")
# A line feed or none, a word, and marks to the end of the piece: both pre-tokenizers cut between these.
WORD_AND_MARKS = re.compile(f"(\n?)({LATIN.pattern})([!-/:-@\\[-`{{-~]*)")
# Characters beside which lower case may depend on the library: all but Latin, its marks and some punctuation that has no case.
NOT_LATIN = re.compile("[^\\x00-įı-ɏ‐-‧€]")
CACHED_PIECES = 500_000
ID = attrgetter("id")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for a byte: itself if it prints, else the next from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


def library(path: str, plain: bool = False):  # noqa: ANN201  the type belongs to a library that only tasks import
    """The tokenizers library's encoder, without threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = plain
    return found


def token_bytes(tokenizer) -> list[bytes]:  # noqa: ANN001
    """The bytes of every id of a byte-level vocabulary."""
    byte_of = {c: b for b, c in byte_letters().items()}
    found = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        found[i] = bytes(byte_of[c] for c in token)
    return found


class Known(dict):
    """piece -> its ids as bytes; an unknown piece is encoded and kept.

    When ``most`` have come in, they become the older half and a new half begins; what is asked
    for again moves over from the older half, so frequent pieces stay.
    """

    def __init__(self, encode: Callable[[str], bytes], most: int = CACHED_PIECES) -> None:
        self.encode, self.most, self.older = encode, most, {}

    def __missing__(self, piece: str) -> bytes:
        if (found := self.older.get(piece)) is None:
            found = self.encode(piece)
        self[piece] = found
        return found

    def turn(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()


class PieceEncoder:
    """encode(text): its ids as little-endian unsigned 32-bit integers.

    With ``plain`` the strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, most: int = CACHED_PIECES, plain: bool = False) -> None:
        self.tokenizer = library(path, plain)
        self.model = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.keeps_blank = self._library(" a") != self._library("a")
        self.lowers = self._library("A") == self._library("a")
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.whole = Known(self._whole, most)
        self.after_cut = Known(self._after_cut, most)

    def _library(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str, blank: bool) -> bytes:
        """A plain word: the pre-tokenizer makes one token's text of it, so the model alone is asked."""
        if self.lowers:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        if blank and self.keeps_blank:
            word = self.letters[32] + word
        return array("I", map(ID, self.model.tokenize(word))).tobytes()

    def _whole(self, piece: str) -> bytes:
        return self._word(piece, False) if LATIN.fullmatch(piece) else self._library(piece)

    def _after_cut(self, piece: str) -> bytes:
        """A piece after a cut: with its line feed, or with the blank that the cut took away."""
        if piece.isalpha() and piece.isascii():  # most pieces
            return self._word(piece, True)
        if not (found := WORD_AND_MARKS.fullmatch(piece)):
            if piece[:1] == "\n" and LATIN.match(piece, 1):
                return self.whole["\n"] + self.whole[piece[1:]]
            return self._library(piece if piece[:1] == "\n" else " " + piece)
        line, word, marks = found.groups()
        if not line and not marks:
            return self._word(word, True)
        # A tokenizer that drops blanks gives a word the same ids after one as without.
        ids = (self.whole if line and self.keeps_blank else self.after_cut)[word]
        if line:
            ids = self.whole[line] + ids
        return ids + self.whole[marks] if marks else ids

    def lowered(self, text: str) -> str:
        """The text in lower case, so that words meet the same kept pieces however they are written.

        A text stays as it is where the tokenizer's own lower case might be another one, or where it would hold the
        string of an added token, which is looked for before letters are lowered.
        """
        low = text.lower()
        return text if NOT_LATIN.search(text) or any(a in low for a in self.added) else low

    def encode(self, text: str) -> bytes:
        self.whole.turn()
        self.after_cut.turn()
        if self.lowers:
            text = self.lowered(text)
        if AFTER_SPACE.search(text):
            return b"".join(map(self.whole.__getitem__, CUT.split(text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.whole[first] + b"".join(map(self.after_cut.__getitem__, rest))


@cache
def encoder(path: str, most: int = CACHED_PIECES, plain: bool = False) -> PieceEncoder:
    """One encoder per worker process and file; fewer rounds of garbage collection over its many small objects."""
    gc.set_threshold(200_000, 20, 50)
    return PieceEncoder(path, most, plain)


def release() -> None:
    """Gives back what encoders have kept, to the system too: the worker lives on and runs other tasks."""
    encoder.cache_clear()
    gc.collect()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps freed memory otherwise
        trim(0)
