"""op9's arrays against plain look-ups: pieces of each cut, parts of units, units of a text, units that lose least."""

import heapq
import math
import random

import numpy as np

from grantlake.llm.piece_lattice import BLANK, UNIT, Lattice

PIECES = {p: (300 + k, -float(k % 7) - len(p) / 4) for k, p in enumerate([BLANK, f"{BLANK}a", "a", "b", "c", "ab", "abc", "bca", "cab", "abcab", "é", "aé", "𝄞", "𝄞a", "bb", "bbbbb"])}


def drawn(seed: int, n: int, longest: int) -> list[str]:
    own = random.Random(seed)
    return ["".join(own.choices("aaabbbccé𝄞x\ud800", k=own.randint(1, longest))) for _ in range(n)]


def test_numbers_are_those_of_the_vocabulary():
    own, order = Lattice(PIECES, 0), {p: k for k, p in enumerate(PIECES)}
    for size in (1, 2, 5, 9):
        parts = [p for p in drawn(size, 4000, 9) if len(p) == size]
        starts = [range(max(0, end - own.longest), end) for end in range(1, size + 1)]
        first = np.concatenate([[0], np.cumsum([len(s) for s in starts])])
        plain = [[order.get(p[s:end], -1) for end, of in enumerate(starts, 1) for s in of] for p in parts]
        assert own.numbers(parts, size, first).tolist() == plain


def test_units_fall_apart_as_one_by_one():
    own, units = Lattice(PIECES, 0), drawn(1, 500, 12)
    parts, ends = own.all_apart(units)
    assert [parts[a:b] for a, b in zip([0, *ends], ends)] == [own.apart(u) for u in units]
    none = Lattice({"a": (300, -1.0)}, 0)
    assert none.all_apart(["aa", "x"]) == (["a", "a", "x"], [2, 3])
    assert Lattice({}, 0).all_apart(["ab"]) == (["a", "b"], [2])


def test_learnt_units_are_those_of_the_search():
    own, units = Lattice(PIECES, 0), drawn(2, 800, 8)
    own.learn(units)
    plain = Lattice(PIECES, 0)
    assert all(own.units[u] == plain.unit(u) for u in units)


def test_units_of_texts():
    for text in ["a b", " a", "a ", "a  b", f"a{BLANK}b c", BLANK, " ", "a\n b\tc", "a"]:
        assert Lattice.units_of(text) == UNIT.findall(BLANK + text.replace(" ", BLANK))
    assert Lattice.units_of("") == []


def test_least_losses():
    own = random.Random(3)
    for _ in range(300):
        losses = tuple(own.choice([0.0, 0.5, 1.0, 2.0, math.inf]) for _ in range(own.randint(1, 9)))
        for n in (0, 1, 3):
            assert Lattice.least(losses, n) == sorted(heapq.nsmallest(n, range(len(losses)), key=losses.__getitem__))
