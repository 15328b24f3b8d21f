"""SentencePiece encoding with the N best segmentations, and decoding.

A text's pieces form a lattice: an edge for every vocabulary piece at every place, scored by the model
file. Forward Viterbi gives the best score from the start to each place; as it is exact, it guides an
A* search that runs backward from the end and pops complete segmentations best first. No piece holds a
blank mark after another character, so the lattice falls apart into units (blank marks and the
characters up to the next blank). Units repeat, so their best segmentations are kept; the loss of a
unit's second-best one, which needs no search (the best path through any edge off the best path),
tells which units can take part in the N best of the whole text: those of the N-1 least losses. Only
these few are searched.

Ties for the best segmentation go to the one whose ids, read from the end of the unit, come first; ties
below it to the one that the search, deepest path first, comes to first; between units, to the earlier
one. A character that no piece holds is spelt in byte pieces at a score below all others.

Defined cases: a null or empty text has one segmentation, without pieces, and score 0. Fewer than N
segmentations are returned where there are no more. Blank marks in the text itself decode to blanks.
A very long text is encoded whole, unit by unit. Repeated rows are encoded each; extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from grantlake.llm.common import spread
from grantlake.llm.tokens import Known

BLANK = "▁"
UNIT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
N_BEST = 4
CACHED_SEARCHES = 50_000
# Parts of one length, from FEW to MOST of them and up to SHORT characters long, are solved together.
FEW, MOST, SHORT = 8, 2048, 24
LEARNT = 256  # documents whose new units are solved together
OUT = (
    "doc_id long, n_pieces long, score double, ids_crc32 long, nbest_scores array<double>, nbest_ids_crc32 array<long>, "
    "decoded_sha256 string, round_trip boolean"
)
Segmentation = tuple[float, tuple[int, ...]]


class Lattice:
    """The vocabulary of a model file, and the search over it."""

    def __init__(self, pieces: dict[str, tuple[int, float]], bytes_at: int, longest: int | None = None) -> None:
        self.pieces, self.bytes_at = pieces, bytes_at
        self.longest = longest or max(map(len, pieces), default=1)
        self.unknown = min((s for _, s in pieces.values()), default=0.0) - 10
        self.bytes_of = {bytes_at + b: bytes([b]) for b in range(256)} | {i: p.encode("utf-8", "surrogatepass") for p, (i, _) in pieces.items()}
        self.pairs = {a + b for p in pieces for a, b in zip(p, p[1:])}
        # As arrays, by number of the piece; what is no piece has number -1 and so the last place.
        self.ids = np.array([i for i, _ in pieces.values()] + [-1], np.int64)
        self.scores = np.array([s for _, s in pieces.values()] + [-math.inf])
        # The beginnings of pieces, shortest first, are nodes from 1 on (0: nothing yet), each made of an earlier node and
        # a character; so what makes them (``made``) is in ascending order. ``codes`` numbers characters from 1 on, 0: in no piece.
        self.characters = np.unique(np.array([ord(c) for c in set("".join(pieces))], np.int64))
        begun = sorted({p[:k] for p in pieces for k in range(1, len(p) + 1)}, key=lambda b: (len(b), b))
        node, number = {"": 0} | {b: k for k, b in enumerate(begun, 1)}, {p: k for k, p in enumerate(pieces)}
        self.codes = np.zeros(int(self.characters.max(initial=0)) + 2, np.int64)
        self.codes[self.characters] = np.arange(1, len(self.characters) + 1)
        self.made = np.array([node[b[:-1]] * (len(self.characters) + 1) + self.codes[ord(b[-1])] for b in begun], np.int64)
        self.pair_keys = np.array(sorted(self.codes[ord(p[0])] * (len(self.characters) + 1) + self.codes[ord(p[1])] for p in self.pairs), np.int64)
        self.number_at = np.array([-1] + [number.get(b, -1) for b in begun], np.int64)
        self.units, self.parts = Known(self.unit), Known(self.part)
        self.searched: dict[str, list[Segmentation]] = {}

    @classmethod
    def load(cls, path: str) -> Lattice:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        return cls({model.id_to_piece(i): (i, model.get_score(i)) for i in plain}, model.piece_to_id("<0x00>"))

    def edges(self, unit: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For each place the pieces that end there: (start, ids, score)."""
        get, longest, ends = self.pieces.get, self.longest, []
        for end in range(1, len(unit) + 1):
            here = []
            for start in range(max(0, end - longest), end):
                if found := get(unit[start:end]):
                    here.append((start, found[0], found[1]))
            if not here or here[-1][0] != end - 1:
                spelt = unit[end - 1].encode("utf-8", "surrogatepass")
                here.append((end - 1, tuple(self.bytes_at + b for b in spelt), self.unknown))
            ends.append(here)
        return ends

    @staticmethod
    def forward(ends: list) -> list[float]:
        """Best score from the start to each place."""
        best = [0.0]
        for here in ends:
            best.append(max([best[start] + score for start, _, score in here]))
        return best

    def search(self, unit: str, n: int) -> list[Segmentation]:
        """The n best segmentations, best first: A* from the end with the forward scores as heuristic."""
        ends = self.edges(unit)
        best = self.forward(ends)
        # An entry: -(best total through it), -(step that made it), its last ids from the end, place, score so far,
        # and the entry it goes on from: a longer path shares the memory of its beginning.
        heap: list = [(-best[-1], 0, (), len(unit), 0.0, None)]
        found: list[Segmentation] = []
        step = 0
        while heap and len(found) < n:
            entry = heapq.heappop(heap)
            _, _, _, place, score, _ = entry
            step += 1
            if not place:
                found.append((score, self.path(entry)))
                continue
            for start, piece, own in ends[place - 1]:
                more = tuple(reversed(piece)) if isinstance(piece, tuple) else (piece,)
                heapq.heappush(heap, (-(score + own + best[start]), -step, more, start, score + own, entry))
        return found

    @staticmethod
    def path(entry: tuple | None) -> tuple[int, ...]:
        """The ids of an entry and of those it goes on from, in order of the text."""
        ids: list[int] = []
        while entry:
            ids += reversed(entry[2])
            entry = entry[5]
        return tuple(ids)

    def apart(self, unit: str) -> list[str]:
        """The parts of a unit: it falls apart between two characters that stand side by side in no piece."""
        pairs, at, parts = self.pairs, 0, []
        for k in range(1, len(unit)):
            if unit[k - 1 : k + 1] not in pairs:
                parts.append(unit[at:k])
                at = k
        parts.append(unit[at:])
        return parts

    @staticmethod
    def joined(found: list[tuple[float, bytes, float]]) -> tuple[float, bytes, float]:
        scores, ids, losses = zip(*found)
        return sum(scores), b"".join(ids), min(losses)

    def unit(self, unit: str) -> tuple[float, bytes, float]:
        """(best score, its ids, loss of the second-best segmentation)."""
        parts = self.apart(unit)
        return self.part(unit) if len(parts) == 1 else self.joined([self.parts[p] for p in parts])

    def all_apart(self, units: list[str]) -> tuple[list[str], list[int]]:
        """The parts of all units in a row, and of each unit the place behind its last one."""
        text = "".join(units)
        ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        codes = self.codes_of(text)
        pairs = codes[:-1] * (len(self.characters) + 1) + codes[1:]
        falls = np.concatenate([[False], ~self.is_pair(pairs), [True]])
        falls[ends] = True
        cuts = np.flatnonzero(falls)
        parts = [text[x:y] for x, y in zip([0, *cuts[:-1].tolist()], cuts.tolist())]
        return parts, (np.searchsorted(cuts, ends) + 1).tolist()

    def is_pair(self, keys: np.ndarray) -> np.ndarray:
        """Whether two characters, as one number, stand side by side in a piece."""
        if not len(self.pair_keys):
            return np.zeros(len(keys), bool)
        return self.pair_keys[np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)] == keys

    def codes_of(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return self.codes[np.minimum(points, len(self.codes) - 1)]  # the last of them is 0

    def learn(self, units: Iterable[str]) -> None:
        """Keeps the segmentations of units not yet known; new parts of one length are solved together."""
        new = [u for u in set(units) if u not in self.units and u not in self.units.older]
        if not new:
            return
        parts, ends = self.all_apart(new)
        by_length: dict[int, list[str]] = {}
        for p in set(parts):
            if p not in self.parts and p not in self.parts.older:
                by_length.setdefault(len(p), []).append(p)
        solved: dict[str, tuple[float, bytes, float]] = {}
        for size, own in by_length.items():
            for at in range(0, len(own), MOST):
                some = own[at : at + MOST]
                if len(some) >= FEW and size <= SHORT:
                    solved |= self.together(some, size)
                else:
                    solved |= {p: self.part(p) for p in some}
        begin = 0
        for u, end in zip(new, ends):
            if end - begin == 1:
                self.units[u] = solved[u] if u in solved else self.parts[u]
            else:
                found = []
                for p in parts[begin:end]:
                    if p in solved:
                        self.parts[p] = solved[p]
                    found.append(self.parts[p])
                self.units[u] = self.joined(found)
            begin = end

    def together(self, parts: list[str], size: int) -> dict[str, tuple[float, bytes, float]]:
        """``part`` for each of some parts of ``size`` characters; a row each, place by place.

        A part with a character that no piece holds goes to ``part``.
        """
        starts = [np.arange(max(0, end - self.longest), end) for end in range(1, size + 1)]
        first = np.concatenate([[0], np.cumsum(list(map(len, starts)))])
        numbers = self.numbers(parts, size, first)
        whole = (numbers[:, first[1:] - 1] >= 0).all(1)  # the last cut of each place is its own character
        out = {p: self.part(p) for p, w in zip(parts, whole) if not w}
        parts, numbers = [p for p, w in zip(parts, whole) if w], numbers[whole]
        ids, scores = self.ids[numbers], self.scores[numbers]
        best, back = np.zeros((len(parts), size + 1)), np.full((len(parts), size + 1), -math.inf)
        through, chosen = [], []
        for end, s in enumerate(starts, 1):
            at = slice(first[end - 1], first[end])
            total = best[:, s] + scores[:, at]
            best[:, end] = total.max(1)
            # Of equal ways the one of the least id.
            chosen.append(np.where(total == best[:, end, None], ids[:, at], np.iinfo(np.int64).max).argmin(1))
            through.append(total)
        back[:, size] = 0.0
        taken, place, second = np.full((len(parts), size), -1, np.int64), np.full(len(parts), size), np.full(len(parts), -math.inf)
        for end in range(size, 0, -1):
            s, at, own = starts[end - 1], slice(first[end - 1], first[end]), chosen[end - 1]
            after = back[:, end, None]
            back[:, s] = np.maximum(back[:, s], scores[:, at] + after)
            rest = through[end - 1] + after
            on = np.flatnonzero(place == end)
            rest[on, own[on]] = -math.inf
            second = np.maximum(second, rest.max(1))
            taken[on, end - 1] = ids[on, first[end - 1] + own[on]]
            place[on] = s[own[on]]
        flat, ends = taken[taken >= 0].astype("<u4").tobytes(), np.cumsum((taken >= 0).sum(1)) * 4
        begins = np.concatenate([[0], ends[:-1]]).tolist()
        for p, score, begin, end, loss in zip(parts, best[:, size].tolist(), begins, ends.tolist(), (best[:, size] - second).tolist()):
            out[p] = (score, flat[begin:end], loss)
        return out

    def numbers(self, parts: list[str], size: int, first: np.ndarray) -> np.ndarray:
        """The number of the piece, or -1, of each cut of each part; cuts by their ends (from ``first`` on), then their starts.

        From each start only those cuts go on that some piece begins with.
        """
        out = np.full((len(parts), first[-1]), -1, np.int64)
        if not len(self.made):
            return out
        codes = self.codes_of("".join(parts))
        at = np.arange(len(codes))
        end, node, last = at % size, np.zeros(len(at), np.int64), len(self.made) - 1
        # of the cut that begins at a start and ends with its first character
        row, start = at // size, end
        while len(at):
            key = node * (len(self.characters) + 1) + codes[at]
            found = np.minimum(np.searchsorted(self.made, key), last)
            on = np.flatnonzero(self.made[found] == key)
            at, end, row, start, node = at[on], end[on] + 1, row[on], start[on], found[on] + 1
            out[row, first[end - 1] + start - np.maximum(end - self.longest, 0)] = self.number_at[node]
            on = np.flatnonzero((end < size) & (end - start < self.longest))
            at, end, row, start, node = at[on] + 1, end[on], row[on], start[on], node[on]
        return out

    def part(self, part: str) -> tuple[float, bytes, float]:
        """As unit, by the forward scores and the backward ones: no search is needed for two best."""
        ends, size = self.edges(part), len(part)
        best = self.forward(ends)
        back = [-math.inf] * size + [0.0]
        for end in range(size, 0, -1):
            after = back[end]
            for start, _, score in ends[end - 1]:
                if score + after > back[start]:
                    back[start] = score + after
        ids: list[int] = []
        place, second = size, -math.inf
        taken = {}
        while place:
            ways = [(p if isinstance(p, tuple) else (p,), s) for s, p, score in ends[place - 1] if best[s] + score == best[place]]
            piece, start = min(ways) if len(ways) > 1 else ways[0]
            ids += reversed(piece)
            taken[place] = start
            place = start
        for end in range(1, size + 1):
            after, own = back[end], taken.get(end)
            for start, _, score in ends[end - 1]:
                if start != own and best[start] + score + after > second:
                    second = best[start] + score + after
        return best[-1], array("I", reversed(ids)).tobytes(), best[-1] - second

    @staticmethod
    def units_of(text: str) -> list[str]:
        if not text:
            return []
        words = text.split(" ")
        if "" in words or BLANK in text:
            return UNIT.findall(BLANK + text.replace(" ", BLANK))
        return [BLANK + w for w in words]

    @staticmethod
    def least(losses: tuple[float, ...], n: int) -> list[int]:
        """The places of the n least losses, in order of place; of equal ones the earlier."""
        rest, found = list(losses), []
        for _ in range(n):
            if (low := min(rest)) == math.inf:
                return sorted(heapq.nsmallest(n, range(len(losses)), key=losses.__getitem__))
            found.append(rest.index(low))
            rest[found[-1]] = math.inf
        return sorted(found)

    def encode(self, text: str, n: int = N_BEST) -> list[tuple[float, bytes]]:
        """The n best segmentations of a text: (score, ids as little-endian unsigned 32-bit integers)."""
        return self.encode_units(self.units_of(text), n)

    def encode_units(self, parts: list[str], n: int = N_BEST) -> list[tuple[float, bytes]]:
        """``encode`` of a text's units."""
        if not parts:
            return [(0.0, b"")]
        self.units.turn()
        self.parts.turn()
        if len(self.searched) > CACHED_SEARCHES:
            self.searched.clear()
        scores, first_ids, losses = zip(*map(self.units.__getitem__, parts))
        total = math.fsum(scores)
        weak = self.least(losses, n - 1)
        combined: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for k in weak:
            if (p := parts[k]) not in self.searched or len(self.searched[p]) < n:
                self.searched[p] = self.search(p, n)
            best = self.searched[p][0][0]
            combined = sorted((loss + best - s, (*chosen, j)) for loss, chosen in combined for j, (s, _) in enumerate(self.searched[p][:n]))[:n]
        # What lies between the weak units is the same in each.
        between = [b"".join(first_ids[a + 1 : b]) for a, b in zip([-1, *weak], [*weak, len(parts)])]
        out = []
        for loss, chosen in combined:
            ids = [between[0]]
            for k, j, after in zip(weak, chosen, between[1:]):
                ids += (array("I", self.searched[parts[k]][j][1]).tobytes(), after)
            out.append((total - loss, b"".join(ids)))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of pieces: bytes are put together, blank marks become blanks, the first one goes."""
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "surrogatepass").replace(BLANK, " ")[1:]


@cache
def lattice(path: str) -> Lattice:
    """One lattice per worker process and file; fewer rounds of garbage collection over its many small objects."""
    gc.set_threshold(200_000, 20, 50)
    return Lattice.load(path)


def encode_documents(docs: DataFrame, model: str, n: int = N_BEST) -> DataFrame:
    """Per row the best segmentation, the scores and checksums of the n best, and what the best decodes to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = lattice(model)
        for b in batches:
            rows, ids, texts, units = [], list(b.doc_id), [t or "" for t in b.text], []
            for k, (doc_id, text) in enumerate(zip(ids, texts)):
                if not k % LEARNT:
                    units = [own.units_of(t) for t in texts[k : k + LEARNT]]
                    own.learn(chain.from_iterable(units))
                found = own.encode_units(units[k % LEARNT], n)
                crcs = [zlib.crc32(raw) for _, raw in found]
                decoded = own.decode(found[0][1])
                digest = hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((doc_id, len(found[0][1]) // 4, found[0][0], crcs[0], [s for s, _ in found], crcs, digest, decoded == text))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"doc_id": "Int64"})

    return spread(docs.select("doc_id", "text")).mapInPandas(run, OUT)
