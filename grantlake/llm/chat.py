"""Chat formatting at the level of tokens.

A conversation is a run of turns: a reserved id for the role, the ids of the text, the reserved id of the
turn's end. Texts are encoded segment by segment and reserved ids are spliced between them, so no text can
ever yield one. A turn of a role without an id of its own has the id of named roles, the role's name, the id
that ends a name, then the text. The loss mask comes from prefix sums: +1 where an assistant text
begins, -1 where it ends.

As text, a reserved id is its control string. So that this text can be read back too, control strings
inside texts are escaped: one gets a backslash before it, and backslashes right before it, or at the end
of a text, are doubled. Of a control string that begins a turn, an even number of backslashes stands before
it, of one inside a text an odd number.

Rows are dealt by ranges of (conv_id, turn) and streamed: a block has at most ``BLOCK_TOKENS`` ids and the turn that
passes them, so neither a conversation nor the third of all rows that it may hold is ever gathered. A
reader digests the conversations that are one block where they are. Blocks of longer ones, and of those at
the ends of a range, meet by conversation and are streamed in order: SHA-256 goes through a conversation
from front to back, so one that holds a third of all rows is one task there, though not in its memory.

Defined cases: a null text is an empty one and a null role an empty name; rows with equal conv_id and turn
are ordered by role, then text; a null turn comes first; rows with a null conv_id are one conversation.
Repeated rows are turns of their own. A very long text is one segment, in one task. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlake.llm.common import shared_folder
from grantlake.llm.tokens import encoder, token_bytes

# Fixed values of the template: the control strings, in the order of their reserved ids.
CONTROLS = ("### System: ", "### User: ", "### Assistant: ", "### Role: ", "</role>", "</turn>\n")
ROLES = ("system", "user", "assistant")
NAMED, NAME_END, END = 3, 4, 5  # places of the others
LEARNED = "assistant"
# What is escaped inside texts: a control string without the blank or line feed after it.
MARKS = "|".join(re.escape(c.strip()) for c in CONTROLS)
TO_ESCAPE = re.compile(rf"(\\*)({MARKS})|(\\+)\Z")
ESCAPED = re.compile(rf"(\\+)(?={MARKS}|\Z)")
CONTROL = re.compile(rf"(\\*)({'|'.join(map(re.escape, CONTROLS))})")
BLOCK_TOKENS = 1 << 16
RANGE_ROWS = 4096
MAX_RANGES = 100_000
BLOCKS = "part int, seq int, conv_id long, whole boolean, ids binary, mask binary"
OUT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
NAMES = [c.split()[0] for c in OUT.split(", ")]


def escape(text: str) -> str:
    """A text in which no control string stands as one."""
    return TO_ESCAPE.sub(lambda m: 2 * m[3] if m[3] else f"{2 * m[1]}\\{m[2]}", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m.group(1)[: len(m.group(1)) // 2], text)


class Template:
    """Turns to ids with their mask, and back."""

    def __init__(self, tokenizer: str) -> None:
        self.encoder = encoder(tokenizer, plain=True)
        self.bytes = token_bytes(self.encoder.tokenizer)
        self.first = len(self.bytes)  # the first reserved id

    def segment(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encoder.encode(escape(text)), "<u4")

    def turn(self, role: str | None, text: str | None) -> list[tuple[np.ndarray, bool]]:
        """Segments of a turn, each with whether the loss counts it."""
        own = lambda k: np.array([self.first + k], "<u4")
        head = [own(ROLES.index(role))] if role in ROLES else [own(NAMED), self.segment(role or ""), own(NAME_END)]
        return [*((s, False) for s in head), (self.segment(text or ""), role == LEARNED), (own(END), False)]

    def decoded(self, ids: np.ndarray) -> str:
        """The formatted text of ids."""
        return b"".join([self.bytes[i] if i < self.first else CONTROLS[i - self.first].encode() for i in ids.tolist()]).decode()

    def turns(self, ids: np.ndarray) -> Iterator[tuple[str, str, slice]]:
        """(role, text, where the text's ids are) of every turn of some whole turns."""
        at = np.flatnonzero(ids >= self.first).tolist()
        k = 0
        while k < len(at):
            control = ids[at[k]] - self.first
            if control == NAMED:
                role, k = unescape(self.decoded(ids[at[k] + 1 : at[k + 1]])), k + 1
            else:
                role = ROLES[control]
            where = slice(at[k] + 1, at[k + 1])
            yield role, unescape(self.decoded(ids[where])), where
            k += 2


def masked(segments: list[tuple[np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of segments in a row, and the mask: the running sum of +1 where a counted segment begins, -1 after its end."""
    ids, sizes = np.concatenate([s for s, _ in segments]), np.cumsum([0, *(len(s) for s, _ in segments)])
    steps = np.zeros(len(ids) + 1, np.int8)
    for (_, counted), begin, end in zip(segments, sizes[:-1], sizes[1:]):
        if counted and begin < end:
            steps[begin] += 1
            steps[end] -= 1
    return ids, np.cumsum(steps[:-1], dtype=np.int8).astype(bool)


def turns_of_text(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted text, by its control strings alone."""
    at, role, named = 0, None, False
    for m in CONTROL.finditer(formatted):
        if len(m[1]) % 2:
            continue
        inside, control = unescape(formatted[at : m.start(2)]), CONTROLS.index(m[2])
        if control == END:
            yield role, inside
        elif control == NAME_END and named:
            role = inside
        elif control < len(ROLES):
            role = ROLES[control]
        at, named = m.end(), control == NAMED


def blocks(conversations: DataFrame, tokenizer: str, block_tokens: int = BLOCK_TOKENS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Blocks of whole turns in the order of (conv_id, turn): little-endian ids and, a bit each, their mask. One shuffle.

    ``whole``: the block has all turns of its conversation. That is known only of conversations that
    are neither the first nor the last of their range.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, own = TaskContext.get().partitionId(), Template(tokenizer)
        seq, segments, n, conv, begins, first = 0, [], 0, None, True, True

        def block(ends: bool) -> tuple:
            ids, mask = masked(segments)
            return part, seq, conv, begins and ends and not first, ids.tobytes(), np.packbits(mask, bitorder="little").tobytes()

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["part", "seq", "conv_id", "whole", "ids", "mask"]).astype({"part": "int32", "seq": "int32", "conv_id": "Int64", "whole": bool})

        for b in batches:
            rows = []
            for conv_id, role, text in zip(b["conv_id"].astype("Int64"), b["role"], b["text"]):
                here = None if pd.isna(conv_id) else int(conv_id)
                if segments and (here != conv or n >= block_tokens):
                    rows.append(block(here != conv))
                    begins, first = here != conv, first and here == conv
                    segments, n, seq = [], 0, seq + 1
                conv, turn = here, own.turn(role, text)
                segments += turn
                n += sum(len(s) for s, _ in turn)
            yield frame(rows)
        if segments:
            yield frame([block(False)])

    rows = conversations.select("conv_id", "turn", "role", "text")
    ranges = min(MAX_RANGES, max(rows.count() // range_rows + 1, rows.sparkSession.sparkContext.defaultParallelism))
    dealt = rows.repartitionByRange(ranges, "conv_id", "turn", "role", F.substring("text", 1, 32))
    return dealt.sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(run, BLOCKS)


class Digest:
    """What a reader gathers of one conversation."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.n_turns, self.formatted, self.loss_chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, turns: list[tuple[str, str]], loss: str, formatted: int) -> None:
        for role, text in turns:
            self.turns.update(f"{role}\n{text}\n".encode())
        self.n_turns += len(turns)
        self.loss.update(loss.encode())
        self.loss_chars += len(loss)
        self.formatted += formatted

    def row(self) -> tuple:
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted


def opened(own: Template, ids: bytes, mask: bytes) -> tuple[list[tuple[str, str]], str, int]:
    """A block's turns, the text under its mask, and the length of its formatted text."""
    ids = np.frombuffer(ids, "<u4")
    mask = np.unpackbits(np.frombuffer(mask, np.uint8), count=len(ids), bitorder="little").astype(bool)
    turns, loss = [], []
    for role, text, where in own.turns(ids):
        turns.append((role, text))
        if mask[where].any():
            loss.append(unescape(own.decoded(ids[where][mask[where]])))
    return turns, "".join(loss), len(own.decoded(ids))


def read_back(found: DataFrame, tokenizer: str) -> DataFrame:
    """A row per conversation, from its blocks. ``found``: the blocks of ``blocks``, written and read."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, now = Template(tokenizer), None
        for b in batches:
            rows = []
            for conv_id, whole, ids, mask in zip(b["conv_id"].astype("Int64"), b["whole"], b["ids"], b["mask"]):
                here = None if pd.isna(conv_id) else int(conv_id)
                if now is None or whole or now.conv_id != here:
                    rows += [now.row()] if now else []
                    now = Digest(here)
                now.add(*opened(own, ids, mask))
            yield pd.DataFrame(rows, columns=NAMES).astype({"conv_id": "Int64"})
        if now:
            yield pd.DataFrame([now.row()], columns=NAMES).astype({"conv_id": "Int64"})

    rows = found.select("part", "seq", "conv_id", "whole", "ids", "mask")
    apart = rows.filter("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return rows.filter("whole").mapInPandas(digests, OUT).unionByName(apart.mapInPandas(digests, OUT))


def formatted(spark: SparkSession, conversations: DataFrame, tokenizer: str) -> DataFrame:
    """Conversations written as blocks in the shared folder and read back."""
    path = shared_folder(spark)
    blocks(conversations, tokenizer).write.parquet(path)
    return read_back(spark.read.parquet(path), tokenizer)
