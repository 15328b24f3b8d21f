"""Quality rules by cross-document line frequency.

Every normalised line is hashed; per host the distinct documents that carry it are counted; a line
above the host's limit is boilerplate and is removed; a document that keeps too little is rejected.
A few fixed rules on the document alone (``base_failed``) come first.

Distinct documents are told apart by a hash of the whole normalised text, not by the id: copies count
once, so that a large group of them doesn't turn its own lines into boilerplate and vanish before
de-duplication could keep one. Texts that differ in any line count each, near copies too: a key that a
shared line decides would undercount just the lines that are to be found. A host's documents are
counted by the same key.

Defined cases: a null or empty text has no words, fails the base rules and isn't kept. A null host
is the host with the empty name. A very long text is read whole; its lines travel as 12 bytes each.
Repeated rows are rows of their own and get one verdict; a count equal to a limit is within it. Columns other than doc_id, text and the
host column are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantlake.llm.common import BLANKS, cut_lineage, spread, words_of

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
# A line is boilerplate in a host when more distinct documents carry it than both of these allow.
LINE_MIN_DOCS = 10
LINE_MAX_SHARE = 0.02
# A document is depleted when fewer of its words than this share are left.
MIN_SHARE_LEFT = 0.3
# So many (host, line) rows, of 24 bytes and a host's name, are broadcast.
MOST_BROADCAST = 100_000
# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

PROFILE = (
    "row_id long, doc_id long, host string, row_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, content_key long, lines array<struct<h: long, n: int>>"
)


def line_hash(line: str) -> int:
    """Signed XXH64 of the line in lower case with single blanks."""
    h = xxhash.xxh64_intdigest(b" ".join(line.lower().encode("utf-8", "surrogatepass").split()))
    return h - (1 << 64) if h >> 63 else h


def text_hash(hashes: list[int]) -> int:
    """XXH64 of the hashes of a text's lines in their order, moved into the range of a long."""
    return xxhash.xxh64_intdigest(b"".join(h.to_bytes(8, "little", signed=True) for h in hashes)) - (1 << 63)


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a 3-word window that is found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    seen: set[tuple[bytes, ...]] = set(windows)
    if len(seen) == len(windows):
        return 0
    once: set[tuple[bytes, ...]] = set()
    twice = {w for w in windows if w in once or once.add(w)}
    covered = end = 0
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def profile_text(text: str | None) -> tuple:
    text = text or ""
    words = words_of(text)
    seen: set[str] = set()
    repeats, lines = 0, []
    for line in text.split("\n"):
        if line.strip(BLANKS):
            repeats += line in seen
            seen.add(line)
            lines.append((line_hash(line), len(words_of(line))))
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        repeats,
        repeated_words(words),
        text_hash([h for h, _ in lines]),
        [{"h": h, "n": n} for h, n in lines],
    )


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_key", "lines"]
    for b in batches:
        out = pd.DataFrame([profile_text(t) for t in b.text], columns=names)
        yield pd.concat([b[["row_id", "doc_id", "host", "row_key"]].reset_index(drop=True), out], axis=1)


def profiles(docs: DataFrame, host: str = "source") -> DataFrame:
    """Base figures of each document and its hashed lines; one pass over the texts, then kept."""
    own = spread(docs.select("doc_id", "text", F.col(host).alias("host"), row_key(F.col("text"), F.col(host)).alias("row_key")))
    own = own.withColumn("row_id", F.monotonically_increasing_id())
    return cut_lineage(own.mapInPandas(_profiles, PROFILE))


def frequent_lines(profile: DataFrame, min_docs: int = LINE_MIN_DOCS, max_share: float = LINE_MAX_SHARE) -> DataFrame:
    """(host, h) of the lines above their host's limit. Counts are summed before each shuffle."""
    host = F.coalesce("host", F.lit("")).alias("host")
    docs = profile.groupBy(host, "content_key").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("host_docs"))
    carriers = (
        profile.select(host, "content_key", F.explode(F.array_distinct("lines.h")).alias("h"))
        .groupBy("host", "h", "content_key").agg(F.lit(1).alias("one"))
        .groupBy("host", "h").agg(F.count("*").alias("n_docs"))
        .filter(F.col("n_docs") > min_docs)
    )
    return carriers.join(docs, "host").filter(F.col("n_docs") > F.col("host_docs") * max_share).select("host", "h")


def verdicts(docs: DataFrame, host: str = "source", min_share_left: float = MIN_SHARE_LEFT, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: base figures, ``removed`` (hashes of the lines to drop), ``kept`` and ``row_key``."""
    profile = profiles(docs, host)
    lines = profile.select("row_id", F.coalesce("host", F.lit("")).alias("host"), F.explode("lines").alias("line"))
    lines = lines.select("row_id", "host", F.col("line.h").alias("h"), F.col("line.n").alias("n"))
    frequent = cut_lineage(frequent_lines(profile))
    # The lines of all documents stay where they are as long as the frequent ones are few.
    if frequent.count() <= MOST_BROADCAST:
        frequent = F.broadcast(frequent)
    lost = lines.join(frequent, ["host", "h"], "left_semi").groupBy("row_id").agg(F.sum("n").alias("lost_words"), F.collect_set("h").alias("removed"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    lost_words = F.coalesce("lost_words", F.lit(0))
    return (
        profile.drop("lines", "content_key").join(lost, "row_id", "left")
        .withColumn("base_failed", failed)
        .withColumn("lost_words", lost_words)
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - lost_words >= min_share_left * F.col("n_words")))
    )


@F.pandas_udf(T.StringType())
def without_lines(text: pd.Series, removed: pd.Series) -> pd.Series:
    """The text less the lines whose hash is listed."""

    def strip(t: str | None, drop) -> str | None:
        if t is None or drop is None or not len(drop):
            return t
        gone = set(drop)
        return "\n".join(x for x in t.split("\n") if not x.strip(BLANKS) or line_hash(x) not in gone)

    return pd.Series([strip(t, d) for t, d in zip(text, removed)], dtype=object)


def row_key(text: Column, host: Column) -> Column:
    """What a verdict depends on besides the counts; with the doc_id it tells rows apart."""
    return F.xxhash64(text, host)


def clean(docs: DataFrame, host: str = "source", min_words: int = MIN_WORDS) -> DataFrame:
    """Rejected documents go, boilerplate lines go from the rest; columns stay those of ``docs``.

    A verdict is a row's own, by its doc_id, text and host: rows with one or no doc_id are judged each.
    """
    found = verdicts(docs, host, min_words=min_words).filter("kept")
    found = found.groupBy(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).agg(F.first("removed").alias("removed"))
    own = F.col("d.doc_id").eqNullSafe(F.col("f._id")) & (row_key(F.col("d.text"), F.col(f"d.{host}")) == F.col("f._key"))
    joined = docs.alias("d").join(found.alias("f"), own)
    left = "_" * (1 + max(map(len, docs.columns)))  # no column of docs has a name as long
    out = joined.select(*[F.col(f"d.{c}") for c in docs.columns], without_lines(F.col("d.text"), F.col("f.removed")).alias(left))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(left).cast("long"))
    return out.withColumn("text", F.col(left)).select(*docs.columns)
