"""Text functions as columns: white space, names, similarities, hashes. No row leaves the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from grantlake.functions.constants import BLANK_CLASS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def js_trim(c: Column) -> Column:
    """Without Unicode white space and byte-order marks at both ends."""
    return F.regexp_replace(c, f"^{BLANK_CLASS}+|{BLANK_CLASS}+\\z", "")


def non_empty(c: Column) -> Column:
    """Trimmed, or null if nothing is left."""
    return F.nullif(js_trim(c), F.lit(""))


def one_blank(c: Column) -> Column:
    """White space runs become one blank; null becomes empty."""
    return js_trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{BLANK_CLASS}+", " "))


def normalize_name(c: Column) -> Column:
    """A name without legal-form marks, capital synonyms and everything but digits, Latin letters and Hangul."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), f"[(（]{BLANK_CLASS}*(재|사|주|법인){BLANK_CLASS}*[)）]", "")
    c = F.regexp_replace(c, "서울특별시|서울시", "서울")
    return F.regexp_replace(c, "[^0-9A-Za-z가-힣]", "")


def words(c: Column) -> Column:
    """Distinct words between white space."""
    return F.array_distinct(F.filter(F.split(c, f"{BLANK_CLASS}+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    x, y = words(a), words(b)
    none = (F.size(x) == 0) & (F.size(y) == 0)
    return F.when(none, (a == b).cast("double")).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def levenshtein_likeness(a: Column, b: Column) -> Column:
    """1 - distance / longer length, white space aside; two empty texts are alike."""
    a, b = (F.regexp_replace(c, f"{BLANK_CLASS}+", "") for c in (a, b))
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def similarity(a: Column, b: Column) -> Column:
    """The larger of the word overlap and the edit likeness."""
    return F.greatest(jaccard(a, b), levenshtein_likeness(a, b))


def pair_similarity(name_a: Column, org_a: Column, name_b: Column, org_b: Column) -> Column:
    """Mean likeness of normalized names and organizations; 1 if both are equal, 0 if either pair is empty.

    A normalized name has no white space, so its word overlap adds nothing to its edit likeness.
    """
    na, oa, nb, ob = map(normalize_name, (name_a, org_a, name_b, org_b))
    empty = (F.concat(na, oa) == "") | (F.concat(nb, ob) == "")
    mean = (levenshtein_likeness(na, nb) + levenshtein_likeness(oa, ob)) / 2
    return F.when(empty, 0.0).when((na == nb) & (oa == ob), 1.0).otherwise(mean)


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the lower-cased alphanumeric words, each with two blanks before and one after."""
    found = F.filter(F.split(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", " "), " "), lambda w: w != "")

    def of(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda k: F.substring(padded, k, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(found, of)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; 0 where neither side has any."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over the code points (the UTF-16 units of texts within the basic plane), 8 hex digits."""
    mask, prime = F.lit(0xFFFFFFFF), F.lit(0x01000193)
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    step = lambda h, x: (h.bitwiseXOR(x) * prime).bitwiseAND(mask)
    return F.lpad(F.lower(F.hex(F.aggregate(codes, F.lit(0x811C9DC5), step))), 8, "0")


def title_year(c: Column) -> Column:
    """The largest year 1900 to 2099 in a title, or null."""
    return F.array_max(F.transform(F.regexp_extract_all(c, F.lit("((?:19|20)\\d{2})"), 1), lambda y: y.cast("int")))


def without_years(c: Column) -> Column:
    """The normalized name of a title without its years."""
    return normalize_name(F.regexp_replace(c, "(19|20)\\d{2}년?", " "))


def keyword_score(query: Column, text: Column, keywords: Column, least: float = 0.0) -> Column:
    """Over all pairs of a query word and a target (keywords and the text): 1 if one holds the other, else their likeness; the best.

    Where only scores from ``least`` on matter, targets whose length rules that out aren't compared and count as 0.
    """
    targets = F.filter(F.concat(F.coalesce(keywords, F.array().cast("array<string>")), F.array(text)), lambda t: F.coalesce(t, F.lit("")) != "")
    asked = words(query)
    # Whole texts are looked at first: where one holds a word, nothing else is measured.
    within = F.exists(asked, lambda w: F.coalesce(text.contains(w), F.lit(False)))
    holds = within | F.exists(targets, lambda t: F.exists(asked, lambda w: t.contains(w) | w.contains(t)))
    sized = F.transform(targets, lambda t: F.struct(t.alias("text"), F.length(F.regexp_replace(t, f"{BLANK_CLASS}+", "")).alias("size")))

    def against(word: Column, target: Column) -> Column:
        n, m = target["size"], F.length(word)
        return F.when(F.least(m, n) >= least * F.greatest(m, n), similarity(word, target["text"])).otherwise(0.0)

    best = lambda all_: F.array_max(F.transform(asked, lambda w: F.array_max(F.transform(all_, lambda t: against(w, t)))))
    return F.when(holds, 1.0).otherwise(F.coalesce(let(sized, best), F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 for unlike lengths, empty, non-finite or zero vectors."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    norms = F.sqrt(total(F.transform(x, lambda p: p * p))) * F.sqrt(total(F.transform(y, lambda q: q * q)))
    value = F.try_divide(dot, norms)
    usable = (F.size(x) == F.size(y)) & (F.size(x) > 0) & ~F.isnan(value) & (F.abs(value) <= 2)
    return F.when(usable, value).otherwise(0.0)


def l2_normalized(v: Column) -> Column:
    """A vector of length one; non-finite entries count as 0, a zero or overflowing length gives zeros."""
    v = F.transform(v.cast("array<double>"), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    good = (norm > 0) & (norm < float("inf"))
    return F.transform(v, lambda x: F.when(good, x / norm).otherwise(0.0))


ASCII_BOUND = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def ascii_bounds(pattern: str) -> str:
    """A pattern whose word bounds are those of ASCII words, as JavaScript and SQL have them; Java's depend on its release, some count accented letters."""
    return re.sub(r"\\(.)", lambda m: ASCII_BOUND if m[1] == "b" else m[0], pattern, flags=re.DOTALL)


def any_match(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(ascii_bounds(p)) for p in patterns])


def first_match(c: Column, patterns: list[str]) -> Column:
    """The text of the first pattern, in the order given, that is found; null if none is."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, ascii_bounds(p), 0), F.lit("")) for p in patterns])
