"""The safety screen, the domain classifier and the check that explanations stay with their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlake.functions.constants import (
    ASSERTIONS,
    CRISIS_PATTERNS,
    CRISIS_THRESHOLD,
    DOMAIN_PATTERNS,
    NUMBER_WITH_UNIT,
    REGION_SUFFIX,
    REGION_TOKEN,
)
from grantlake.functions.text import any_match, cosine, first_match, non_empty


def crisis(text: Column, vector: Column | None = None, anchors: list[list[float]] | None = None, patterns: list[str] = CRISIS_PATTERNS) -> Column:
    """struct(crisis, layer, matched): patterns in order first; then, where they find nothing, nearness to an anchor vector."""
    matched = first_match(F.coalesce(text, F.lit("")), patterns)
    near = F.lit(False)
    if vector is not None and anchors:
        near = F.greatest(*[cosine(vector, F.array(*map(F.lit, a))) for a in anchors], F.lit(-1.0)) >= CRISIS_THRESHOLD
        near = F.coalesce(near, F.lit(False))
    layer = F.when(matched.isNotNull(), "regex").when(near, "semantic").otherwise("none")
    return F.struct((layer != "none").alias("crisis"), layer.alias("layer"), matched.alias("matched"))


MOST_ANCHORS = 64


def near_anchors(rows: DataFrame, anchors: DataFrame, threshold: float = CRISIS_THRESHOLD) -> DataFrame:
    """Rows (id, vector) with ``hit`` and the largest cosine to any anchor. The anchors are a few fixed phrases, MOST_ANCHORS at most.

    Anchors with a missing, empty or non-finite vector don't count; without any, nothing is a hit.
    """
    usable = F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    literal = [r["vector"] for r in anchors.filter(usable).select("vector").limit(MOST_ANCHORS + 1).collect()]
    if len(literal) > MOST_ANCHORS:
        raise ValueError(f"more than {MOST_ANCHORS} anchors")
    best = F.greatest(*[cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in a])) for a in literal], F.lit(-1.0), F.lit(-1.0))
    return rows.select("id", best.alias("score")).withColumn("hit", F.col("score") >= threshold)


def domain(text: Column, keywords: dict[str, list[str]] = DOMAIN_PATTERNS) -> Column:
    """The first domain with a keyword in the text, or null."""
    return F.coalesce(*[F.when(any_match(text, patterns), name) for name, patterns in keywords.items()])


def classified(text: Column, answer: Column | None = None, keywords: dict[str, list[str]] = DOMAIN_PATTERNS) -> Column:
    """struct(domain, source, confidence) of a text: by keyword; else what a model's JSON answer names, if it is a known domain; else none."""
    filled = non_empty(text).isNotNull()
    own = F.when(filled, domain(text, keywords))
    said = F.get_json_object(answer, "$.domain") if answer is not None else F.lit(None).cast("string")
    known = F.when(filled & said.isin(list(keywords)), said)
    source = F.when(own.isNotNull(), "keyword").when(known.isNotNull(), "llm").otherwise("none")
    return F.struct(F.coalesce(own, known).alias("domain"), source.alias("source"), F.when(own.isNotNull(), 1.0).when(known.isNotNull(), 0.6).alias("confidence"))


def free_input(text: Column, answer: Column | None = None) -> Column:
    """struct(crisis, matched, domain, source, confidence): a text is classified only if the crisis screen lets it through."""
    screened, found = crisis(text), classified(text, answer)
    safe = lambda c: F.when(~screened["crisis"], c)
    return F.struct(
        screened["crisis"].alias("crisis"), screened["matched"].alias("matched"), safe(found["domain"]).alias("domain"), F.coalesce(safe(found["source"]), F.lit("none")).alias("source"),
        safe(found["confidence"]).alias("confidence"),
    )


def anchor_rows(answered: DataFrame, answer: str = "answer") -> DataFrame:
    """(id, vector) of anchors whose phrases a service has embedded; answers that are no vector or not finite are left out, so without a service there are none."""
    rows = answered.select("id", F.from_json(answer, "array<double>").alias("vector"))
    return rows.filter((F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def grounded(text: Column, corpus: Column) -> Column:
    """Whether a text makes no claim of eligibility and names no region, URL or number that the corpus lacks.

    Digits of the corpus's URLs (an id, say) bear out no number, just as those of the text's URLs are no claim.
    """
    norm = lambda c: F.regexp_replace(c, "[\\s,.·]", "")
    own = norm(F.coalesce(corpus, F.lit("")))
    regions = F.regexp_extract_all(text, F.lit(REGION_TOKEN), 1)

    def foreign(token: Column) -> Column:
        head = norm(F.regexp_replace(token, REGION_SUFFIX, ""))
        return ~(own.contains(norm(token)) | ((head != "") & own.contains(head)))

    url = "(?i)(https?://[^\\s)>\"']+)"
    urls = F.regexp_extract_all(text, F.lit(url), 1)
    digits = F.transform(F.regexp_extract_all(F.regexp_replace(F.coalesce(corpus, F.lit("")), url, " "), F.lit("(\\d[\\d,]*)"), 1), lambda d: F.replace(d, F.lit(","), F.lit("")))
    numbers = F.transform(F.regexp_extract_all(F.regexp_replace(text, url, " "), F.lit(NUMBER_WITH_UNIT), 1), lambda n: F.regexp_replace(n, "[^\\d]", ""))
    bad = (
        any_match(text, ASSERTIONS) | F.exists(regions, foreign) | F.exists(urls, lambda u: ~own.contains(norm(u)))
        | F.exists(numbers, lambda n: (n != "") & ~F.array_contains(digits, n))
    )
    return non_empty(text).isNotNull() & ~F.coalesce(bad, F.lit(False))
