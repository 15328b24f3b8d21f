"""Hybrid retrieval: a vector arm and a keyword arm, fused by rank or reranked by likeness.

Region and category filters stand below every top-k: moved above it they would change the result. Each
ranking has a total order, the id last. Wide columns stay out of the rankings until ids are chosen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlake.functions.text import cosine, keyword_score, trigram_similarity

RRF_K = 60
BOOST = 0.5
KEYWORD_LEAST = 0.6
KEYWORD_POOL = 80


def index_text(purpose: Column, eligibility: Column, title: Column, summary: Column) -> Column:
    """The text that is searched: purpose and eligibility, or title and summary where both are missing."""
    own = F.concat_ws(" ", F.nullif(F.trim(purpose), F.lit("")), F.nullif(F.trim(eligibility), F.lit("")))
    return F.coalesce(F.nullif(own, F.lit("")), F.concat_ws(" ", title, summary))


def index_keywords(title: Column, category: Column) -> Column:
    """Words of two characters or more in the title, and the category."""
    words = F.filter(F.split(F.coalesce(title, F.lit("")), "\\s+"), lambda w: F.length(w) >= 2)
    return F.array_distinct(F.concat(words, F.array_compact(F.array(F.nullif(F.trim(category), F.lit(""))))))


def query_tokens(query: str) -> list[str]:
    """Tokens between single blanks, lower case, two characters or more."""
    return [t for t in query.lower().split(" ") if len(t) >= 2]


def clamp_request(query: str | None, top_k: object = 10, categories: list[str] | None = None, region: str | None = None) -> dict:
    """A request within its limits: 500 characters, 1 to 30 results, blanks as nothing."""
    try:
        k = float(top_k)
    except (TypeError, ValueError, OverflowError):
        k = 10.0
    k = int(max(1, min(30, k if k and k == k else 10.0)))  # zero and NaN are no number of results
    return {"query": (query or "").strip()[:500], "top_k": k, "categories": categories or None, "region": (region or "").strip() or None}


def clamped(query: Column, top_k: Column, region: Column, categories: Column) -> Column:
    """The same limits for a table of requests: struct(query, top_k, region, categories)."""
    k = top_k.try_cast("double")
    usable = F.coalesce((k != 0) & ~F.isnan(k), F.lit(False))
    return F.struct(
        F.substring(F.trim(F.coalesce(query, F.lit(""))), 1, 500).alias("query"), F.greatest(F.lit(1.0), F.least(F.lit(30.0), F.when(usable, k).otherwise(10.0))).cast("int").alias("top_k"),
        F.nullif(F.trim(region), F.lit("")).alias("region"), F.when(F.size(categories) > 0, categories).alias("categories"),
    )


def compatible(codes: Column, nationwide: Column, region: str | None) -> Column:
    """Candidates for a region: nationwide, without codes, or with this one; all where no region is given."""
    if region is None:
        return F.lit(True)
    empty = F.coalesce(F.size(codes), F.lit(0)) <= 0
    return F.coalesce(nationwide, F.lit(False)) | empty | F.coalesce(F.array_contains(codes, region), F.lit(False))


def in_categories(category: Column, allowed: list[str] | None, blank_passes: bool = True) -> Column:
    """An allow-list that unknown categories pass; an empty list filters nothing."""
    if not allowed:
        return F.lit(True)
    known = F.nullif(category, F.lit("")) if blank_passes else category
    return known.isNull() | known.isin(allowed)


def vector_arm(index: DataFrame, vector: list[float], pool: int) -> DataFrame:
    """(id, score) of the ``pool`` nearest rows with a positive cosine, by partial top-k in every task."""
    literal = F.array(*[F.lit(float(x)) for x in vector])
    scored = index.filter(F.col("vector").isNotNull()).select("id", cosine(F.col("vector"), literal).alias("score"))
    return scored.filter("score > 0").orderBy(F.desc("score"), "id").limit(pool)


def keyword_arm(index: DataFrame, query: str, pool: int, keywords: str | None = None) -> DataFrame:
    """(id, score) of the ``pool`` best rows by words that hold or resemble each other."""
    words = F.col(keywords) if keywords else F.array().cast("array<string>")
    scored = index.select("id", keyword_score(F.lit(query), F.col("text"), words, KEYWORD_LEAST).alias("score"))
    return scored.filter(F.col("score") >= KEYWORD_LEAST).orderBy(F.desc("score"), "id").limit(pool)


def fused(arms: list[DataFrame], pool: int, k: float = RRF_K) -> DataFrame:
    """(id, score, rank of each arm): reciprocal ranks added. Each arm has at most ``pool`` rows, so ranks cost one small sort."""
    from pyspark.sql import Window

    k = k if k and k > 0 else RRF_K
    best = Window.orderBy(F.desc("score"), "id")
    ranked = [
        arm.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(pool)
        .select("id", F.lit(n).alias("arm"), (F.row_number().over(best) - 1).alias("rank")) for n, arm in enumerate(arms)
    ]
    every = reduce(DataFrame.unionByName, ranked)
    ranks = [F.max(F.when(F.col("arm") == n, F.col("rank"))).alias(f"rank_{n}") for n in range(len(arms))]
    terms = [F.coalesce(F.try_divide(F.lit(1.0), F.col(f"rank_{n}") + float(k)), F.lit(0.0)) for n in range(len(arms))]
    return every.groupBy("id").agg(*ranks).withColumn("score", reduce(lambda a, b: a + b, terms))


def boost(category: Column, keywords: Column, categories: list[str], words: list[str]) -> Column:
    """A fixed bonus for a category of the node, and one, once, for any of its words."""
    by_category = F.when(category.isin(categories), BOOST).otherwise(0.0) if categories else F.lit(0.0)
    wanted = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    return by_category + F.when(F.coalesce(F.arrays_overlap(keywords, wanted), F.lit(False)), BOOST).otherwise(0.0)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "id").limit(max(0, k))


def sql_rerank(index: DataFrame, vector: list[float], query: str, k: int = 10) -> DataFrame:
    """(id, score): nearest rows and rows that match by keyword or title, ordered by cosine plus a tenth of the keyword part.

    The vector pool is max(8k, 120), the keyword pool 80 with the best keyword parts first. ``index``
    (id, title, keywords, vector) is already filtered; rows without a vector are in neither arm.
    """
    tokens = query_tokens(query)
    literal = F.array(*[F.lit(float(x)) for x in vector])
    own = index.filter(F.col("vector").isNotNull())
    wanted = F.array(*map(F.lit, tokens)) if tokens else F.array().cast("array<string>")
    overlap = F.coalesce(F.arrays_overlap("keywords", wanted), F.lit(False))
    part = own.select("id", cosine(F.col("vector"), literal).alias("near"), trigram_similarity(F.col("title"), F.lit(query)).alias("trgm"), overlap.alias("overlap"))
    part = part.withColumn("word", F.greatest("trgm", F.when(F.col("overlap"), 0.5).otherwise(0.0)))
    nearest = part.orderBy(F.desc("near"), "id").limit(max(8 * k, 120)).select("id")
    matching = part.filter((F.col("overlap") | (F.col("trgm") > 0.2)) & F.lit(bool(tokens))).orderBy(F.desc("word"), "id").limit(KEYWORD_POOL).select("id")
    candidates = nearest.union(matching).distinct()
    scored = part.join(F.broadcast(candidates), "id", "left_semi").select("id", (F.col("near") + 0.1 * F.col("word")).alias("score"))
    return top_k(scored, k)


def index_of(rows: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(id, text, keywords, category, vector) of rows with an id; vectors are joined by id and null where there are none."""
    purpose, eligibility = (F.get_json_object("parsed", f"$.chunks.{c}") if "parsed" in rows.columns else F.lit(None).cast("string") for c in ("purpose", "eligibility"))
    index = rows.filter(F.coalesce("id", F.lit("")) != "").select(
        "id", index_text(purpose, eligibility, F.col("title"), F.col("summary")).alias("text"), index_keywords(F.col("title"), F.col("category")).alias("keywords"), "category"
    )
    if vectors is None:
        return index.withColumn("vector", F.lit(None).cast("array<double>"))
    return index.join(vectors.select("id", "vector"), "id", "left")


def open_to(index: DataFrame, rows: DataFrame, region: str | None) -> DataFrame:
    """The index without documents of records that are closed to a region; documents without a record stay."""
    if not (region or "").strip():
        return index
    closed = rows.filter(~compatible(F.col("region_codes"), F.col("is_nationwide"), region)).select("id")
    return index.join(closed, "id", "left_anti")


def resolved(hits: DataFrame, rows: DataFrame, index: DataFrame) -> DataFrame:
    """Hits with their records; a hit without one gets a record of which all is unknown but the category that the index has."""
    empty = F.array().cast("array<string>")
    unknown = {
        "title": F.col("id"), "region_codes": empty, "is_nationwide": F.lit(False), "source": F.lit("unknown"), "category": F.col("_category"),
        "income": F.struct(F.lit("unknown").alias("kind"), F.lit(None).cast("double").alias("max_ratio"), F.lit(None).cast("double").alias("max_amount"), F.lit(None).cast("string").alias("raw")),
        "recruit": F.struct(F.lit("unknown").alias("kind"), F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end")),
    }
    found = hits.join(rows.withColumn("_found", F.lit(True)), "id", "left").join(index.select("id", F.col("category").alias("_category")), "id", "left")
    made = {c: F.when(F.col("_found").isNull(), v.cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c, v in unknown.items() if c in rows.columns}
    return found.withColumns(made).drop("_found", "_category")
