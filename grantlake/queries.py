"""The registered queries over the driver's tables, each with DuckDB SQL for the same rows where SQL can say it.

Stand-ins: documents for record texts, embeddings for vectors, parts for typed records, customers for
profiles, orders for application windows, pages for crawled pages, conversations for free-text queries,
events for the request log. Every query reads its tables whole.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlake.functions import parse, text
from grantlake.functions.constants import CRISIS_PATTERNS, DISTRICTS, PROVINCES
from grantlake.operators import ann, coverage, eligibility, ingest, results, retrieval, safety
from grantlake.sources.shared import shared_folder
from grantlake.streaming.limiter import limited

TODAY = date(1998, 6, 24)
QUERY_TEXT = "thend ering station"
DIMENSIONS = 64
VECTOR = [((k * 37) % 19 - 9) / 10 for k in range(DIMENSIONS)]
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column, digits: int = 9) -> Column:
    return F.round(c, digits)


# ---- retrieval --------------------------------------------------------------------------------------

SQL_VECTOR = "[" + ", ".join(f"{x}::DOUBLE" for x in VECTOR) + "]"
SQL_COSINE = f"(list_dot_product(embedding::DOUBLE[], {SQL_VECTOR}) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product({SQL_VECTOR}, {SQL_VECTOR}))))"
QUERY_WORDS = QUERY_TEXT.split()


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


# The index of documents: the first line stands for the title, the source for the category. DuckDB counts edits in bytes, so its SQL
# writes each accented letter as one control character; the engine has the texts as they are.
ACCENTED = "éèêçñóíüöäßÉÈÊÇÑÓÍÜÖÄ"
SINGLE = "".join(chr(k) for k in [*range(1, 9), *range(14, 27)])
SQL_SINGLE = f"translate({{0}}, '{ACCENTED}', '{SINGLE}')"
SQL_KEYWORDS = f"list_distinct(list_concat(list_filter(regexp_split_to_array({SQL_SINGLE.format('string_split(text, chr(10))[1]')}, '\\s+'), lambda w: length(w) >= 2), [source]))"


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    keywords = retrieval.index_keywords(F.split("text", "\n")[0], F.col("source"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", keywords.alias("keywords"))


SQL_BARE = "regexp_replace(t, '\\s+', '', 'g')"
SQL_AGAINST = f"CASE WHEN contains(t, w) OR contains(w, t) THEN 1.0 ELSE 1 - levenshtein(w, {SQL_BARE}) / greatest(length(w), length({SQL_BARE}))::DOUBLE END"
SQL_SCORED = f"""i AS (SELECT doc_id AS id, {SQL_SINGLE.format('text')} AS text, {SQL_KEYWORDS} AS keywords FROM documents),
k AS (SELECT id, list_max(list_transform({QUERY_WORDS}, lambda w: list_max(list_transform(list_filter(list_append(keywords, text), lambda t: t <> ''), lambda t: {SQL_AGAINST})))) AS s FROM i)"""
SQL_ARMS = f"""
v AS (SELECT vec_id AS id, {SQL_COSINE} AS s FROM embeddings), va AS (
  SELECT id, row_number() OVER (ORDER BY s DESC, id) - 1 AS r FROM v WHERE s > 0 QUALIFY r < 120),
{SQL_SCORED}, ka AS (
  SELECT id, row_number() OVER (ORDER BY s DESC, id) - 1 AS r FROM k WHERE s >= 0.6 QUALIFY r < 120),
f AS (SELECT coalesce(va.id, ka.id) AS id, va.r AS rank_0, ka.r AS rank_1,
  coalesce(1.0 / (60 + va.r), 0.0) + coalesce(1.0 / (60 + ka.r), 0.0) AS score FROM va FULL JOIN ka ON va.id = ka.id)"""


@query(f"WITH {SQL_SCORED} SELECT id, round(s, 9) AS score FROM k WHERE s >= 0.6 ORDER BY s DESC, id LIMIT 500")
def keyword_arm(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.keyword_arm(_indexed(spark, d), QUERY_TEXT, 500, "keywords").select("id", rounded(F.col("score")).alias("score"))


@query(f"WITH {SQL_ARMS} SELECT id, rank_0, rank_1, round(score, 9) AS score FROM f ORDER BY f.score DESC, id LIMIT 10")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    arms = [retrieval.vector_arm(_embeddings(spark, d), VECTOR, 120), retrieval.keyword_arm(_indexed(spark, d), QUERY_TEXT, 120, "keywords")]
    top = retrieval.top_k(retrieval.fused(arms, 120), 10)
    return top.select("id", "rank_0", "rank_1", rounded(F.col("score")).alias("score"))


# Only ids with both a document and a vector can be in the result: the two tables share a range of ids.
@query(
    f"WITH {SQL_ARMS.replace('FROM embeddings)', 'FROM embeddings WHERE label IS NULL OR label IN (1, 2, 3))')}, b AS (SELECT f.id, f.score + CASE WHEN e.label = 2 THEN 0.5 ELSE 0 END "
    "+ CASE WHEN list_contains(i.keywords, 'src1') OR list_contains(i.keywords, 'station') THEN 0.5 ELSE 0 END AS score "
    "FROM f JOIN embeddings e ON e.vec_id = f.id JOIN i ON i.id = f.id) SELECT id, round(score, 9) AS score FROM b ORDER BY b.score DESC, id LIMIT 10"
)
def hybrid_rrf_boosted(spark: SparkSession, d: str) -> DataFrame:
    index, docs = _embeddings(spark, d).withColumn("category", F.col("label").cast("string")), _indexed(spark, d)
    near = index.filter(retrieval.in_categories(F.col("category"), ["1", "2", "3"]))
    found = retrieval.fused([retrieval.vector_arm(near, VECTOR, 120), retrieval.keyword_arm(docs, QUERY_TEXT, 120, "keywords")], 120)
    bonus = retrieval.boost(F.col("category"), F.col("keywords"), ["2"], ["src1", "station"])
    scored = found.join(index.select("id", "category"), "id").join(docs.select("id", "keywords"), "id").select("id", (F.col("score") + bonus).alias("score"))
    return retrieval.top_k(scored, 10).select("id", rounded(F.col("score")).alias("score"))


NEAREST, EVERY_QUERY = 120, 50


def _nearest(spark: SparkSession, d: str, *ways: dict) -> list[DataFrame]:
    """Every EVERY_QUERYth vector looked up among all in each of some ways, through an index that is written and read."""
    rows, path = _embeddings(spark, d).select("id", "vector"), shared_folder(spark)
    ann.save(spark, ann.fit(rows), f"{path}/model")
    model = ann.load(spark, f"{path}/model")
    ann.build(rows, model).write.parquet(f"{path}/blocks")
    queries = rows.filter(F.col("id") % EVERY_QUERY == 0).select(F.col("id").alias("query"), "vector")
    found = [ann.search(spark.read.parquet(f"{path}/blocks"), model, rows, queries, NEAREST, **how) for how in ways]
    return [x.select("query", "id", rounded(F.col("score")).alias("score")) for x in found]


@query()
def ann_top120(spark: SparkSession, d: str) -> DataFrame:
    """By codes in the nearest cells; its recall is measured in the tests."""
    return _nearest(spark, d, {})[0]


SQL_PAIR_COSINE = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])))"


@query(f"""WITH s AS (SELECT q.vec_id AS query, e.vec_id AS id, {SQL_PAIR_COSINE} AS score FROM embeddings q, embeddings e WHERE q.vec_id % {EVERY_QUERY} = 0)
SELECT query, id, round(score, 9) AS score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY s.score DESC, id) <= {NEAREST}""")
def exact_top120(spark: SparkSession, d: str) -> DataFrame:
    """All cells probed, vectors in place of codes."""
    return _nearest(spark, d, {"exact": True})[0]


@query(f"""WITH s AS (SELECT q.vec_id AS query, e.vec_id AS id, {SQL_PAIR_COSINE} AS score FROM embeddings q, embeddings e WHERE q.vec_id % {EVERY_QUERY} = 0),
t AS (SELECT query, id FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= {NEAREST})
SELECT count(DISTINCT query) AS queries, count(*) AS wanted, TRUE AS enough FROM t""")
def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the search by codes finds nine tenths of the exact neighbours."""
    exact, found = _nearest(spark, d, {"exact": True}, {})
    met = exact.select("query", "id").join(found.select("query", "id", F.lit(1).alias("found")), ["query", "id"], "left")
    return met.agg(F.count_distinct("query").alias("queries"), F.count("*").alias("wanted"), (F.count("found") >= 0.9 * F.count("*")).alias("enough"))


def sql_trigrams(c: str) -> str:
    words = f"list_filter(string_split(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda k: substring('  ' || w || ' ', k, 3)))))"


def sql_trigram_similarity(a: str, b: str) -> str:
    x, y = sql_trigrams(a), sql_trigrams(b)
    return f"coalesce(len(list_intersect({x}, {y})) / nullif(len(list_distinct(list_concat({x}, {y}))), 0)::DOUBLE, 0.0)"


RERANK_QUERY = "small red widget"


# Only parts with a vector of their number can be in the result.
@query(f"""
WITH o AS (SELECT vec_id AS id, {SQL_COSINE} AS near, p_name AS title FROM embeddings JOIN part ON p_partkey = vec_id),
p AS (SELECT id, near, {sql_trigram_similarity('title', f"'{RERANK_QUERY}'")} AS trgm, len(list_intersect(string_split(title, ' '), ['small', 'red', 'widget'])) > 0 AS o FROM o),
q AS (SELECT id, near, trgm, o, greatest(trgm, CASE WHEN o THEN 0.5 ELSE 0.0 END) AS word FROM p),
c AS ((SELECT id FROM q ORDER BY near DESC, id LIMIT 120) UNION (SELECT id FROM q WHERE o OR trgm > 0.2 ORDER BY word DESC, id LIMIT 80))
SELECT id, round(near + 0.1 * word, 9) AS score FROM q WHERE id IN (SELECT id FROM c) ORDER BY near + 0.1 * word DESC, id LIMIT 10""")
def sql_rerank(spark: SparkSession, d: str) -> DataFrame:
    titles = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    index = _embeddings(spark, d).join(titles, "id").withColumn("keywords", F.split("title", " "))
    return retrieval.sql_rerank(index, VECTOR, RERANK_QUERY, 10).select("id", rounded(F.col("score")).alias("score"))


@query(f"SELECT p_partkey, round({sql_trigram_similarity('p_name', 'p_type')}, 9) AS score FROM part")
def trigram_similarity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", rounded(text.trigram_similarity(F.col("p_name"), F.col("p_type"))).alias("score"))


@query(f"SELECT vec_id, round({SQL_COSINE}, 9) AS score FROM embeddings")
def cosine_scan(spark: SparkSession, d: str) -> DataFrame:
    literal = F.array(*map(F.lit, VECTOR))
    return table(spark, d, "embeddings").select("vec_id", rounded(text.cosine(F.col("embedding"), literal)).alias("score"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: length(w) >= 2), [lang]))), '|') AS keywords FROM documents""")
def tokens_keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(retrieval.index_keywords(F.col("text"), F.col("lang"))), "|").alias("keywords"))


# ---- names and pairs --------------------------------------------------------------------------------

SQL_NAME = "regexp_replace(regexp_replace(regexp_replace({0}, '[(（]\\s*(재|사|주|법인)\\s*[)）]', '', 'g'), '서울특별시|서울시', '서울', 'g'), '[^0-9A-Za-z가-힣]', '', 'g')"
SQL_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
SQL_HOST = "regexp_extract(url, '://([^/?#]+)', 1)"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    html, url = F.col("html"), F.col("url")
    return table(spark, d, "pages").select(
        F.col("page_id").alias("id"), F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("name"), F.regexp_extract(url, "://([^/?#]+)", 1).alias("org")
    )


SQL_PAGES = f"n AS (SELECT page_id AS id, {SQL_NAME.format(SQL_TITLE)} AS name, {SQL_NAME.format(SQL_HOST)} AS org FROM pages)"
SQL_CLASSES = "c AS (SELECT name, org, min(id) AS rep, count(*) AS copies FROM n WHERE name <> '' OR org <> '' GROUP BY ALL)"
SQL_LIKE = "CASE WHEN greatest(length({0}), length({1})) = 0 THEN 1.0 ELSE 1 - levenshtein({0}, {1}) / greatest(length({0}), length({1}))::DOUBLE END"


@query(f"SELECT doc_id, {SQL_NAME.format('text')} AS name FROM documents")
def normalize_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.normalize_name(F.col("text")).alias("name"))


@query(f"WITH {SQL_PAGES}, {SQL_CLASSES} SELECT rep, copies FROM c")
def name_classes(spark: SparkSession, d: str) -> DataFrame:
    return ingest.name_classes(_pages(spark, d), "id", F.col("name"), F.col("org")).select("rep", "copies")


@query(f"WITH {SQL_PAGES}, {SQL_CLASSES} SELECT id AS page_id, coalesce(rep, id) AS rep FROM n LEFT JOIN c ON n.name IS NOT DISTINCT FROM c.name AND n.org IS NOT DISTINCT FROM c.org")
def name_members(spark: SparkSession, d: str) -> DataFrame:
    return ingest.name_members(_pages(spark, d), "id", F.col("name"), F.col("org")).withColumnRenamed("id", "page_id")


@query(
    f"WITH {SQL_PAGES}, {SQL_CLASSES}, s AS (SELECT a.rep AS a, b.rep AS b, ({SQL_LIKE.format('a.name', 'b.name')} + {SQL_LIKE.format('a.org', 'b.org')}) / 2 AS score "
    "FROM c a JOIN c b ON a.rep < b.rep) SELECT a, b, round(score, 9) AS score FROM s WHERE score >= 0.85"
)
def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    classes = ingest.name_classes(_pages(spark, d), "id", F.col("name"), F.col("org"))
    return ingest.near_duplicates(classes).select("a", "b", rounded(F.col("score")).alias("score"))


SQL_PAIR = f"""CASE WHEN (l.name = '' AND l.org = '') OR (r.name = '' AND r.org = '') THEN 0.0 WHEN l.name = r.name AND l.org = r.org THEN 1.0
 ELSE ({SQL_LIKE.format('l.name', 'r.name')} + {SQL_LIKE.format('l.org', 'r.org')}) / 2 END"""
# Two catalogues out of the pages: all of them on the left; on the right every second page under a changed title or host, and the suppliers.
SQL_COVER = f"""n0 AS (SELECT page_id AS id, {SQL_TITLE} AS name, {SQL_HOST} AS org FROM pages),
l AS (SELECT min(id) AS id, {SQL_NAME.format('name')} AS name, {SQL_NAME.format('org')} AS org FROM n0 GROUP BY ALL),
r0 AS (SELECT id, CASE id % 4 WHEN 0 THEN name || ' 2' ELSE name END AS name, CASE id % 6 WHEN 0 THEN 'www.' || org ELSE org END AS org FROM n0 WHERE id % 2 = 0
 UNION ALL SELECT s_suppkey + 1000000000, s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey),
r AS (SELECT id, {SQL_NAME.format('name')} AS name, {SQL_NAME.format('org')} AS org FROM r0),
m AS (SELECT r.id AS right_id, l.id AS left_id, {SQL_PAIR} AS score FROM r CROSS JOIN l),
m1 AS (SELECT right_id, left_id, score FROM m WHERE score >= 0.85 QUALIFY row_number() OVER (PARTITION BY right_id ORDER BY score DESC, left_id) = 1),
b AS (SELECT r.id AS right_id, left_id, coalesce(score, 0.0) AS score FROM r LEFT JOIN m1 ON right_id = r.id)"""


# Each page against the one with the next number (0 if there is none): titles and hosts.
@query(
    f"WITH {SQL_PAGES} SELECT l.id AS page_id, CASE WHEN r.id IS NULL THEN 0.0 ELSE round({SQL_PAIR}, 9) END AS score FROM n l LEFT JOIN n r ON r.id = l.id + 1"
)
def pair_similarity(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d)
    other = pages.select((F.col("id") - 1).alias("id"), F.col("name").alias("name_b"), F.col("org").alias("org_b"))
    score = text.pair_similarity(F.col("name"), F.col("org"), F.col("name_b"), F.col("org_b"))
    return pages.join(other, "id", "left").select(F.col("id").alias("page_id"), rounded(score).alias("score"))


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    left, key = _pages(spark, d), F.col("id")
    changed = left.filter(key % 2 == 0).select(
        "id", F.when(key % 4 == 0, F.concat("name", F.lit(" 2"))).otherwise(F.col("name")).alias("name"), F.when(key % 6 == 0, F.concat(F.lit("www."), "org")).otherwise(F.col("org")).alias("org")
    )
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("org"))
    others = table(spark, d, "supplier").join(nations, "s_nationkey").select((F.col("s_suppkey") + 1000000000).alias("id"), F.col("s_name").alias("name"), "org")
    return coverage.best_matches(left, changed.unionByName(others))


@query(f"WITH {SQL_COVER} SELECT right_id, left_id, round(score, 9) AS score FROM b")
def coverage_best_match(spark: SparkSession, d: str) -> DataFrame:
    return _coverage(spark, d).select("right_id", "left_id", rounded(F.col("score")).alias("score"))


@query(
    f"WITH {SQL_COVER} SELECT count(*) AS total, count(*) FILTER (score >= 1) AS matched, count(*) FILTER (score >= 0.85 AND score < 1) AS manual_review, "
    "count(*) FILTER (score < 0.85) AS only_right, round(count(*) FILTER (score < 0.85) / count(*)::DOUBLE, 9) AS gap_rate FROM b"
)
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    return coverage.report(_coverage(spark, d)).withColumn("gap_rate", rounded(F.col("gap_rate")))


# ---- ingest -----------------------------------------------------------------------------------------


@query("""WITH u AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS last_modified, o_orderkey AS ordinal FROM orders
UNION ALL SELECT o_orderkey, o_orderpriority, strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d'), o_orderkey + 1000000000 FROM orders WHERE o_orderkey % 2 = 0)
SELECT o_orderkey, o_orderstatus, last_modified, count(*) OVER (PARTITION BY o_orderkey) AS copies FROM u
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY last_modified IS NOT NULL DESC, last_modified DESC, ordinal DESC) = 1""")
def primary_dedupe(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    a = o.select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3 != 0, day).alias("last_modified"), F.col("o_orderkey").alias("ordinal"))
    before = F.date_format(F.col("o_orderdate") - F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd")
    b = o.filter("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_orderpriority").alias("o_orderstatus"), before.alias("last_modified"), (F.col("o_orderkey") + 1000000000).alias("ordinal"))
    return ingest.newest(a.unionByName(b), ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "last_modified", "copies")


@query(f"""WITH t AS (SELECT doc_id, source, lang, {SQL_NAME.format('text')} AS name FROM documents),
k AS (SELECT DISTINCT name FROM t WHERE source <> 'src1' AND lang = 'en' AND name <> '')
SELECT doc_id, source FROM t WHERE source <> 'src1' OR source IS NULL OR name NOT IN (SELECT name FROM k)""")
def cross_source_suppress(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return ingest.suppressed(docs, F.col("text"), F.col("source"), "src1", F.col("lang") == "en").select("doc_id", "source")


PLACES = ["강남구", "경기도 광주 중구", "부산 중구", "노원구 거주 청년", " ", "서초구, 서울"]
SQL_OTHERS = "|".join(p for code, _, p in PROVINCES if code != "11")


@query(f"""WITH t AS (SELECT c_custkey, r_name = 'ASIA' AS coded, c_mktsegment = 'BUILDING' AS nationwide, CASE WHEN c_custkey % 7 = 6 THEN n_name ELSE {PLACES}[c_custkey % 7 + 1] END AS place
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT c_custkey, CASE WHEN coded OR nationwide OR (regexp_matches(place, '{"|".join(DISTRICTS)}') AND NOT regexp_matches(place, '{SQL_OTHERS}')) THEN 'pass' WHEN trim(place) <> '' THEN 'non-seoul' ELSE 'unknown-region' END AS verdict FROM t""")
def region_verdict(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    codes = F.when(F.col("r_name") == "ASIA", F.array(F.lit("11"))).otherwise(F.array().cast("array<string>"))
    place = F.coalesce(F.get(F.array(*map(F.lit, PLACES)), (F.col("c_custkey") % 7).cast("int")), F.col("n_name"))
    return rows.select("c_custkey", ingest.region_verdict(codes, F.col("c_mktsegment") == "BUILDING", place).alias("verdict"))


SQL_FNV = "printf('%08x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda x: unicode(x)::BIGINT)), lambda h, x: (xor(h, x) * 16777619) & 4294967295))"
SQL_SNAP = "c_name || '|' || c_mktsegment || '|' || c_nationkey"


def _snapshot_hash() -> Column:
    return text.fnv1a(F.concat_ws("|", "c_name", "c_mktsegment", "c_nationkey"))


@query(f"SELECT c_custkey, {SQL_FNV.format(SQL_SNAP)} AS content_hash FROM customer")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", _snapshot_hash().alias("content_hash"))


@query("SELECT c_custkey AS id, c_custkey % 7 = 0 OR c_custkey % 5 = 0 AS reparse FROM customer")
def incremental_diff(spark: SparkSession, d: str) -> DataFrame:
    now = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), _snapshot_hash().alias("content_hash"))
    changed = F.when(F.col("id") % 7 == 0, F.lit("00000000")).otherwise(F.col("content_hash"))
    return ingest.changed(now, now.filter("id % 5 <> 0").withColumn("content_hash", changed)).select("id", "reparse")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer
UNION ALL SELECT c_custkey + 1000000, 'added' FROM customer WHERE c_custkey % 10 = 0""")
def upsert_snapshot(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    new = old.filter("id % 4 = 0").withColumn("segment", F.lit("new"))
    added = old.filter("id % 10 = 0").select((F.col("id") + 1000000).alias("id"), F.lit("added").alias("segment"))
    return ingest.upsert(old, new.unionByName(added))


# ---- eligibility ------------------------------------------------------------------------------------

SQL_STATUS = f"""CASE WHEN o_orderstatus = 'P' THEN 'now' WHEN s IS NULL AND e IS NULL THEN 'unknown' WHEN e < s THEN 'unknown' WHEN s > DATE '{TODAY}' THEN 'soon'
 WHEN e IS NULL THEN 'now' WHEN e < DATE '{TODAY}' THEN 'closed' WHEN e - DATE '{TODAY}' <= 7 THEN 'soon' ELSE 'now' END"""
SQL_WINDOW = """w AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 11 > 0 THEN o_orderdate::DATE END AS s,
 CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate::DATE + (o_orderkey % 400)::INT - 20 END AS e FROM orders)"""


@query(f"WITH {SQL_WINDOW} SELECT o_orderkey, {SQL_STATUS} AS status FROM w")
def recruit_status(spark: SparkSession, d: str) -> DataFrame:
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "P", "always").otherwise("dated")
    start, end = F.when(key % 11 > 0, day), F.when(key % 5 > 0, F.date_add(day, (key % 400).cast("int") - 20))
    return table(spark, d, "orders").select("o_orderkey", eligibility.recruit_status(kind, start, end, TODAY).alias("status"))


# Each part is a record with one profile: the customer with its number (numbers wrap round the customers there are).
SQL_EVAL = f"""p AS (SELECT p_partkey, CASE WHEN p_size % 7 > 0 THEN p_size END AS lo, CASE WHEN p_size % 5 > 0 THEN p_size + 20 END AS hi,
 p_type = 'PROMO' AS nationwide, p_size % 4 AS ik, CASE WHEN p_size % 4 = 3 THEN p_size * 4.0 ELSE p_retailprice END AS lim, p_partkey % 17 = 0 AS broken, p_partkey % 25 AS code, p_partkey % 6 = 0 AS nocode,
 DATE '{TODAY}' + (p_partkey % 60)::INT - 30 AS e, p_partkey % 13 = 0 AS noe FROM part),
c AS (SELECT c_custkey, c_custkey % 60 AS age, c_acctbal AS bal, CASE WHEN c_custkey % 9 > 0 THEN c_custkey % 230 END AS ratio, c_nationkey AS nat FROM customer),
j AS (SELECT * FROM p JOIN c ON c_custkey = p_partkey % (SELECT max(c_custkey) + 1 FROM customer)),
r AS (SELECT p_partkey, broken,
 CASE WHEN lo IS NULL AND hi IS NULL THEN CASE WHEN nationwide THEN NULL ELSE 'AGE_UNKNOWN' END WHEN age < lo THEN 'AGE_BELOW_MIN' WHEN age > hi THEN 'AGE_ABOVE_MAX' END AS a,
 CASE ik WHEN 0 THEN NULL WHEN 1 THEN 'INCOME_UNKNOWN' WHEN 2 THEN CASE WHEN bal > lim THEN 'INCOME_OVER_LIMIT' END
  ELSE CASE WHEN ratio IS NULL THEN 'INCOME_PROFILE_MISSING' WHEN ratio > lim THEN 'INCOME_OVER_LIMIT' END END AS i,
 CASE WHEN nationwide THEN NULL WHEN nocode THEN 'REGION_UNKNOWN' WHEN code <> nat THEN 'REGION_MISMATCH' END AS g,
 CASE WHEN noe THEN 'unknown' WHEN e < DATE '{TODAY}' THEN 'closed' WHEN e - DATE '{TODAY}' <= 7 THEN 'soon' ELSE 'now' END AS st FROM j),
x AS (SELECT *, CASE st WHEN 'closed' THEN 'RECRUIT_CLOSED' WHEN 'unknown' THEN 'RECRUIT_UNKNOWN' END AS t FROM r),
y AS (SELECT *, CASE WHEN broken THEN ['RECRUIT_UNKNOWN'] ELSE list_filter([a, i, g, t], lambda z: z IS NOT NULL) END AS every,
 ['AGE_BELOW_MIN', 'AGE_ABOVE_MAX', 'INCOME_OVER_LIMIT', 'REGION_MISMATCH', 'RECRUIT_CLOSED'] AS hard FROM x),
z AS (SELECT p_partkey, broken, a, i, g, t, st, list_concat(list_filter(every, lambda q: list_contains(hard, q)), list_filter(every, lambda q: NOT list_contains(hard, q))) AS reasons,
 CASE WHEN len(list_intersect(every, hard)) > 0 THEN 'blocked' WHEN len(every) > 0 THEN 'review' WHEN st = 'soon' THEN 'soon' ELSE 'now' END AS bucket FROM y)"""


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    parts = table(spark, d, "part").select(
        key.alias("id"), F.when(size % 7 > 0, size).cast("double").alias("age_min"), F.when(size % 5 > 0, size + 20).cast("double").alias("age_max"),
        (F.col("p_type") == "PROMO").alias("is_nationwide"),
        F.when(key % 17 != 0, F.struct(
            F.element_at(F.array(*map(F.lit, ("none", "unknown", "amountMax", "medianRatio"))), size % 4 + 1).alias("kind"),
            (size * 4.0).alias("max_ratio"), F.col("p_retailprice").alias("max_amount"), F.lit(None).cast("string").alias("raw"),
        )).alias("income"),
        F.when(key % 6 == 0, F.array().cast("array<string>")).otherwise(F.array((key % 25).cast("string"))).alias("region_codes"),
        F.struct(
            F.lit("dated").alias("kind"), F.lit(None).cast("date").alias("start"),
            F.when(key % 13 > 0, F.date_add(F.lit(TODAY), (key % 60).cast("int") - 30)).alias("end"),
        ).alias("recruit"),
        F.lit(None).cast("string").alias("program_key"),
    )
    empty = F.array().cast("array<string>")
    customers, whose = table(spark, d, "customer"), F.col("c_custkey")
    around = customers.agg(F.max("c_custkey") + 1).first()[0]
    who = customers.select(whose.alias("customer"), F.struct(
        (whose % 60).cast("double").alias("age"), F.col("c_nationkey").cast("string").alias("region_code"),
        F.when(whose % 9 > 0, whose % 230).cast("double").alias("median_ratio"), F.col("c_acctbal").alias("amount"), empty.alias("active_programs"), empty.alias("completed_programs"),
    ).alias("profile"))
    return eligibility.evaluate(parts.withColumn("customer", F.col("id") % around).join(who, "customer"), TODAY)


@query(f"WITH {SQL_EVAL} SELECT bucket, count(*) AS n FROM z GROUP BY bucket")
def eligibility_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d).groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"WITH {SQL_EVAL} SELECT p_partkey AS id, array_to_string(reasons, ',') AS reasons, bucket FROM z")
def reasons_array(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d).select("id", F.array_join("reasons", ",").alias("reasons"), "bucket")


def _axis(name: str, letter: str) -> None:
    def axis(spark: SparkSession, d: str) -> DataFrame:
        at = eligibility.AXES.index(name)
        return _evaluated(spark, d).select("id", F.col("axes")[at]["verdict"].alias("verdict"), F.col("axes")[at]["reason"].alias("reason")).filter("verdict IS NOT NULL")

    axis.__name__ = f"axis_{name}"
    query(
        f"WITH {SQL_EVAL} SELECT p_partkey AS id, CASE WHEN {letter} IS NULL THEN 'pass' WHEN {letter} IN ('AGE_BELOW_MIN', 'AGE_ABOVE_MAX', 'INCOME_OVER_LIMIT', "
        f"'REGION_MISMATCH', 'RECRUIT_CLOSED') THEN 'blocked' ELSE 'review' END AS verdict, {letter} AS reason FROM z WHERE NOT broken"
    )(axis)


for _name, _letter in (("age", "a"), ("income", "i"), ("region", "g"), ("recruit", "t")):
    _axis(_name, _letter)


@query("""WITH g AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE list_filter([CASE WHEN c_custkey % 3 = 0 THEN 'youth_allowance' END, CASE WHEN c_custkey % 5 = 0 THEN 'monthly_rent' END], lambda x: x IS NOT NULL) END AS active,
 CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN ['youth_challenge'] ELSE [] END AS done, ['youth_allowance', 'kuk_chwi', 'other'][c_custkey % 3 + 1] AS program FROM customer)
SELECT c_custkey, array_to_string(list_filter([
 CASE WHEN program = 'other' THEN NULL WHEN active IS NULL OR list_contains(active, program) THEN 'PREREQ_UNKNOWN' WHEN len(list_filter(active, lambda x: x <> program)) > 0 THEN 'DUPLICATE_EXCLUSIVE' END,
 CASE WHEN program <> 'kuk_chwi' THEN NULL WHEN done IS NULL THEN 'PREREQ_UNKNOWN' WHEN NOT list_contains(done, 'youth_challenge') THEN 'PREREQ_NOT_MET' END], lambda x: x IS NOT NULL), ',') AS reasons FROM g""")
def program_rules(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    active = F.when(key % 4 != 0, F.array_compact(F.array(F.when(key % 3 == 0, "youth_allowance"), F.when(key % 5 == 0, "monthly_rent"))))
    done = F.when(key % 6 == 0, None).when(key % 2 == 0, F.array(F.lit("youth_challenge"))).otherwise(F.array().cast("array<string>"))
    program = F.element_at(F.array(F.lit("youth_allowance"), F.lit("kuk_chwi"), F.lit("other")), (key % 3 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(eligibility.rule_reasons(program, active, done), ",").alias("reasons"))


# ---- results ----------------------------------------------------------------------------------------

SQL_TITLED = "t AS (SELECT p_partkey AS id, p_name || ' ' || (1990 + p_partkey % 40) || '년 ' || p_brand AS title, ['now', 'soon', 'review'][p_size % 3 + 1] AS bucket, TIMESTAMP '2024-01-01' + INTERVAL (p_size) DAY AS updated_at, p_size AS points, p_brand AS brand FROM part)"


def _titled(spark: SparkSession, d: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    title = F.concat("p_name", F.lit(" "), (key % 40 + 1990).cast("string"), F.lit("년 "), "p_brand")
    bucket = F.element_at(F.array(F.lit("now"), F.lit("soon"), F.lit("review")), size % 3 + 1)
    updated = F.expr("TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, p_size)")
    return table(spark, d, "part").select(key.alias("id"), title.alias("title"), bucket.alias("bucket"), updated.alias("updated_at"), size.alias("points"), F.col("p_brand").alias("brand"))


SQL_RANK = "CASE bucket WHEN 'now' THEN 3 WHEN 'soon' THEN 2 ELSE 1 END"


@query(f"""WITH {SQL_TITLED}, k AS (SELECT *, {SQL_NAME.format("regexp_replace(title, '(19|20)[0-9][0-9]년?', ' ', 'g')")} AS name,
 list_max(list_transform(regexp_extract_all(title, '(19|20)[0-9][0-9]'), lambda y: y::INT)) AS year FROM t)
SELECT id, bucket FROM k QUALIFY row_number() OVER (PARTITION BY name ORDER BY {SQL_RANK} DESC, year DESC, updated_at DESC, id) = 1""")
def year_variant_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return results.latest_variants(_titled(spark, d)).select("id", "bucket")


@query(f"""WITH {SQL_TITLED}, o AS (SELECT id, brand, bucket, CASE WHEN bucket = 'review' THEN points % 3 ELSE 0 END AS n FROM t)
SELECT id, n AS open_points, row_number() OVER (PARTITION BY brand ORDER BY {SQL_RANK} DESC, n, id) AS position FROM o""")
def result_order(spark: SparkSession, d: str) -> DataFrame:
    codes = F.array(F.lit("AGE_UNKNOWN"), F.lit("INCOME_UNKNOWN"))
    rows = _titled(spark, d).withColumn("reasons", F.slice(codes, 1, F.col("points") % 3)).withColumnRenamed("id", "ordinal")
    shown = results.with_positions(results.in_display_order(rows), ["brand"])
    return shown.select(F.col("ordinal").alias("id"), F.col("open_points").cast("long").alias("open_points"), F.col("position").cast("long").alias("position"))


@query(f"""WITH {SQL_TITLED} SELECT count(DISTINCT {SQL_NAME.format("regexp_replace(title, '(19|20)[0-9][0-9]년?', ' ', 'g')")}) AS n FROM t""")
def headline_count(spark: SparkSession, d: str) -> DataFrame:
    return results.headline_count(_titled(spark, d))


# ---- crawled pages, texts ---------------------------------------------------------------------------


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
 '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+', ' ', 'g')) AS body FROM pages""")
def html_strip_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", parse.strip_tags(F.col("html")).alias("body"))


# The links of a page written as the crawled list writes them; SQL reads the page as it is.
@query("""WITH p AS (SELECT page_id, UNNEST(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)<', 1)) AS key, UNNEST(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)<', 2)) AS title FROM pages)
SELECT page_id, key, replace(replace(replace(replace(replace(replace(trim(title), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' ') AS title,
 NOT regexp_matches(key, '^[0-9]+$') AS native FROM p WHERE trim(key) <> '' AND trim(title) <> ''""")
def html_list_items(spark: SparkSession, d: str) -> DataFrame:
    crawled = F.regexp_replace("html", '<a href="([^"]*)">', "<a href=\"#\" onclick=\"goView('$1');\">")
    rows = table(spark, d, "pages").select("page_id", F.inline(parse.list_items(crawled)))
    return rows.withColumn("native", parse.is_native_key(F.col("key")))


WORD_PATTERNS = {"first": ["th(at|is)", "was"], "second": ["que", "des?\\b"]}


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(text, 'th(at|is)') OR regexp_matches(text, 'was') THEN 'first'
 WHEN regexp_matches(text, 'que') OR regexp_matches(text, 'des?\\b') THEN 'second' END AS domain FROM conversations""")
def classify_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", safety.domain(F.col("text"), WORD_PATTERNS).alias("domain"))


@query("""SELECT conv_id, turn, coalesce(nullif(regexp_extract(text, 'idiot|loser'), ''), nullif(regexp_extract(text, 'th[ae]n.{0,4}er'), '')) AS matched,
 regexp_matches(text, 'idiot|loser') OR regexp_matches(text, 'th[ae]n.{0,4}er') AS crisis FROM conversations""")
def crisis_layer1(spark: SparkSession, d: str) -> DataFrame:
    found = safety.crisis(F.col("text"), patterns=["idiot|loser", "th[ae]n.{0,4}er"])
    return table(spark, d, "conversations").select("conv_id", "turn", found["matched"].alias("matched"), found["crisis"].alias("crisis"))


# What people write, with and without a sign of crisis, after each text; SQL applies the same patterns with another engine.
SAID = ["죽고 싶어요", "배고파 죽겠다", "더는 못 버티겠어", "여행을 떠나고 싶다", "사는 게 의미 없다", "다 끝내 버리고 싶다", "자살 예방", "수면제 다 먹었어", "살기 싫어", "약속을 지켰어", "눈을 안 떴으면", "버틸 힘이 없어"]
SQL_SAID = f"text || ' ' || {SAID}[(conv_id * 5 + turn) % {len(SAID)} + 1]"


@query(f"""SELECT conv_id, turn, coalesce({", ".join(f"nullif(regexp_extract({SQL_SAID}, '{p}'), '')" for p in CRISIS_PATTERNS)}) AS matched FROM conversations""")
def crisis_screen(spark: SparkSession, d: str) -> DataFrame:
    said = F.get(F.array(*map(F.lit, SAID)), ((F.col("conv_id") * 5 + F.col("turn")) % len(SAID)).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", safety.crisis(F.concat("text", F.lit(" "), said))["matched"].alias("matched"))


SQL_COS2 = "list_dot_product(e.embedding::DOUBLE[], a.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])))"


@query(f"SELECT e.vec_id AS id, round(max({SQL_COS2}), 9) AS score, max({SQL_COS2}) >= 0.82 AS hit FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id < 8) a GROUP BY e.vec_id")
def crisis_layer2(spark: SparkSession, d: str) -> DataFrame:
    rows = _embeddings(spark, d)
    return safety.near_anchors(rows, rows.filter("id < 8").orderBy("id")).select("id", rounded(F.col("score")).alias("score"), "hit")


@query("""WITH RECURSIVE e AS (SELECT user_id AS client, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT client, event_id, ts, k, ts AS window_start, 1::BIGINT AS n FROM e WHERE k = 1
 UNION ALL SELECT e.client, e.event_id, e.ts, e.k, CASE WHEN e.ts > f.window_start + INTERVAL 1 DAY THEN e.ts ELSE f.window_start END, CASE WHEN e.ts > f.window_start + INTERVAL 1 DAY THEN 1 ELSE f.n + 1 END
 FROM f JOIN e ON e.client = f.client AND e.k = f.k + 1)
SELECT client, event_id, ts, window_start, n, n <= 3 AS allowed FROM f""")
def rate_limiter(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "events").select(F.col("user_id").alias("client"), "event_id", "ts")
    return limited(requests, 86400, 3)


# ---- parsers over texts built from table columns ----------------------------------------------------


def _case(key: Column, *values: Column) -> Column:
    """The value whose place is the key modulo their number."""
    return F.get(F.array(*values), F.pmod(key, F.lit(len(values))).cast("int"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 8 IN (0, 1, 3) THEN p_size::DOUBLE END AS age_min,
 CASE WHEN p_partkey % 8 IN (0, 1, 2, 5) THEN (p_size + 15)::DOUBLE END AS age_max FROM part""")
def parse_age(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = F.col("p_size"), F.col("p_size") + 15
    t = _case(
        F.col("p_partkey"), _text(lo, "~", hi), _text("만 ", lo, "세~만 ", hi, "세"), _text(hi, "세 이하"), _text("만 ", lo, "세 이상"), _text(lo, "~", hi, " 제한 없음"),
        _text(lo, "세 이상 ", hi, "세 이하"), _text(hi, "~", lo), _none(),
    )
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), parse.parse_age(_none("double"), _none("double"), t).alias("a")).select("id", "a.*")


@query("""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'medianRatio' WHEN 1 THEN 'none' WHEN 3 THEN 'medianRatio' ELSE 'unknown' END AS kind,
 CASE WHEN p_partkey % 6 IN (0, 3) THEN (p_size * 3)::DOUBLE END AS max_ratio FROM part""")
def parse_income(spark: SparkSession, d: str) -> DataFrame:
    ratio = F.col("p_size") * 3
    t = _case(F.col("p_partkey"), _text("중위소득 ", ratio, "% 이하"), _text("소득 무관"), _text("별도 심사 후 결정 ", ratio), _text("중위소득", ratio, " % 또는 소득 무관"), _text("소득과 무관하게 지원"), _none())
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), parse.parse_income(t).alias("i")).select("id", "i.kind", "i.max_ratio")


SQL_CODES, SQL_NAMES = ([p[k] for p in PROVINCES] for k in (0, 1))


@query(f"""WITH t AS (SELECT c_custkey AS id, c_nationkey % 17 AS a, c_custkey % 17 AS b, c_custkey % 5 AS k FROM customer)
SELECT id, array_to_string(CASE k WHEN 0 THEN [{SQL_CODES}[a + 1]] WHEN 1 THEN list_sort(list_distinct([{SQL_CODES}[a + 1], {SQL_CODES}[b + 1]])) WHEN 3 THEN [{SQL_CODES}[b + 1]] ELSE [] END, ',') AS codes, k = 2 AS nationwide FROM t""")
def parse_region(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, SQL_NAMES))
    a, b = F.get(names, (F.col("c_nationkey") % 17).cast("int")), F.get(names, (F.col("c_custkey") % 17).cast("int"))
    t = _case(F.col("c_custkey"), a, _text(a, " ", b), F.lit("전국 거주 청년"), _text(b, " 거주, 전국체전 입상자"), _none())
    r = parse.parse_region(t)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array_join(r["codes"], ",").alias("codes"), r["nationwide"].alias("nationwide"))


@query("""WITH t AS (SELECT o_orderkey AS id, o_orderdate::DATE AS a, o_orderdate::DATE + 40 AS b, o_orderkey % 7 AS k FROM orders)
SELECT id, CASE WHEN k IN (0, 4, 6) THEN 'dated' WHEN k = 1 THEN 'always' ELSE 'unknown' END AS kind, CASE WHEN k IN (0, 4, 6) THEN a END AS start, CASE WHEN k IN (0, 6) THEN b END AS "end" FROM t""")
def parse_recruit(spark: SparkSession, d: str) -> DataFrame:
    key, a = F.col("o_orderkey"), F.to_date("o_orderdate")
    b, day = F.date_add(a, 40), lambda c, p: F.date_format(c, p)
    start = _case(key, _none(), _none(), F.lit("2026-02-30"), day(b, "yyyy-MM-dd"), day(a, "yyyy/M/d"), _none(), day(a, "yyyy.MM.dd"))
    end = _case(key, _none(), _none(), _none(), day(a, "yyyy-MM-dd"), _none(), _none(), day(b, "yyyy-M-d"))
    t = _case(key, _text("접수 ", day(a, "yyyy.M.d"), "~", day(b, "yyyy.MM.dd")), F.lit("연중 상시모집"), _none(), _none(), F.lit("상시"), F.lit("추후 공지"), F.lit("상시"))
    rows = table(spark, d, "orders").select(key.alias("id"), start.alias("s"), end.alias("e"), t.alias("t"))
    return rows.select("id", parse.parse_recruit(F.col("s"), F.col("e"), F.col("t")).alias("r")).select("id", "r.*")


@query("""WITH t AS (SELECT o_orderkey AS id, year(o_orderdate) + 25 AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, o_orderkey % 12 + 1 AS m2, o_orderkey % 8 AS k FROM orders)
SELECT id, CASE k WHEN 0 THEN y || '-12-31' WHEN 1 THEN strftime(last_day(make_date(y::INT, m2::INT, 1)), '%Y-%m-%d') WHEN 2 THEN y || '-06-30'
 WHEN 3 THEN strftime(last_day(make_date((y + CASE WHEN m2 < m THEN 1 ELSE 0 END)::INT, m2::INT, 1)), '%Y-%m-%d')
 WHEN 4 THEN strftime(make_date((y + CASE WHEN m2 < m THEN 1 ELSE 0 END)::INT, m2::INT, 15), '%Y-%m-%d') WHEN 6 THEN printf('%d-%02d-%02d', y, m, d) END AS end_text FROM t""")
def parse_coarse_end(spark: SparkSession, d: str) -> DataFrame:
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    y, m, m2 = F.year(day) + 25, F.month(day), key % 12 + 1
    t = _case(
        key, _text(y - 1, ".01 ~ ", y, "년"), _text(y - 1, ".03 ~ ", y, ".", F.lpad(m2.cast("string"), 2, "0")), _text(y, "년 상반기"), _text(y, ".", m, " ~ ", m2, "월"),
        _text(y, ".", m, ".2 ～ ", m2, ".15"), _text(y, ".", m, " ~"), _text("문의 1577-", y, "9, ", y - 1, ".1.1~", y, "-", m, "-", F.day(day)), _none(),
    )
    return table(spark, d, "orders").select(key.alias("id"), t.alias("t")).select("id", parse.coarse_end(F.col("t")).alias("end_text"))


@query("""SELECT p_partkey AS id, '연령' AS label, '만 ' || p_size || '세 ~ 39세' AS value FROM part UNION ALL SELECT p_partkey, '주관기관', p_brand || ' & ' || p_type FROM part
UNION ALL SELECT p_partkey, '소득', p_name FROM part WHERE p_partkey % 3 = 0""")
def html_label_values(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    table_row = F.when(key % 3 == 0, _text("<table><tr><th scope='row'>소득</th> <td> ", F.col("p_name"), " </td></tr></table>")).otherwise("")
    html = _text(
        "<dl><dt> 연 령 </dt> <dd>만 ", F.col("p_size"), "세 ~ <b>39세</b></dd><dt>주관기관</dt><dd>", F.col("p_brand"), " &amp; ", F.col("p_type"),
        "</dd><dt>연령</dt><dd>둘째</dd></dl><script><dt>x</dt><dd>y</dd></script><style><dt>z</dt><dd>y</dd></style>", table_row,
    )
    return table(spark, d, "part").select(key.alias("id"), F.explode(parse.label_values(html)).alias("label", "value"))


@query("""SELECT p_partkey AS id, 0 AS pos, 'header' AS type, '[필수서류]' AS text FROM part UNION ALL SELECT p_partkey, 1, 'item', '1. ' || p_name FROM part
UNION ALL SELECT p_partkey, 2, 'item', '2. ' || p_type FROM part UNION ALL SELECT p_partkey, 3, 'note', '※ ' || p_size || '세만' FROM part""")
def document_segments(spark: SparkSession, d: str) -> DataFrame:
    t = _text("▶ [필수서류] 1. ", F.col("p_name"), " 2. ", F.col("p_type"), "\n※ ", F.col("p_size"), "세만\n ○ ")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.posexplode(parse.document_segments(t)).alias("pos", "s"))
    return rows.select("id", "pos", "s.*")


@query("""SELECT p_partkey AS id, p_partkey % 7 IN (0, 3, 4) AS grounded FROM part""")
def grounding_check(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    corpus = _text("서울특별시 청년 월세 지원 ", size, "세 ", size * 100, "만원 https://example.org/", F.col("p_partkey"))
    t = _case(
        F.col("p_partkey"), _text("서울 청년의 월세를 돕는 사업이에요. ", size, "세부터 볼 수 있어요."), F.lit("당신은 선정됩니다"), F.lit("수원시 청년을 위한 사업이에요."),
        _text("https://example.org/", F.col("p_partkey"), " 에서 ", size * 100, "만원 내용을 살펴보세요."), _text("월세 지원 사업이에요. ", F.format_number(size * 100, 0), "만원이에요."), _text(size * 100 + 7, "세부터 볼 수 있어요."), F.lit(""),
    )
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), safety.grounded(t, corpus).alias("grounded"))
