"""Registered queries over what is written, read back, looked up or screened: pages, snapshots, signatures, requests, free input."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlake.functions.constants import CRISIS_PATTERNS, DOCUMENTS, DOMAIN_PATTERNS, PROVINCES
from grantlake.operators import eligibility, ingest, results, retrieval, safety
from grantlake.plans.search import Node, search
from grantlake.queries import SAID, SQL_SAID, _case, _none, _text, query, table
from grantlake.sources import files
from grantlake.sources.keyed import KeyedStore
from grantlake.sources.shared import shared_folder

SQL_CODES = [p[0] for p in PROVINCES]

# ---- pages and snapshots ----------------------------------------------------------------------------


@query("SELECT p_partkey::VARCHAR AS id, p_name AS title, CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE END AS age_min, CASE WHEN p_size % 3 > 0 THEN p_type END AS category FROM part")
def json_pages(spark: SparkSession, d: str) -> DataFrame:
    """Records written as pages, each a file with a JSON array, and read back."""
    size, path = F.col("p_size"), shared_folder(spark)
    record = F.struct(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.when(size % 2 == 0, size.cast("double")).alias("ageMin"),
        F.when(size % 3 > 0, F.col("p_type")).alias("category"), F.lit("x").alias("unknownField"),
    )
    # One array a hundred records, one file an array: each page has a partition of its own.
    pages = table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 100).cast("string").alias("page")).agg(F.to_json(F.collect_list(record)).alias("value"))
    pages.write.partitionBy("page").text(path)
    return files.raw_pages(spark, [path]).select("id", "title", F.col("ageMin").alias("age_min"), "category")


SERVICE_ITEM = "struct<plcyNo: string, plcyNm: string>"


@query("""SELECT o_orderkey AS ordinal, o_orderkey::VARCHAR AS number, o_orderpriority AS name, CASE WHEN (o_orderkey // 100) % 5 = 0 THEN 1000 + (o_orderkey // 100) ELSE 0 END::INT AS total
FROM orders WHERE (o_orderkey // 100) % 5 < 4""")
def service_items(spark: SparkSession, d: str) -> DataFrame:
    """Response bodies in the four shapes that services use, and broken ones, a hundred items each."""
    key, page = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 100)
    item = F.struct(key.cast("string").alias("plcyNo"), F.col("o_orderpriority").alias("plcyNm"))
    listed = table(spark, d, "orders").select(page.alias("page"), F.struct(key.alias("k"), item.alias("i")).alias("e")).groupBy("page").agg(F.array_sort(F.collect_list("e")).alias("e"))
    listed = listed.select("page", F.to_json(F.transform("e", lambda x: x["i"])).alias("list"))
    body = _case(
        F.col("page"), _text('{"result": {"pagging": {"totCount": ', F.col("page") + 1000, '}, "youthPolicyList": ', F.col("list"), "}}"), F.col("list"), _text('{"items": ', F.col("list"), "}"),
        _text('{"data": ', F.col("list"), "}"), F.lit("<html>503</html>"),
    )
    bodies = listed.select("page", body.alias("body"))
    totals = bodies.select(F.col("page").alias("_page"), files.total_count(F.col("body")).alias("total"))
    items = files.service_pages(bodies, SERVICE_ITEM).withColumn("page", F.shiftright("ordinal", 20))
    ordinal = F.col("page") * 100 + F.col("ordinal").bitwiseAND((1 << 20) - 1)
    return items.join(totals, F.col("page") == F.col("_page")).select(ordinal.alias("ordinal"), F.col("plcyNo").alias("number"), F.col("plcyNm").alias("name"), "total")


@query("""SELECT s_suppkey AS id, s_name AS name, 'own' AS origin FROM supplier UNION ALL SELECT c_custkey, c_name, 'other' FROM customer WHERE c_custkey % 10 = 0
UNION ALL SELECT -1, 'customers are down: ' || (SELECT count(*) FROM customer WHERE c_custkey % 10 = 0), 'warning' UNION ALL SELECT -2, '{"id":0,"name":"' || s_name || '"}', 'report' FROM supplier WHERE s_suppkey = 0""")
def snapshot_sources(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot written over an older one; joined by a second source that can be read and by one that can't; a report of its first row."""
    own = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    other = table(spark, d, "customer").filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    path = shared_folder(spark)
    files.overwrite_snapshot(own.withColumn("name", F.lit("old")), path)
    files.overwrite_snapshot(own, path)
    stored = files.snapshot(spark, path, own.schema).unionByName(files.snapshot(spark, f"{path}-none", own.schema)).withColumn("origin", F.lit("own"))
    both, _ = files.union_isolated(stored, lambda: other.withColumn("origin", F.lit("other")))
    said = f"customers are down: {other.count()}"
    alone, warning = files.union_isolated(stored, lambda: other.withColumn("origin", F.when(F.col("id") < 0, "x").otherwise(F.raise_error(F.lit(said)).cast("string"))))
    told = said if said in (warning or "") else "no warning"
    notes = spark.createDataFrame([(-1, told, "warning"), (-2, files.json_report(own.orderBy("id"), 1)[0], "report")], both.schema)
    return both.unionByName(alone.join(stored, "id", "left_anti")).unionByName(notes)


@query("SELECT o_orderkey AS id, o_orderpriority AS name FROM orders WHERE o_orderkey >= (SELECT max(o_orderkey) FROM orders) // 2 QUALIFY row_number() OVER (ORDER BY o_orderkey) <= 2500")
def keyed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Up to five pages in a row of a keyed store, each behind the last key of the one before."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"))
    store = KeyedStore(spark, shared_folder(spark))
    store.upsert(rows)
    after, pages = rows.agg(F.max("id")).first()[0] // 2 - 1, None
    for _ in range(5):
        page = store.page(after, 500)
        pages = page if pages is None else pages.unionByName(page)
        if (after := page.agg(F.max("id")).first()[0]) is None:
            break
    return pages


# ---- signatures -------------------------------------------------------------------------------------

SQL_INCOME = "CASE p_partkey % 3 WHEN 0 THEN '중위소득 ' || (p_size * 2) || '% 이하' WHEN 1 THEN '소득 무관' ELSE '' END"
SQL_PLACE = "CASE WHEN p_partkey % 5 = 0 THEN '전국 거주 청년' ELSE '서울특별시 부산광역시' END"


@query(f"""SELECT p_partkey AS id, concat_ws('|', 'ageMax=' || (p_size + 15), 'ageMin=' || p_size, 'category=' || CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END,
 'incomeKind=' || CASE p_partkey % 3 WHEN 0 THEN 'medianRatio' WHEN 1 THEN 'none' ELSE 'unknown' END, 'incomeMaxAmount=', 'incomeMaxRatio=' || CASE WHEN p_partkey % 3 = 0 THEN (p_size * 2)::VARCHAR ELSE '' END,
 'incomeRaw=' || {SQL_INCOME}, 'isNationwide=' || (p_partkey % 5 = 0)::VARCHAR, 'rawText=ageText=' || p_size || '~' || (p_size + 15), 'incomeText=' || {SQL_INCOME}, 'regionText=' || {SQL_PLACE}, 'recruitText=',
 'recruitStartText=2026-01-01', 'recruitEndText=2026-03-31', 'recruitEnd=2026-03-31', 'recruitKind=dated', 'recruitStart=2026-01-01', 'regionCodes=' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '11,26' END,
 'regionText=' || {SQL_PLACE}, 'summary=', 'title=' || p_brand || ' ' || p_name) AS signature FROM part""")
def signature_values(spark: SparkSession, d: str) -> DataFrame:
    """What decides eligibility, as the text that is hashed."""
    key, size = F.col("p_partkey"), F.col("p_size")
    raw = table(spark, d, "part").select(
        key.cast("string").alias("id"), _text("  ", F.col("p_brand"), " \t ", F.col("p_name"), " ").alias("title"), _text(size, "~", size + 15).alias("ageText"),
        _case(key, _text("중위소득  ", size * 2, "%  이하"), F.lit("소득 무관"), _none()).alias("incomeText"), F.when(key % 5 == 0, "전국 거주  청년").otherwise("서울특별시  부산광역시").alias("regionText"),
        F.lit("2026-01-01").alias("recruitStartText"), F.lit("2026-03-31").alias("recruitEndText"), F.when(key % 2 == 0, F.col("p_type")).alias("category"),
    )
    rows = ingest.normalized(raw)
    own = {n: F.col(n) for n in rows.columns}
    return rows.select(F.col("id").cast("long").alias("id"), ingest.content_signature(own, {k: F.col(f"raw.{k}") for k in ingest.HASHED_TEXTS}).alias("signature"))


# ---- requests, lookups, free input ------------------------------------------------------------------


@query(f"""WITH t AS (SELECT conv_id, turn, trim(repeat(text || ' ', 1 + (turn % 3)::INT), ' ') AS said FROM conversations)
SELECT conv_id, turn, substring(said, 1, 500) AS query, CASE (conv_id + turn) % 8 WHEN 2 THEN 5 WHEN 3 THEN 30 WHEN 4 THEN 1 WHEN 5 THEN 2 ELSE 10 END::INT AS top_k, CASE conv_id % 3 WHEN 0 THEN '11' END AS region,
 CASE WHEN turn % 2 = 0 THEN 'src1' END AS categories, CASE conv_id % 3 WHEN 0 THEN ' 11 ' END AS usable,
 CASE WHEN conv_id % 12 < 10 THEN {[x[2] for x in DOCUMENTS]}[conv_id % 12 + 1] END AS issuer, CASE WHEN conv_id % 19 < 17 THEN {SQL_CODES}[conv_id % 19 + 1] END AS center FROM t""")
def request_values(spark: SparkSession, d: str) -> DataFrame:
    """Requests within their limits, and what is looked up by code: a document, a center."""
    conv, turn = F.col("conv_id"), F.col("turn")
    text = _text(" ", F.repeat(F.concat("text", F.lit(" ")), (turn % 3 + 1).cast("int")))
    k = F.get(F.array(*[F.lit(x).cast("string") for x in (None, "0", "5", "99", "-3", "2.7", "ten", "NaN")]), ((conv + turn) % 8).cast("int"))
    code = _case(conv, F.lit(" 11 "), F.lit(" "), _none())
    request = retrieval.clamped(text, k, code, F.when(turn % 2 == 0, F.array(F.lit("src1"))).otherwise(F.array().cast("array<string>")))
    documents = F.get(F.array(*[F.lit(x[0]) for x in DOCUMENTS], F.lit("unknown"), F.lit("")), (conv % 12).cast("int"))
    centers = F.get(F.array(*[F.lit(f" {c}") for c in SQL_CODES], F.lit("99"), F.lit("")), (conv % 19).cast("int"))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", request["query"].alias("query"), request["top_k"].alias("top_k"), request["region"].alias("region"), F.get(request["categories"], F.lit(0)).alias("categories"),
        eligibility.usable_region(code).alias("usable"), results.document_of(documents)["issuer"].alias("issuer"), results.center_of(centers)["region_code"].alias("center"),
    )


ANSWERS = ['{"domain": "mentalHealth"}', '{"domain": "work"}', "broken", None]
TROUBLES = ["", " 요즘 너무 무기력해", " 상담 받고 싶어"]
SQL_MATCHED = ", ".join(f"nullif(regexp_extract(said, '{p}'), '')" for p in CRISIS_PATTERNS)
SQL_DOMAIN = " OR ".join(f"regexp_matches(said, '{p}')" for p in DOMAIN_PATTERNS["mentalHealth"])


@query(f"""WITH t AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 4 THEN ' ' ELSE {SQL_SAID} || {TROUBLES}[conv_id % 3 + 1] END AS said, turn % 4 AS k FROM conversations),
m AS (SELECT *, coalesce({SQL_MATCHED}) AS matched, {SQL_DOMAIN} AS named FROM t)
SELECT conv_id, turn, matched IS NOT NULL AS crisis, matched, CASE WHEN matched IS NULL AND trim(said) <> '' AND (named OR k = 0) THEN 'mentalHealth' END AS domain,
 CASE WHEN matched IS NOT NULL OR trim(said) = '' THEN 'none' WHEN named THEN 'keyword' WHEN k = 0 THEN 'llm' ELSE 'none' END AS source,
 CASE WHEN matched IS NOT NULL OR trim(said) = '' THEN NULL WHEN named THEN 1.0::DOUBLE WHEN k = 0 THEN 0.6::DOUBLE END AS confidence FROM m""")
def free_input(spark: SparkSession, d: str) -> DataFrame:
    """The crisis screen before any classification, then keywords, then a model's answer."""
    conv, turn = F.col("conv_id"), F.col("turn")
    said = F.concat("text", F.lit(" "), F.get(F.array(*map(F.lit, SAID)), ((conv * 5 + turn) % len(SAID)).cast("int")), _case(conv, *map(F.lit, TROUBLES)))
    found = safety.free_input(F.when(conv % 5 == 4, " ").otherwise(said), _case(turn, *[F.lit(a).cast("string") for a in ANSWERS]))
    return table(spark, d, "conversations").select("conv_id", "turn", found.alias("f")).select("conv_id", "turn", "f.*")


# ---- the search as a whole --------------------------------------------------------------------------

TODAY = date(2026, 6, 24)
NEEDS = Node("root", kind="entry", children=[Node("ring", "red ring", allowed=["ECONOMY", "SMALL"], boost_categories=["SMALL"], boost_words=["ring"]), Node("help", "help", kind="safety")])


@query("""WITH t AS (SELECT p_partkey AS id, p_name AS title, p_type AS category, p_size AS z FROM part WHERE p_type IN ('ECONOMY', 'SMALL') AND p_size % 3 < 2),
k AS (SELECT *, list_max(list_transform(['red', 'ring'], lambda w: list_max(list_transform(list_append(string_split(title, ' '), title), lambda t: CASE WHEN contains(t, w) OR contains(w, t) THEN 1.0
 ELSE 1 - levenshtein(w, replace(t, ' ', '')) / greatest(length(w), length(replace(t, ' ', '')))::DOUBLE END)))) AS s FROM t),
r AS (SELECT *, row_number() OVER (ORDER BY s DESC, id::VARCHAR) - 1 AS r FROM k WHERE s >= 0.6 QUALIFY r < 240),
b AS (SELECT *, 1.0 / (60 + r) + CASE WHEN category = 'SMALL' THEN 0.5 ELSE 0 END + CASE WHEN list_contains(string_split(title, ' '), 'ring') THEN 0.5 ELSE 0 END AS score FROM r ORDER BY score DESC, id::VARCHAR LIMIT 30),
e AS (SELECT *, (z % 7 = 0)::INT AS unknown FROM b WHERE 30 <= z + 20),
y AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY title ORDER BY unknown, id::VARCHAR) = 1)
SELECT id::VARCHAR AS id, CASE WHEN unknown = 1 THEN 'review' ELSE 'now' END AS bucket FROM y""")
def guided_search(spark: SparkSession, d: str) -> DataFrame:
    """A need of the tree searched over all parts: candidates of the region, fusion with boosts, eligibility, no blocked row, one row a title."""
    key, size = F.col("p_partkey"), F.col("p_size")
    catalogue = table(spark, d, "part").select(
        key.cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_name").alias("text"), F.split("p_name", " ").alias("keywords"), F.col("p_type").alias("category"),
        F.lit(0.0).alias("age_min"), (size + 20).cast("double").alias("age_max"),
        F.struct(F.when(size % 7 == 0, "unknown").otherwise("none").alias("kind"), _none("double").alias("max_ratio"), _none("double").alias("max_amount"), _none().alias("raw")).alias("income"),
        _case(size, F.array(F.lit("11")), F.array().cast("array<string>"), F.array(F.lit("26"))).alias("region_codes"), (size % 3 == 1).alias("is_nationwide"),
        F.struct(F.lit("always").alias("kind"), _none("date").alias("start"), _none("date").alias("end")).alias("recruit"), _none().alias("program_key"), _none("array<double>").alias("vector"), F.lit(TODAY).cast("timestamp").alias("updated_at"),
    )
    return search(catalogue, NEEDS, "ring", {"age": 30.0, "region_code": "11"}, TODAY, k=30).rows.select("id", "bucket")
