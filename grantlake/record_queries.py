"""More registered queries: raw records, ingest as a whole, stored rows, small values. Texts are built from table columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlake.functions import parse, text
from grantlake.functions.constants import DOCUMENTS, PROVINCES
from grantlake.operators import eligibility, ingest, results, retrieval
from grantlake.queries import SQL_NAME, _case, _none, _text, query, rounded, table
from grantlake.sources import files
from grantlake.sources.shared import cut_lineage

NOW = datetime(2026, 6, 24)
SQL_CODES, SQL_PLACES = ([p[k] for p in PROVINCES] for k in (0, 1))

# ---- ingest -----------------------------------------------------------------------------------------

# Customers stand for arriving records: ids repeat, some are missing, places pass, fail or are unknown, titles meet across sources.
SQL_RAW = f"""w AS (SELECT c_custkey AS ordinal, CASE WHEN c_custkey % 50 > 0 THEN (c_custkey % 1000)::VARCHAR END AS id, 'Aid ' || c_mktsegment || ' (' || c_custkey % 97 || ')' AS title,
 c_custkey % 5 AS k, CASE WHEN c_custkey % 3 > 0 THEN 'seoul-youth' ELSE 'ontong' END AS source, CASE WHEN c_custkey % 4 > 0 THEN '2026-0' || (1 + c_custkey % 9) || '-01' END AS lm, c_nationkey FROM customer),
u AS (SELECT *, count(*) OVER (PARTITION BY source, id) AS copies FROM w WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, id ORDER BY lm IS NOT NULL DESC, lm DESC, ordinal DESC) = 1),
v AS (SELECT *, CASE WHEN k IN (0, 1, 4) THEN 'pass' WHEN k = 2 THEN 'non-seoul' ELSE 'unknown-region' END AS verdict, {SQL_NAME.format("title")} AS name FROM u),
s AS (SELECT *, source = 'seoul-youth' AND name IN (SELECT name FROM v WHERE verdict = 'pass' AND source <> 'seoul-youth' AND k IN (0, 1) AND name <> '') AS dup FROM v WHERE verdict = 'pass'),
r AS (SELECT * FROM s WHERE NOT dup), p AS (SELECT * FROM r WHERE id::INT % 2 = 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY ordinal DESC) = 1),
q AS (SELECT r.*, p.id IS NULL OR r.id::INT % 7 = 0 OR r.title <> p.title OR r.lm IS DISTINCT FROM p.lm OR r.k <> p.k AS reparse FROM r LEFT JOIN p USING (id))"""


def _raw(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    place = _case(key, F.lit("서울특별시"), F.lit("전국 거주 청년"), F.lit("부산광역시"), _none(), F.lit("강남구 거주"))
    return table(spark, d, "customer").select(
        key.alias("ordinal"), F.when(key % 50 > 0, (key % 1000).cast("string")).alias("id"), _text("Aid ", F.col("c_mktsegment"), " (", key % 97, ")").alias("title"), place.alias("regionText"),
        F.when(key % 3 > 0, "seoul-youth").otherwise("ontong").alias("source"), F.when(key % 4 > 0, _text("2026-0", key % 9 + 1, "-01")).alias("lastModified"), F.col("c_mktsegment").alias("category"),
    )


def _ingested(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A second run: of the first one's rows those with an id divisible by 7 changed, and those with an even id are gone.

    A stored row is found by its id alone, whatever its source; of two with one id the last to arrive counts.
    """
    raw, now = _raw(spark, d), F.lit(NOW)
    first, _ = ingest.ingest(raw, spark.createDataFrame([], "id string"), F.lit(datetime(2026, 1, 1)), "city")
    number = F.col("id").cast("int")
    before = cut_lineage(first.filter(number % 2 == 1).withColumn("content_hash", F.when(number % 7 == 0, "00000000").otherwise(F.col("content_hash"))))
    explain = lambda rows: rows.withColumn("explanation", ingest.fallback_explanation(F.col("title")))
    return ingest.ingest(raw, before, now, "city", explain=explain, order="ordinal")


@query(f"""WITH {SQL_RAW}
SELECT (SELECT count(*) FROM w WHERE id IS NULL) AS dropped_no_id, (SELECT count(*) FROM v WHERE verdict = 'non-seoul') AS dropped_non_seoul,
 (SELECT count(*) FROM v WHERE verdict = 'unknown-region') AS dropped_unknown_region, (SELECT sum(copies - 1)::BIGINT FROM u) AS merged_duplicates,
 (SELECT count(*) FROM s WHERE dup) AS suppressed_cross_source, (SELECT count(*) FROM q WHERE reparse) AS reparsed""")
def ingest_counts(spark: SparkSession, d: str) -> DataFrame:
    return _ingested(spark, d)[1]


@query(f"""WITH {SQL_RAW}
SELECT id, source, ordinal AS arrived, reparse, CASE WHEN reparse THEN '2026-06-24' ELSE '2026-01-01' END AS updated,
 title || ' 정책과 관련이 있어 보여요. 자세한 자격 조건은 원문에서 확인해 주세요. (추정)' AS explanation FROM q""")
def ingest_rows(spark: SparkSession, d: str) -> DataFrame:
    return _ingested(spark, d)[0].select("id", "source", F.col("ordinal").alias("arrived"), "reparse", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"), "explanation")


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'medianRatio' WHEN 1 THEN 'none' WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN 'UNKNOWN' ELSE 'UNKNOWN' END AS income_kind,
 CASE WHEN p_partkey % 5 = 0 THEN p_size::DOUBLE END AS income_value, CASE WHEN p_partkey % 5 < 4 AND p_size % 2 = 0 THEN 'required' ELSE 'UNKNOWN' END AS household,
 CASE WHEN p_partkey % 5 < 4 THEN 'allowed' ELSE 'UNKNOWN' END AS duplicates, CASE WHEN p_partkey % 5 < 4 THEN p_name END AS purpose FROM part""")
def narrow_output(spark: SparkSession, d: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    income = _case(key, _text('{"kind": "medianRatio", "value": ', size, '}'), F.lit('{"kind": "none", "value": 3}'), F.lit('{"kind": "medianRatio", "value": "120"}'), F.lit('{"kind": "salary", "value": 1}'), F.lit("null"))
    known = _text('{"householdSeparation": "', F.when(size % 2 == 0, "required").otherwise("maybe"), '", "incomeCriterion": ', income, ', "duplicateParticipation": "allowed", "chunks": {"purpose": "', F.col("p_name"), '"}}')
    rows = table(spark, d, "part").select(key.alias("id"), F.when(key % 5 == 4, "{broken").otherwise(known).alias("answer"))
    return rows.select("id", ingest.narrowed(F.col("answer")).alias("n")).select("id", "n.income_kind", "n.income_value", "n.household", "n.duplicates", "n.purpose")


@query("""SELECT p_partkey AS id, p_brand || chr(10) || '만 19세' || chr(10) || '중위소득 50%' AS parse_input, p_brand || ' 19 34 만 19세' AS corpus, p_brand || ' 정책과 관련이 있어 보여요. 자세한 자격 조건은 원문에서 확인해 주세요. (추정)' AS fallback FROM part""")
def model_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.normalized(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("title"), F.lit("만 19세").alias("regionText"), F.lit("중위소득 50%").alias("incomeText"), F.lit("19~34").alias("ageText")))
    return rows.select(F.col("id").cast("long").alias("id"), ingest.parse_input(rows).alias("parse_input"), ingest.grounding_corpus(rows).alias("corpus"), ingest.fallback_explanation(F.col("title")).alias("fallback"))


# ---- adapters ---------------------------------------------------------------------------------------


@query(f"""WITH t AS (SELECT o_orderkey AS k, o_orderdate::DATE AS a FROM orders)
SELECT k::VARCHAR AS id, CASE WHEN k % 4 > 0 AND k % 30 > 0 THEN (k % 30)::DOUBLE END AS age_min, CASE WHEN k % 3 = 0 THEN 'none' ELSE 'unknown' END AS income,
 CASE k % 3 WHEN 0 THEN {SQL_CODES}[k % 17 + 1] WHEN 1 THEN '' ELSE '' END AS codes, k % 3 = 1 AS nationwide,
 CASE k % 5 WHEN 0 THEN 'dated' WHEN 1 THEN 'dated' WHEN 2 THEN 'always' ELSE 'unknown' END AS recruit, CASE WHEN k % 5 IN (0, 1) THEN a END AS start,
 CASE WHEN k % 7 = 0 THEN '마음건강' ELSE '일자리' END AS category, 'https://www.youthcenter.go.kr/youthPolicy/ythPlcyTotalSearch/ythPlcyDetail/' || k AS source_url, strftime(a, '%Y-%m-%d') AS last_modified FROM t""")
def api_records(spark: SparkSession, d: str) -> DataFrame:
    """Items of the primary service, adapted and normalized."""
    key, a = F.col("o_orderkey"), F.to_date("o_orderdate")
    b, day = F.date_add(a, 9), lambda c: F.date_format(c, "yyyyMMdd")
    code = F.get(F.array(*map(F.lit, SQL_CODES)), (key % 17).cast("int"))
    items = table(spark, d, "orders").select(
        key.cast("string").alias("plcyNo"), F.when(key % 7 == 0, "청년 마음건강 지원").otherwise(_text("지원 ", key)).alias("plcyNm"), F.when(key % 4 > 0, (key % 30).cast("string")).otherwise("0").alias("sprtTrgtMinAge"),
        F.when(key % 3 == 0, "0043001").alias("earnCndSeCd"), F.lit("별도 심사").alias("earnEtcCn"), F.lit("일자리").alias("lclsfNm"), _text(day(a), "120000").alias("_raw"),
        _case(key, _text(code, "110,", code, "140"), F.lit(",".join(f"{c}000" for c in SQL_CODES)), F.lit("00123")).alias("zipCd"),
        _case(key, _text(day(a), " ~ ", day(b)), _none(), F.lit("수시 모집"), _none(), _none()).alias("aplyYmd"),
        F.when(key % 5 == 1, day(a)).alias("bizPrdBgngYmd"), F.when(key % 5 == 1, day(b)).alias("bizPrdEndYmd"), F.date_format(a, "yyyy-MM-dd 10:00:00").alias("lastMdfcnDt"), F.lit("http://x.org/").alias("aplyUrlAddr"),
    ).drop("_raw")
    r = ingest.normalized(ingest.from_api(items))
    return r.select(
        "id", "age_min", F.col("income.kind").alias("income"), F.array_join("region_codes", ",").alias("codes"), F.col("is_nationwide").alias("nationwide"),
        F.col("recruit.kind").alias("recruit"), F.col("recruit.start").alias("start"), "category", "source_url", F.col("raw.lastModified").alias("last_modified"),
    )


@query("""WITH t AS (SELECT p_partkey AS k, p_size AS z, p_name AS n, p_type AS c FROM part)
SELECT 'V' || k AS id, n AS title, (19 + z)::DOUBLE AS age_max, 'medianRatio' AS income, (z * 2)::DOUBLE AS max_ratio, '11' AS codes, CASE k % 3 WHEN 0 THEN 'dated' WHEN 1 THEN 'dated' ELSE 'always' END AS recruit,
 CASE k % 3 WHEN 0 THEN DATE '2026-03-09' WHEN 1 THEN DATE '2026-11-30' END AS recruit_end, c AS category, 'https://a.org/infoData/plcyInfo/view.do?plcyBizId=V' || k AS source_url, 'org ' || z AS org FROM t""")
def crawl_records(spark: SparkSession, d: str) -> DataFrame:
    """Detail pages of the crawl, adapted and normalized."""
    key, size = F.col("p_partkey"), F.col("p_size")
    row = lambda label, value: _text("<dt>", label, "</dt>\n<dd>", value, "</dd>")
    period = _case(key, row("사업신청기간", F.lit("2026.3.1 ~ 2026.3.9")), row("사업운영기간", F.lit("2026.3 ~ 11월")), row("신청기간", F.lit("상시")))
    html = _text("<dl>", row("연령", _text(size + 19, "세 이하 (군필 우대)")), row("소득", _text("중위소득 ", size * 2, "% 이하")), row("정책유형", F.col("p_type")), row("운영기관", _text("org ", size)), period, "</dl>")
    pages = table(spark, d, "part").select(_text("V", key).alias("key"), F.col("p_name").alias("title"), html.alias("html"))
    r = ingest.normalized(ingest.from_crawl(pages, "https://a.org/"))
    return r.select("id", "title", "age_max", F.col("income.kind").alias("income"), F.col("income.max_ratio").alias("max_ratio"), F.array_join("region_codes", ",").alias("codes"), F.col("recruit.kind").alias("recruit"), F.col("recruit.end").alias("recruit_end"), "category", "source_url", F.col("raw.orgName").alias("org"))


@query(f"""WITH t AS (SELECT s_suppkey AS k, s_nationkey % 17 AS n, s_name, s_acctbal FROM supplier)
SELECT CASE WHEN k % 11 = 0 THEN 'unknown' ELSE k::VARCHAR END AS id, CASE WHEN k % 7 = 0 THEN '제목 없음' ELSE s_name || ' 지원' END AS title, 'mongttang' AS source,
 CASE k % 4 WHEN 0 THEN 'always' WHEN 1 THEN 'dated' ELSE 'unknown' END AS recruit, CASE WHEN k % 4 = 1 THEN DATE '2026-01-01' + n::INT END AS recruit_end,
 CASE k % 3 WHEN 0 THEN (18 + n)::DOUBLE END AS age_min, CASE k % 3 WHEN 0 THEN (30 + n)::DOUBLE WHEN 1 THEN (40 + n)::DOUBLE END AS age_max,
 CASE k % 5 WHEN 0 THEN 'medianRatio' WHEN 1 THEN 'none' ELSE 'unknown' END AS income, CASE k % 5 WHEN 0 THEN (100 + n)::DOUBLE END AS max_ratio,
 CASE WHEN k % 6 < 4 THEN {SQL_CODES}[n + 1] ELSE '' END AS codes, k % 6 = 4 AS nationwide, 'org ' || n AS org, CASE WHEN k % 2 = 0 THEN 'https://c.org/v?id=' || k END AS source_url FROM t""")
def second_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the second catalogue: some without an id, a title, a period, a region; each text in several forms."""
    key, n = F.col("s_suppkey"), F.col("s_nationkey") % 17
    place = F.get(F.array(*map(F.lit, SQL_PLACES)), n.cast("int"))
    day = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), n.cast("int")), "yyyy.MM.dd")
    items = table(spark, d, "supplier").select(
        F.when(key % 11 > 0, key.cast("string")).when(key % 2 == 0, " ").alias("bizId"), F.when(key % 7 > 0, _text(F.col("s_name"), " 지원 ")).alias("policyName"), _text("org ", n).alias("orgName"),
        _case(key, place, place, place, place, F.lit("전국"), _none()).alias("regionName"), _case(key, _text("만 ", n + 18, "세 ~ ", n + 30, "세"), _text(n + 40, "세 이하"), F.lit("제한 없음")).alias("ageInfo"),
        _case(key, _text("중위소득 ", n + 100, "% 이하"), F.lit("소득 무관"), F.lit("별도 심사"), _none(), F.lit(" ")).alias("incomeInfo"),
        _case(key, F.lit("연중 수시"), _text("2025.12.1 ~ ", day), F.lit("추후 공지"), _none()).alias("applyPeriod"), F.when(key % 2 == 0, _text(" https://c.org/v?id=", key)).alias("detailUrl"),
    )
    r = ingest.normalized(ingest.from_second_catalogue(items))
    return r.select(
        "id", "title", "source", F.col("recruit.kind").alias("recruit"), F.col("recruit.end").alias("recruit_end"), "age_min", "age_max", F.col("income.kind").alias("income"), F.col("income.max_ratio").alias("max_ratio"),
        F.array_join("region_codes", ",").alias("codes"), F.col("is_nationwide").alias("nationwide"), F.col("raw.orgName").alias("org"), "source_url",
    )


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name || ' 신청서 1부' WHEN 3 THEN '붙임 참고 등본 1부 ' || p_size END AS documents,
 CASE WHEN p_size % 3 = 0 THEN 'https://a.org/p?x=' || p_size WHEN p_size % 3 = 1 THEN 'https://b.org' END AS url, p_size % 2 = 0 AS mental FROM part""")
def cleaned_fields(spark: SparkSession, d: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    t = _case(key, _text(" ", F.col("p_name"), " 신청서 1부 "), F.lit("▶ 해당 없음"), F.lit("붙임 파일을 참고 바랍니다"), _text("붙임 참고 등본 1부 ", size))
    urls = [F.when(size % 3 < 2, "https://b.org"), F.when(size % 3 == 0, _text("https://a.org/p?x=", size)), F.lit(" ")]
    title = F.when(size % 2 == 0, "청년 심리 상담").otherwise(F.lit("청년 상담"))
    return table(spark, d, "part").select(key.alias("id"), parse.clean_documents(t).alias("documents"), parse.source_url(*urls).alias("url"), parse.is_mental_health(title, F.lit("건강")).alias("mental"))


# ---- results ----------------------------------------------------------------------------------------

SQL_DOCUMENTS = [x[1] for x in DOCUMENTS]


@query(f"""WITH t AS (SELECT p_partkey AS id, {SQL_DOCUMENTS}[p_partkey % 10 + 1] || ', ' || {SQL_DOCUMENTS}[p_size % 10 + 1] || ' 각 1부' AS text FROM part)
SELECT id, UNNEST(list_filter({SQL_DOCUMENTS}, lambda n: contains(text, n))) AS name FROM t""")
def document_matches(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, SQL_DOCUMENTS))
    of = lambda c: F.get(names, (F.col(c) % 10).cast("int"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), _text(of("p_partkey"), ", ", of("p_size"), " 각 1부").alias("documents_text"))
    return results.matched_documents(rows).select("id", F.explode("documents.name").alias("name"))


@query(f"""WITH t AS (SELECT *, CASE WHEN c_custkey % 3 > 0 THEN {SQL_CODES}[c_nationkey % 17 + 1] END AS code, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 60 END AS age, {SQL_PLACES}[c_nationkey % 17 + 1] AS place FROM customer)
SELECT c_custkey AS id, CASE WHEN code IS NULL THEN '혼자 하기 버거우면 청년센터가 같이 해줘요' ELSE '혼자 하기 버거우면 ' || place || ' 청년센터가 같이 해줘요' END AS center,
 CASE WHEN code IS NULL THEN '지역' ELSE place END || ' · ' || coalesce(age || '세', '나이 입력') AS summary, concat_ws(' · ', CASE WHEN code IS NOT NULL THEN place END, age || '세') AS badge,
 CASE c_custkey % 3 WHEN 0 THEN '온통청년' WHEN 1 THEN '청년몽땅' ELSE '' END AS origin, CASE c_custkey % 3 WHEN 0 THEN '확인 필요' WHEN 1 THEN '무료' ELSE '1,500원' END AS fee,
 CASE WHEN c_custkey % 3 > 0 THEN '약 ' || c_custkey % 3 || '분' END AS minutes, CASE WHEN c_custkey % 2 = 0 THEN '10.0.0.' || c_nationkey ELSE 'unknown' END AS client,
 CASE WHEN c_acctbal > 0 AND c_acctbal < 150 THEN floor(c_acctbal)::INT END AS stored_age FROM t""")
def display_values(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    code = F.when(key % 3 > 0, F.get(F.array(*map(F.lit, SQL_CODES)), (F.col("c_nationkey") % 17).cast("int")))
    age = F.when(key % 4 > 0, key % 60)
    fee = _case(key, _none("int"), F.lit(0), F.lit(1500))
    forwarded = F.when(key % 2 == 0, _text(" 10.0.0.", F.col("c_nationkey"), " , 10.1.1.1"))
    return table(spark, d, "customer").select(
        key.alias("id"), results.center_message(code).alias("center"), results.profile_summary(code, age).alias("summary"), results.match_badge(code, age).alias("badge"),
        results.origin_label(_case(key, F.lit("ontong"), F.lit("seoul-youth"), F.lit("x"))).alias("origin"), results.fee_text(fee).alias("fee"), results.minutes_text(F.when(key % 3 > 0, key % 3)).alias("minutes"),
        results.client_key(forwarded, _none()).alias("client"), results.stored_profile(F.col("c_acctbal"), code)["age"].alias("stored_age"),
    )


@query("""SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '나이 조건' WHEN 2 THEN '나이 조건,소득 조건' ELSE '나이 조건,소득 조건' END AS labels, CASE WHEN p_size % 4 = 1 THEN 'almost' ELSE 'review' END AS status,
 CASE p_partkey % 3 WHEN 0 THEN 'work' WHEN 1 THEN 'housing' ELSE 'other' END AS tag, CASE p_partkey % 3 WHEN 0 THEN '일자리, 복지' WHEN 1 THEN '주거' ELSE '기타' END AS category,
 CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 < 3 THEN p_name ELSE p_brand END AS benefit FROM part""")
def card_values(spark: SparkSession, d: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    codes = F.slice(F.array(*map(F.lit, ("AGE_UNKNOWN", "INCOME_UNKNOWN", "INCOME_PROFILE_MISSING"))), F.lit(1), (size % 4).cast("int"))
    labels, category = results.review_labels(codes), _case(key, F.lit("일자리,복지, 일자리"), F.lit(" 주거 ,주거"), F.lit("기타"))
    told, summary = F.when(size % 5 > 2, F.lit(" ")).otherwise(F.when(size % 5 > 0, F.col("p_name"))), F.when(size % 5 > 2, F.col("p_brand"))
    return table(spark, d, "part").select(key.alias("id"), F.array_join(labels, ",").alias("labels"), results.status_label(F.lit("review"), labels).alias("status"), results.category_tag(category).alias("tag"), results.display_category(category).alias("category"), results.benefit(told, summary).alias("benefit"))


@query("""SELECT p_partkey AS id, '나이 ' || p_size || '~' || (p_size + 20) || '세 — 내 나이 ' || (p_size + 3) || '세 충족|' || CASE WHEN p_partkey % 2 = 0 THEN '소득 제한 없음' ELSE '소득 조건 — 원문에서 확인' END || '|전국 대상 — 지역 충족' AS lines FROM part""")
def checklist_lines(spark: SparkSession, d: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size").cast("double")
    axes = {"age": _none(), "income": F.when(key % 2 == 1, "INCOME_UNKNOWN"), "region": _none(), "recruit": _none()}
    lines = results.checklist(eligibility.axis_results(axes), size, size + 20, F.lit(True), F.array(F.lit("11")), size + 3)
    return table(spark, d, "part").select(key.alias("id"), F.array_join(F.transform(lines, lambda x: x["text"]), "|").alias("lines"))


@query("""WITH s AS (SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS title, o_orderdate AS saved_at FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey <> 9),
a AS (SELECT * FROM s UNION ALL SELECT '7', 'new', TIMESTAMP '2030-01-01') SELECT id, title FROM a ORDER BY saved_at DESC, id LIMIT 100""")
def saved_list(spark: SparkSession, d: str) -> DataFrame:
    """Two toggles: one takes a saved item out, one puts an item first; a hundred stay."""
    saved = table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(_text(" ", F.col("o_orderkey")).alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").cast("timestamp").alias("saved_at"))
    item = lambda i: spark.createDataFrame([(i, "new", datetime(2030, 1, 1))], saved.schema)
    return results.toggled(results.toggled(saved, item("9")), item("7")).select("id", "title")


# ---- stored rows and the index ----------------------------------------------------------------------


@query("""SELECT vec_id AS id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 6) AS square, len(embedding)::INT AS size, 1.0::DOUBLE AS unit FROM embeddings""")
def stored_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as literals and read back."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), files.vector_literal(F.col("embedding").cast("array<double>")).alias("literal"))
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    own = rows.select("id", files.parse_vector(F.col("literal")).alias("v"))
    return own.select("id", rounded(square(F.col("v")), 6).alias("square"), F.size("v").alias("size"), rounded(square(text.l2_normalized(F.col("v"))), 6).alias("unit"))


@query("""SELECT p_partkey AS id, p_brand AS title, NULLIF(p_name, '') AS summary, CASE WHEN p_size % 2 = 0 THEN 'ontong' ELSE p_type END AS source, p_size % 3 = 0 AS nationwide FROM part""")
def stored_rows(spark: SparkSession, d: str) -> DataFrame:
    """Records under their stored names and back, with the defaults of reading."""
    size = F.col("p_size")
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("title"), F.col("p_name").alias("summary"), F.when(size % 2 == 1, F.col("p_type")).otherwise("").alias("source"),
        F.when(size % 3 == 0, True).alias("is_nationwide"), F.lit("").alias("region_text"), _none("array<string>").alias("region_codes"),
    )
    back = files.from_stored(files.to_stored(rows.withColumnsRenamed({"region_text": "regionText", "region_codes": "regionCodes", "is_nationwide": "isNationwide"})))
    return back.filter(F.col("regionText").isNull() & (F.size("regionCodes") == 0)).select("id", "title", "summary", "source", F.col("isNationwide").alias("nationwide"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ' || p_type ELSE p_brand || ' ' || p_type END AS text, e.vec_id IS NOT NULL AS embedded FROM part LEFT JOIN embeddings e ON e.vec_id = p_partkey
WHERE p_partkey % 5 = 0 OR p_size % 2 = 0 OR p_size % 3 = 0""")
def index_build(spark: SparkSession, d: str) -> DataFrame:
    """The search index of parts, less what is closed to the region 11; parts without a record stay in."""
    size, key = F.col("p_size"), F.col("p_partkey")
    parts = table(spark, d, "part")
    parsed = F.when(key % 3 == 0, _text('{"chunks": {"purpose": " ', F.col("p_name"), '", "eligibility": "', F.col("p_type"), '", "application": "x"}}'))
    rows = parts.select(key.cast("string").alias("id"), F.col("p_brand").alias("title"), F.col("p_type").alias("summary"), F.col("p_type").alias("category"), parsed.alias("parsed"))
    records = parts.filter("p_partkey % 5 > 0").select(key.cast("string").alias("id"), (size % 2 == 0).alias("is_nationwide"), F.array(F.when(size % 3 == 0, "11").otherwise("26")).alias("region_codes"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    index = retrieval.open_to(retrieval.index_of(rows, vectors), records, "11")
    return index.select(F.col("id").cast("long").alias("id"), "text", F.col("vector").isNotNull().alias("embedded"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN p_partkey::VARCHAR ELSE p_name END AS title, CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE p_type END AS category, CASE WHEN p_partkey % 4 = 0 THEN 'unknown' ELSE 'none' END AS income FROM part""")
def resolved_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits with their records, or with unknown ones where there is none."""
    parts, key = table(spark, d, "part"), F.col("p_partkey").cast("string").alias("id")
    nothing = F.struct(F.lit("none").alias("kind"), _none("double").alias("max_ratio"), _none("double").alias("max_amount"), _none().alias("raw"))
    rows = parts.filter("p_partkey % 4 > 0").select(key, F.col("p_name").alias("title"), F.col("p_type").alias("category"), nothing.alias("income"))
    found = retrieval.resolved(parts.select(key), rows, parts.select(key, F.col("p_brand").alias("category")))
    return found.select(F.col("id").cast("long").alias("id"), "title", "category", F.col("income.kind").alias("income"))


