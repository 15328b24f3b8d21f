from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from grantlake.operators import eligibility, ingest, results, retrieval, safety
from grantlake.plans.search import Node, search
from grantlake.sources import files
from grantlake.streaming.limiter import limited, limited_stream

TODAY = date(2026, 6, 24)
RECORD = (
    "id string, title string, age_min double, age_max double, income struct<kind: string, max_ratio: double, max_amount: double, raw: string>, region_codes array<string>, "
    "is_nationwide boolean, recruit struct<kind: string, start: date, end: date>, program_key string, "
    "profile struct<age: double, region_code: string, median_ratio: double, amount: double, active_programs: array<string>, completed_programs: array<string>>"
)
NONE = ("none", None, None, None)
ALWAYS = ("always", None, None)
WHO = (30.0, "11", 100.0, None, [], [])


def outcome(spark, record=(), who=WHO):
    base = dict(zip(("id", "title", "age_min", "age_max", "income", "region_codes", "is_nationwide", "recruit", "program_key"), ("a", "t", 19.0, 34.0, NONE, ["11"], False, ALWAYS, None)))
    base.update(record)
    r = eligibility.evaluate(spark.createDataFrame([(*base.values(), who)], RECORD), TODAY).first()
    return r.bucket, r.reasons


@pytest.mark.parametrize(("record", "who", "want"), [
    ({}, WHO, ("now", [])),
    ({"age_min": 31.0}, WHO, ("blocked", ["AGE_BELOW_MIN"])), ({"age_max": 29.0}, WHO, ("blocked", ["AGE_ABOVE_MAX"])),
    ({"age_min": 30.0, "age_max": 30.0}, WHO, ("now", [])),
    ({"age_min": None, "age_max": None}, WHO, ("review", ["AGE_UNKNOWN"])),
    ({"age_min": None, "age_max": None, "is_nationwide": True}, (None, None, None, None, [], []), ("now", [])),
    ({}, (float("nan"), "11", 1.0, None, [], []), ("review", ["AGE_UNKNOWN"])), ({}, (-1.0, "11", 1.0, None, [], []), ("review", ["AGE_UNKNOWN"])),
    ({"income": ("medianRatio", 99.0, None, None)}, WHO, ("blocked", ["INCOME_OVER_LIMIT"])),
    ({"income": ("medianRatio", float("nan"), None, None)}, WHO, ("review", ["INCOME_UNKNOWN"])),
    ({"income": ("amountMax", None, 5.0, None)}, WHO, ("review", ["INCOME_PROFILE_MISSING"])),
    ({"income": ("unknown", None, None, None)}, WHO, ("review", ["INCOME_UNKNOWN"])),
    ({"region_codes": []}, WHO, ("review", ["REGION_UNKNOWN"])), ({"region_codes": ["26"]}, WHO, ("blocked", ["REGION_MISMATCH"])),
    ({}, (30.0, "", 1.0, None, [], []), ("review", ["REGION_PROFILE_MISSING"])),
    ({"region_codes": ["26"], "income": ("unknown", None, None, None)}, WHO, ("blocked", ["REGION_MISMATCH", "INCOME_UNKNOWN"])),
    ({"recruit": ("dated", None, TODAY - timedelta(1))}, WHO, ("blocked", ["RECRUIT_CLOSED"])),
    ({"recruit": ("dated", None, TODAY + timedelta(7))}, WHO, ("soon", [])), ({"recruit": ("dated", None, TODAY + timedelta(8))}, WHO, ("now", [])),
    ({"recruit": ("dated", TODAY + timedelta(300), None)}, WHO, ("soon", [])), ({"recruit": ("unknown", None, None)}, WHO, ("review", ["RECRUIT_UNKNOWN"])),
    ({"recruit": None}, WHO, ("review", ["RECRUIT_UNKNOWN"])),
    ({"program_key": "kuk_chwi"}, WHO, ("blocked", ["PREREQ_NOT_MET"])),
    ({"program_key": "kuk_chwi"}, (30.0, "11", 1.0, None, ["monthly_rent"], ["youth_challenge"]), ("blocked", ["DUPLICATE_EXCLUSIVE"])),
    ({"program_key": "kuk_chwi"}, (30.0, "11", 1.0, None, None, None), ("review", ["PREREQ_UNKNOWN", "PREREQ_UNKNOWN"])),
    ({"program_key": "monthly_rent"}, (30.0, "11", 1.0, None, ["monthly_rent"], []), ("review", ["PREREQ_UNKNOWN"])),
])
def test_eligibility(spark, record, who, want):
    assert outcome(spark, record, who) == want


def test_newest_row_per_key(spark):
    rows = [("a", 0, None, "x"), ("a", 1, "2026-01-01", "y"), ("a", 2, "2026-01-01", "z"), ("a", 3, " ", "w"), ("b", 4, None, "p"), ("b", 5, None, "q")]
    got = ingest.newest(spark.createDataFrame(rows, "id string, ordinal int, last_modified string, v string"), ["id"]).collect()
    assert {(r.id, r.v, r.first_ordinal, r.copies) for r in got} == {("a", "z", 0, 4), ("b", "q", 4, 2)}


def test_region_verdict(spark):
    rows = [(0, ["11"], False, "x"), (1, [], True, None), (2, [], False, "강남구"), (3, [], False, "경기도 광주 중구"), (4, [], False, " "), (5, ["26"], False, "부산")]
    frame = spark.createDataFrame(rows, "id int, c array<string>, n boolean, t string")
    got = {r.id: r.v for r in frame.select("id", ingest.region_verdict(F.col("c"), F.col("n"), F.col("t")).alias("v")).collect()}
    assert got == {0: "pass", 1: "pass", 2: "pass", 3: "non-seoul", 4: "unknown-region", 5: "non-seoul"}


def test_pipeline_from_raw_to_changes(spark):
    raw = spark.createDataFrame(
        [("1", "청년 월세", "19~34", "중위소득 150% 이하", "서울특별시", "2026-06-01", None, "2026-01-01", "ontong", 0), (None, None, None, None, None, None, None, None, None, 1)],
        "id string, title string, ageText string, incomeText string, regionText string, recruitStartText string, recruitEndText string, lastModified string, source string, ordinal int",
    )
    rows = ingest.with_hash(ingest.normalized(raw)).cache()
    first = rows.filter("id = '1'").first()
    assert (first.age_min, first.age_max, first.income.kind, first.region_codes) == (19, 34, "medianRatio", ["11"])
    assert rows.filter("id = 'unknown'").first().title == "제목 없음"
    touched = ingest.with_hash(ingest.normalized(raw.withColumn("ageText", F.lit("만 19세~만 34세"))))
    assert {r.id: r.reparse for r in ingest.changed(touched, rows).collect()}["1"] is True
    assert not any(r.reparse for r in ingest.changed(rows, rows).collect())
    kept = ingest.enrich_changed(ingest.changed(rows, rows.withColumn("note", F.lit("old"))), rows.withColumn("note", F.lit("old")), lambda x: x.withColumn("note", F.lit("new")), ["note"])
    assert {r.note for r in kept.collect()} == {"old"}


def test_suppression_spares_blank_titles(spark):
    rows = spark.createDataFrame([(1, "a b", "seoul-youth", True), (2, "ab", "ontong", True), (3, "!", "seoul-youth", True), (4, "c", None, True)], "id int, title string, source string, canon boolean")
    got = ingest.suppressed(rows, F.col("title"), F.col("source"), "seoul-youth", F.col("canon"))
    assert {r.id for r in got.collect()} == {2, 3, 4} and got.columns == rows.columns


def test_near_duplicates_equal_all_pairs(spark):
    import random

    rng = random.Random(4)
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    names += [n[:-1] + "z" for n in names if n]
    rows = spark.createDataFrame([(k, n, rng.choice(["org", "orgs", "", "x"])) for k, n in enumerate(names)], "id int, name string, org string")
    classes = ingest.name_classes(rows, "id", F.col("name"), F.col("org")).cache()
    got = {(r.a, r.b): round(r.score, 9) for r in ingest.near_duplicates(classes).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i, *row[1:]] if False else _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    like = lambda a, b: 1.0 if not a and not b else 1 - distance(a, b) / max(len(a), len(b))
    every, want = classes.collect(), {}
    for p in every:
        for q in every:
            if p.rep < q.rep and (s := (like(p.name, q.name) + like(p.org, q.org)) / 2) >= 0.85:
                want[p.rep, q.rep] = round(s, 9)
    assert got == want


def test_fusion_boost_and_empty_arms(spark):
    arm = lambda rows: spark.createDataFrame(rows, "id long, score double")
    got = retrieval.fused([arm([(1, 0.9), (1, 0.8), (2, 0.5)]), arm([(2, 1.0)])], 10).orderBy("id").collect()
    assert [(r.id, r.rank_0, r.rank_1, round(r.score, 9)) for r in got] == [(1, 0, None, round(1 / 60, 9)), (2, 1, 0, round(1 / 61 + 1 / 60, 9))]
    assert retrieval.top_k(arm([(1, 1.0)]), 0).count() == 0
    assert retrieval.clamp_request("  x ", "99", [], " ") == {"query": "x", "top_k": 30, "categories": None, "region": None}


def test_year_variants(spark):
    t = datetime(2026, 1, 1)
    rows = [("a", "2025년 청년 월세", "now", t), ("b", "2026 청년월세", "review", t), ("c", "2026년 청년 월세", "now", None), ("d", "2025", "now", t), ("e", "2026", "soon", t)]
    frame = spark.createDataFrame(rows, "id string, title string, bucket string, updated_at timestamp")
    assert {r.id for r in results.latest_variants(frame).collect()} == {"c", "d", "e"}


def test_labels_checklist_and_saved(spark):
    r = spark.range(1).select(
        results.review_labels(F.array(*map(F.lit, ["INCOME_UNKNOWN", "INCOME_PROFILE_MISSING", "AGE_UNKNOWN"]))).alias("labels"),
        results.display_category(F.lit("일자리, 일자리,주거")).alias("category"), results.category_tag(F.lit("주거")).alias("tag"),
        results.age_input(F.lit(" 30 ")).alias("age"), results.age_input(F.lit("-1")).alias("bad"),
    ).first()
    assert (r.labels, r.category, r.tag, r.age, r.bad) == (["소득 조건", "나이 조건"], "일자리, 주거", "housing", 30, None)
    t = datetime(2026, 1, 1)
    saved = spark.createDataFrame([("a", "A", t), (" ", "B", t), ("a", "A2", t - timedelta(1))], "id string, title string, saved_at timestamp")
    item = spark.createDataFrame([("a", "A", t)], saved.schema)
    assert results.toggled(saved, item).count() == 0 and results.toggled(saved.filter("id <> 'a'"), item).count() == 1


@pytest.mark.parametrize(("words", "hit"), [("요즘 죽고싶어요", True), ("배고파 죽겠다", False), ("더는 못 버티겠어", True), ("여행을 떠나고 싶다", False), (None, False), ("", False)])
def test_crisis(spark, words, hit):
    assert spark.range(1).select(safety.crisis(F.lit(words).cast("string"))["crisis"].alias("c")).first().c is hit


def plain_windows(rows, seconds):
    """(start, n) of each request by a fold over all of a client's requests."""
    out, open_ = {}, {}
    for client, event, ts in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1])):
        start, n = open_.get(client, (None, 0))
        if start is None or ts > start + timedelta(seconds=seconds):
            start, n = ts, 0
        open_[client] = out[event] = (start, n + 1)
    return out


def test_limiter_equals_a_plain_fold(spark):
    import random

    rng, base = random.Random(2), datetime(2026, 1, 1)
    rows = [(rng.choice([1, 1, 1, 2, None, (1 << 60) + 1]), k, base + timedelta(seconds=rng.choice([rng.randint(0, 900), 60 * rng.randint(0, 90)]))) for k in range(400)]
    rows += [(1, 900, None), (7, 901, None)]
    got = {r.event_id: r for r in limited(spark.createDataFrame(rows, "client long, event_id long, ts timestamp"), 60, 2).collect()}
    want = plain_windows(rows, 60)
    assert len(got) == len(rows)
    assert {k: (got[k].window_start, got[k].n) for k in want} == want
    assert all(got[e].client == c and got[e].allowed == (e in want and want[e][1] <= 2) for c, e, _ in rows)
    assert got[900].n is None and got[900].window_start is None


def test_limiter_batch_and_stream(spark, tmp_path):
    base = datetime(2026, 1, 1)
    rows = [(1, k, base + timedelta(seconds=s)) for k, s in enumerate((0, 30, 60, 61, 62, 500))] + [(2, 9, base), (2, 10, None)]
    frame = spark.createDataFrame(rows, "client long, event_id long, ts timestamp")
    got = {r.event_id: (r.n, r.allowed) for r in limited(frame, 60, 2).collect()}
    assert got == {0: (1, True), 1: (2, True), 2: (3, False), 3: (1, True), 4: (2, True), 5: (1, True), 9: (1, True), 10: (None, False)}
    assert all(r.allowed for r in limited(frame, 60, 0).collect())
    # Two files, so that the window of the first micro-batch is the state of the second.
    frame.filter("event_id < 2 OR event_id = 9").coalesce(1).write.parquet(str(tmp_path / "in"))
    frame.filter("event_id >= 2 AND event_id <> 9").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = limited_stream(source, 60, 2).writeStream.format("memory").queryName("limits").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert q.awaitTermination(60)
    assert {r.event_id: (r.n, r.allowed) for r in spark.table("limits").collect()} == got


def test_sources(spark, tmp_path):
    page = tmp_path / "p.json"
    page.write_text('[{"id": "1", "title": "t", "ageMin": 19}, {"id": null}]', encoding="utf-8")
    assert [r.id for r in files.raw_pages(spark, [str(page)]).orderBy("ordinal").collect()] == ["1", None]
    bodies = spark.createDataFrame([(1, '{"result": {"youthPolicyList": [{"plcyNo": "A"}], "pagging": {"totCount": 7}}}'), (2, "broken"), (3, '[{"plcyNo": "B"}]')], "page int, body string")
    items = files.service_pages(bodies, "struct<plcyNo: string>")
    assert [r.plcyNo for r in items.orderBy("ordinal").collect()] == ["A", "B"]
    assert bodies.select(files.total_count(F.col("body")).alias("n")).first().n == 7
    assert files.snapshot(spark, str(tmp_path / "none"), bodies.schema).count() == 0
    v = spark.range(1).select(files.vector_literal(F.array(F.lit(1.5), F.lit(float("nan")))).alias("v")).first().v
    assert v == "[1.5,0.0]"
    from grantlake.sources.paged import page_count

    assert [page_count(n) for n in (0, 1, 100, 101, 10**6)] == [0, 1, 1, 2, 60]


def test_search_end_to_end(spark):
    schema = "id string, title string, text string, keywords array<string>, category string, age_min double, age_max double, income struct<kind: string, max_ratio: double, max_amount: double, raw: string>, region_codes array<string>, is_nationwide boolean, recruit struct<kind: string, start: date, end: date>, program_key string, vector array<double>, updated_at timestamp"
    rows = [(i, f"월세 지원 {i}", "청년 월세 지원", ["월세"], c, 19.0, a, NONE, r, False, ALWAYS, None, None, datetime(2026, 1, 1)) for i, c, a, r in (("x", "주거", 34.0, ["11"]), ("y", "일자리", 34.0, ["11"]), ("z", "주거", 34.0, ["26"]), ("w", "주거", 20.0, ["11"]))]
    root = Node("root", kind="entry", children=[Node("rent", "월세", allowed=["주거"]), Node("safe", kind="safety")])
    catalogue = spark.createDataFrame(rows, schema)
    got = search(catalogue, root, "rent", {"age": 30.0, "region_code": "11"}, TODAY)
    assert [r.id for r in got.rows.collect()] == ["x"]
    assert search(catalogue, root, "rent", {}, TODAY, query="죽고 싶어").crisis
    assert [n.id for n in search(catalogue, root, "root", {}, TODAY).alternatives] == ["rent"]


@pytest.fixture
def served():
    """A local service: paged JSON with one broken page, and a crawled catalogue whose list has a gap."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    lists = {("a", 1): ["V1", "22"], ("a", 2): [], ("a", 3): ["V2", "V1"], ("b", 1): ["V3"]}

    class Handler(BaseHTTPRequestHandler):
        asked: list[str] = []

        def do_GET(self):
            self.asked.append(self.path)
            kind, *rest = self.path.strip("/").split("/")
            body, code = "", 200
            if kind == "page":
                body, code = f'{{"result": {{"youthPolicyList": [{{"plcyNo": "P{rest[0]}"}}], "pagging": {{"totCount": 250}}}}}}', 404 if rest[0] == "2" else 200
            elif kind == "list":
                body = "".join(f"<a href=\"#\" onclick=\"goView('{k}');\">title {k}</a>" for k in lists.get((rest[0], int(rest[1])), []))
            elif kind == "detail" and rest[0] != "V3":
                body = f"<dl><dt>정책유형</dt><dd>{rest[0]}</dd></dl>"
            self.send_response(code if kind != "detail" or rest[0] != "V3" else 500)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args): ...

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", Handler.asked
    server.shutdown()


def test_paged_source_skips_a_broken_page(spark, served):
    from grantlake.sources.paged import PagedSource

    spark.dataSource.register(PagedSource)
    bodies = spark.read.format("paged").option("url", f"{served[0]}/page/{{page}}").option("tries", "1").load()
    assert sorted(r.plcyNo for r in files.service_pages(bodies, "struct<plcyNo: string>").collect()) == ["P1", "P3"]


def test_crawl_stops_after_two_empty_pages(spark, served):
    from grantlake.sources.paged import CrawlSource

    spark.dataSource.register(CrawlSource)
    reader = spark.read.format("crawl").options(url=f"{served[0]}/list/{{tab}}/{{page}}", detail=f"{served[0]}/detail/{{key}}", tabs="a,b", delay="0", size="1")
    rows = {r.key: r for r in reader.load().collect()}
    assert set(rows) == {"V1", "V2", "V3"}
    assert rows["V2"].title == "title V2" and "정책유형" in rows["V1"].html and rows["V3"].html == ""
    asked = {p for p in served[1] if p.startswith("/list")}
    assert asked == {f"/list/a/{k}" for k in range(1, 6)} | {f"/list/b/{k}" for k in range(1, 4)}
    assert ingest.from_crawl(reader.load(), "http://x").count() == 3


def test_ingest_carries_forward_what_has_not_changed(spark):
    now, before = datetime(2026, 6, 24), datetime(2026, 1, 1)
    schema = "ordinal long, id string, title string, regionText string, incomeText string, source string"
    raw = spark.createDataFrame([
        (0, "a", "월세 지원", "서울", "소득 무관", "ontong"), (1, "b", "월세지원", "서울", None, "seoul-youth"), (2, "c", "취업", "서울", None, "seoul-youth"), (3, "d", "x", "부산", None, "ontong"),
        (4, None, "y", "서울", None, "ontong"), (5, "a", "월세 지원 2", "서울", "소득 무관", "ontong"), (6, "e", "z", None, None, "ontong"),
    ], schema)
    parsed = lambda rows: rows.withColumn("parsed", F.lit('{"chunks": {"purpose": "p"}}'))
    explained = lambda rows: rows.withColumn("explanation", F.concat(F.lit("about "), "title"))
    vectors = spark.createDataFrame([("a", [1.0]), ("c", [2.0])], "id string, vector array<double>")
    first, counts = ingest.ingest(raw, spark.createDataFrame([], "id string"), F.lit(before), "city", parse_=parsed, vectors=vectors)
    got = counts.first()
    assert (got.dropped_no_id, got.dropped_non_seoul, got.dropped_unknown_region, got.merged_duplicates, got.suppressed_cross_source, got.reparsed) == (1, 1, 1, 1, 0, 3)
    stored = {r.id: r for r in first.collect()}
    assert stored["a"].title == "월세 지원 2" and stored["a"].vector == [1.0] and stored["a"].explanation is None and stored["b"].vector is None
    kept = spark.createDataFrame(first.collect(), first.schema)
    same = raw.withColumn("title", F.when(F.col("id") == "c", "취업 지원").otherwise(F.col("title")))
    again = {r.id: r for r in ingest.ingest(same, kept, F.lit(now), "city", explain=explained, vectors=spark.createDataFrame([("b", [3.0])], vectors.schema))[0].collect()}
    assert (again["a"].reparse, again["a"].updated_at, again["a"].fetched_at, again["a"].parsed, again["a"].vector, again["a"].explanation) == (False, before, now, stored["a"].parsed, [1.0], "about 월세 지원 2")
    assert (again["c"].reparse, again["c"].updated_at, again["c"].parsed, again["c"].vector) == (True, now, None, None)
    assert again["b"].vector == [3.0] and again["b"].keywords == ["월세지원"]
    none = ingest.ingest(raw.limit(0), kept, F.lit(now))
    assert none[0].collect() == [] and none[1].first().merged_duplicates == 0


def test_isolated_source_fails_as_a_whole(spark):
    own = spark.range(3)
    late = lambda: spark.range(1000).select(F.when(F.col("id") < 999, F.col("id")).otherwise(F.raise_error(F.lit("down")).cast("long")).alias("id"))
    rows, warning = files.union_isolated(own, late)
    assert rows.count() == 3 and "down" in warning
    rows, warning = files.union_isolated(own, lambda: spark.range(2))
    assert rows.count() == 5 and warning is None


def test_month_thirteen_and_anchors(spark):
    from grantlake.functions import parse

    r = spark.range(1).select(parse.coarse_end(F.lit("2025.1 ~ 2026.13")).alias("a"), parse.coarse_end(F.lit("2026.02")).alias("b")).first()
    assert (r.a, r.b) == ("2026-13-31", "2026-02-28")
    rows = spark.createDataFrame([("x", [1.0, 0.0]), ("y", None)], "id string, vector array<double>")
    assert [r.hit for r in safety.near_anchors(rows, rows.filter("id = 'y'")).orderBy("id").collect()] == [False, False]
    assert [r.hit for r in safety.near_anchors(rows, rows).orderBy("id").collect()] == [True, False]
    with pytest.raises(ValueError, match="anchors"):
        safety.near_anchors(rows, spark.range(65).select(F.array(F.lit(1.0), F.lit(0.0)).alias("vector")))


def test_candidates_are_few_and_long_names_stay_linear(spark):
    import os

    if os.path.isdir("/root/testdata/sf0.1"):
        from grantlake.queries import _pages

        classes = ingest.name_classes(_pages(spark, "/root/testdata/sf0.1"), "id", F.col("name"), F.col("org"))
        n = classes.count()
        assert ingest.candidate_classes(classes, classes, ordered=True).count() < n * (n - 1) / 20
    long = "".join(chr(97 + k * k % 23) for k in range(5000))
    texts = spark.createDataFrame([(0, long), (1, long[:4000] + "x" * 900), (2, "가나다"), (3, "a"), (4, "")], "nid long, text string")
    places = ingest.gram_places(texts)
    assert places.count() == 4999 + 4899 + 2 + 1 + 1
    assert places.filter("nid = 0").agg(F.min("place"), F.max("pos")).first() == (1, 4998)
    got = {(r.a, r.b) for r in ingest.alike_texts(texts.select("text"), 0.7).filter("a < b").collect()}
    assert got == {(long, long[:4000] + "x" * 900)} or got == {(long[:4000] + "x" * 900, long)}


def test_positions_in_a_hot_list(spark):
    rows = [(k, "hot" if k % 3 else None if k % 2 else f"b{k % 7}", ["now", "soon", "review", "blocked"][k * 7 % 4], k * 31 % 500) for k in range(500)]
    frame = spark.createDataFrame(rows, "id long, brand string, bucket string, ordinal long").withColumn("reasons", F.array().cast("array<string>")).repartition(7)
    found = results.with_positions(results.in_display_order(frame), ["brand"]).collect()
    lists = {}
    for i, brand, bucket, ordinal in rows:
        if bucket != "blocked":
            lists.setdefault(brand, []).append((["now", "soon", "review"].index(bucket), ordinal, i))
    wanted = {(i, k + 1) for own in lists.values() for k, (_, _, i) in enumerate(sorted(own))}
    assert {(r.id, r.position) for r in found} == wanted


def test_free_input_and_model_fallback(spark):
    from grantlake.operators import safety

    known = {"d": ["a"], "e": ["b"]}
    rows = spark.createDataFrame([("xa", None), ("zz", '{"domain": "e"}'), ("zz", '{"domain": "f"}'), ("zz", "{"), (" ", '{"domain": "e"}'), (None, None), ("ba", '{"domain": "e"}')], "text string, answer string")
    got = [tuple(r.c) for r in rows.select(safety.classified(F.col("text"), F.col("answer"), known).alias("c")).collect()]
    none = (None, "none", None)
    assert got == [("d", "keyword", 1.0), ("e", "llm", 0.6), none, none, none, none, ("d", "keyword", 1.0)]
    told = rows.limit(1).select(safety.free_input(F.lit("죽고 싶어 우울"), F.lit('{"domain": "mentalHealth"}')).alias("f")).first().f
    assert (told.crisis, told.domain, told.source, told.confidence) == (True, None, "none", None)
    told = rows.limit(1).select(safety.free_input(F.lit("너무 우울해"), None).alias("f")).first().f
    assert (told.crisis, told.domain, told.source) == (False, "mentalHealth", "keyword")
    answers = spark.createDataFrame([(1, "[1.0, 2.0]"), (2, "[]"), (3, None), (4, '["NaN", 1.0]'), (5, "no")], "id long, answer string")
    assert [r.id for r in safety.anchor_rows(answers).collect()] == [1]


def test_requests_are_clamped_alike_as_rows(spark):
    from grantlake.operators import retrieval

    asked = [("  q ", "5", " 11 ", ["a"]), (None, "0", " ", []), ("x" * 600, "99", None, None), ("q", "-3", "11", ["a"]), ("q", "2.7", "11", None), ("q", "ten", "11", None), ("q", "NaN", "11", None), ("q", "Infinity", "", None), ("q", None, "", None)]
    rows = spark.createDataFrame(asked, "query string, k string, region string, categories array<string>")
    got = [tuple(r.c) for r in rows.select(retrieval.clamped(F.col("query"), F.col("k"), F.col("region"), F.col("categories")).alias("c")).collect()]
    wanted = [retrieval.clamp_request(q, k, c, r) for q, k, r, c in asked]
    assert got == [(w["query"], w["top_k"], w["region"], w["categories"]) for w in wanted]
