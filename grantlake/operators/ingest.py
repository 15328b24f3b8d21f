"""Batch ingest: normalize, dedupe, scope, suppress, report near-duplicates, recompute what changed, upsert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grantlake.functions import parse
from grantlake.functions.constants import DISTRICTS, DUPLICATE_STATES, FALLBACK_PLAIN, FALLBACK_TITLED, HOUSEHOLD_STATES, INCOME_KINDS, PROVINCES
from grantlake.functions.text import fnv1a, let, non_empty, normalize_name, one_blank
from grantlake.operators.edits import pairs_in_blocks
from grantlake.operators.retrieval import index_keywords, index_text
from grantlake.sources.shared import cut_lineage

RAW_FIELDS = (
    "id", "title", "summary", "ageText", "incomeText", "regionText", "recruitStartText", "recruitEndText", "recruitText",
    "category", "sourceUrl", "orgName", "lastModified", "source", "documentsText",
)
HASHED_TEXTS = ("ageText", "incomeText", "regionText", "recruitText", "recruitStartText", "recruitEndText")
CITY = "11"
THRESHOLD = 0.85


def normalized(raw: DataFrame) -> DataFrame:
    """Raw records of any source to typed columns, with the raw fields kept in ``raw``. One select."""
    c = {f: F.col(f) if f in raw.columns else F.lit(None).cast("string") for f in (*RAW_FIELDS, "programKey")}
    number = lambda f: F.col(f).cast("double") if f in raw.columns else F.lit(None).cast("double")
    age = parse.parse_age(number("ageMin"), number("ageMax"), c["ageText"])
    region = parse.parse_region(c["regionText"])
    return raw.select(
        *[F.col(k) for k in ("ordinal",) if k in raw.columns],
        F.coalesce(non_empty(c["id"]), F.lit("unknown")).alias("id"),
        F.coalesce(non_empty(c["title"]), F.lit("제목 없음")).alias("title"),
        non_empty(c["summary"]).alias("summary"),
        F.coalesce(non_empty(c["source"]), F.lit("unknown")).alias("source"),
        age["age_min"].alias("age_min"), age["age_max"].alias("age_max"),
        parse.parse_income(c["incomeText"]).alias("income"),
        region["codes"].alias("region_codes"), region["text"].alias("region_text"), region["nationwide"].alias("is_nationwide"),
        parse.parse_recruit(c["recruitStartText"], c["recruitEndText"], c["recruitText"]).alias("recruit"),
        non_empty(c["category"]).alias("category"),
        non_empty(c["documentsText"]).alias("documents_text"),
        non_empty(c["sourceUrl"]).alias("source_url"),
        c["programKey"].alias("program_key"),
        F.struct(*[c[f].alias(f) for f in RAW_FIELDS]).alias("raw"),
    )


def from_api(items: DataFrame) -> DataFrame:
    """Items of the primary service to raw records."""
    s = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("")) if f in items.columns else F.lit("")
    dates = F.regexp_extract_all(s("aplyYmd"), F.lit("(\\d{8})"), 1)
    begin, end = (parse.eight_digits(F.get(F.regexp_extract_all(s(f), F.lit("(\\d{8})"), 1), F.lit(0))) for f in ("bizPrdBgngYmd", "bizPrdEndYmd"))
    given = F.size(dates) > 0
    always = (s("aplyPrdSeCd") == "0057002") | s("aplyYmd").rlike("상시|연중|수시")
    institution = F.coalesce(non_empty(s("rgtrInstCdNm")), non_empty(s("sprvsnInstCdNm")))
    region = parse.region_text(s("zipCd"), institution)
    number = non_empty(s("plcyNo"))
    detail = F.concat(F.lit("https://www.youthcenter.go.kr/youthPolicy/ythPlcyTotalSearch/ythPlcyDetail/"), F.replace(F.url_encode(number), F.lit("+"), F.lit("%20")))
    mental = parse.is_mental_health(s("plcyNm"), s("mclsfNm"))
    return items.select(
        *[F.col(k) for k in ("ordinal",) if k in items.columns],
        number.alias("id"), non_empty(s("plcyNm")).alias("title"), non_empty(s("plcyExplnCn")).alias("summary"),
        parse.age_number(s("sprtTrgtMinAge")).alias("ageMin"), parse.age_number(s("sprtTrgtMaxAge")).alias("ageMax"),
        F.when(s("earnCndSeCd") == "0043001", "소득 무관").otherwise(non_empty(s("earnEtcCn"))).alias("incomeText"),
        region.alias("regionText"),
        F.when(given, parse.eight_digits(F.get(dates, F.lit(0)))).when(end.isNotNull(), begin).alias("recruitStartText"),
        F.when(given, parse.eight_digits(F.get(dates, F.lit(1)))).otherwise(end).alias("recruitEndText"),
        F.when(~given & end.isNull() & always, "상시").alias("recruitText"),
        F.when(mental, "마음건강").otherwise(non_empty(s("lclsfNm"))).alias("category"),
        parse.clean_documents(s("sbmsnDcmntCn")).alias("documentsText"),
        F.coalesce(detail, parse.source_url(s("aplyUrlAddr"), s("refUrlAddr1"), s("refUrlAddr2"))).alias("sourceUrl"),
        F.coalesce(institution, region).alias("orgName"),
        F.nullif(F.substring(s("lastMdfcnDt"), 1, 10), F.lit("")).alias("lastModified"), F.lit("ontong").alias("source"),
    )


def from_crawl(pages: DataFrame, base_url: str) -> DataFrame:
    """Crawled rows (key, title, detail page html) to raw records."""
    f = parse.label_values(F.col("html"))
    get = lambda *labels: parse.field(F.col("_f"), *labels)
    # Columns of their own, so that a page is read once and not again for each field that names them.
    found = pages.withColumn("_f", f).withColumns({"_r": parse.crawled_recruit(get("사업신청기간", "신청기간"), get("사업운영기간")), "_kind": get("정책유형")})
    recruit, kind = F.col("_r"), F.col("_kind")
    return found.select(
        non_empty(F.col("key")).alias("id"), non_empty(F.col("title")).alias("title"),
        get("정책소개", "지원내용", "지원규모").alias("summary"),
        non_empty(F.substring_index(get("연령"), "(", 1)).alias("ageText"), get("소득", "소득요건").alias("incomeText"),
        F.lit("서울특별시").alias("regionText"),
        recruit["start_text"].alias("recruitStartText"), recruit["end_text"].alias("recruitEndText"), recruit["text"].alias("recruitText"),
        F.when(parse.is_mental_health(F.col("title"), kind), "마음건강").otherwise(kind).alias("category"),
        parse.clean_documents(get("제출서류", "구비서류", "신청서류")).alias("documentsText"),
        F.concat(F.lit(base_url.rstrip("/") + "/infoData/plcyInfo/view.do?plcyBizId="), F.replace(F.url_encode("key"), F.lit("+"), F.lit("%20"))).alias("sourceUrl"),
        F.coalesce(get("주관기관", "운영기관"), F.lit("서울특별시")).alias("orgName"), F.lit("seoul-youth").alias("source"),
    )


def newest(rows: DataFrame, keys: list[str], modified: str = "last_modified", ordinal: str = "ordinal") -> DataFrame:
    """One row per key: a dated row beats an undated one, the later date wins, then the later arrival.

    ``first_ordinal`` keeps the place of the key's first row, ``copies`` their number. Rows are merged
    within tasks before the shuffle.
    """
    stamp = non_empty(F.col(modified))
    order = F.struct(stamp.isNotNull(), F.coalesce(stamp, F.lit("")), F.col(ordinal))
    best = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("_r"),
        F.min(ordinal).alias("first_ordinal"), F.count("*").alias("copies"),
    )
    return best.select(*keys, "_r.*", "first_ordinal", "copies")


def region_verdict(codes: Column, nationwide: Column, text: Column, city: str = CITY) -> Column:
    """pass, non-seoul or unknown-region. A district's name counts unless another province is named."""
    others = [name for code, _, names in PROVINCES if code != city for name in names.split("|")]
    inside = F.coalesce(text.rlike("|".join(DISTRICTS)) & ~text.rlike("|".join(others)), F.lit(False))
    passes = F.coalesce(F.array_contains(codes, city), F.lit(False)) | F.coalesce(nationwide, F.lit(False)) | inside
    return F.when(passes, "pass").when(non_empty(text).isNotNull(), "non-seoul").otherwise("unknown-region")


def suppression(rows: DataFrame, title: Column, source: Column, secondary: str, canonical: Column) -> DataFrame:
    """Adds ``suppressed``: true for rows of the secondary source whose normalized title another source's canonical row has.

    Titles meet by two 64-bit hashes (together 128 bits, taken as equality), since a title may be a long text.
    """
    name = normalize_name(title)
    named = rows.withColumns({
        "_second": F.coalesce(source == secondary, F.lit(False)), "_canon": F.coalesce(canonical, F.lit(False)) & (name != ""),
        "_h1": F.xxhash64(name), "_h2": F.xxhash64(F.lit("b"), name),
    })
    titles = named.filter("_canon AND NOT _second").select("_h1", "_h2").distinct().withColumn("_found", F.lit(True))
    found = named.filter("_second").join(titles, ["_h1", "_h2"], "left").withColumn("suppressed", F.coalesce("_found", F.lit(False)))
    kept = [*rows.columns, "suppressed"]
    return named.filter("NOT _second").withColumn("suppressed", F.lit(False)).select(*kept).unionByName(found.select(*kept))


def suppressed(rows: DataFrame, title: Column, source: Column, secondary: str, canonical: Column) -> DataFrame:
    """Without the rows that ``suppression`` marks."""
    return suppression(rows, title, source, secondary, canonical).filter("NOT suppressed").drop("suppressed")


def name_classes(rows: DataFrame, row_id: str, name: Column, org: Column) -> DataFrame:
    """Rows of one normalized name and organization as one class: (rep, name, org, copies). Pairs inside have likeness 1."""
    keyed = rows.select(F.col(row_id).alias("rep"), normalize_name(name).alias("name"), normalize_name(org).alias("org"))
    return keyed.filter("name <> '' OR org <> ''").groupBy("name", "org").agg(F.min("rep").alias("rep"), F.count("*").alias("copies"))


def name_members(rows: DataFrame, row_id: str, name: Column, org: Column) -> DataFrame:
    """(id, rep) of every row: the class of ``name_classes`` it belongs to. A row with neither a name nor an organization is its own class."""
    keyed = rows.select(F.col(row_id).alias("id"), normalize_name(name).alias("name"), normalize_name(org).alias("org"))
    classes = name_classes(rows, row_id, name, org).select(F.col("name").alias("_name"), F.col("org").alias("_org"), "rep")
    on = F.col("name").eqNullSafe(F.col("_name")) & F.col("org").eqNullSafe(F.col("_org"))
    return keyed.join(classes, on, "left").select("id", F.coalesce("rep", "id").alias("rep"))


def gram_places(texts: DataFrame) -> DataFrame:
    """(nid, size, gram, pos, place) of the bigrams of texts (nid, text): where a bigram stands, and how many rarer ones the text has, plus one.

    A text of one character or none is a gram itself. The rows of a text are as many as its characters.
    """
    letters = F.filter(F.split("text", ""), lambda c: c != "")
    pairs = let(letters, lambda c: F.when(F.size(c) > 1, F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda k: F.hash(F.element_at(c, k), F.element_at(c, k + 1)))))
    grams = texts.select("nid", F.length("text").alias("size"), F.posexplode(F.coalesce(pairs, F.array(F.hash("text")))).alias("pos", "gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("n"))
    rare = Window.partitionBy("nid").orderBy("n", "gram")
    return grams.join(often, "gram").select("nid", "size", "gram", "pos", F.rank().over(rare).alias("place"))


def _edits(limit: Column, longer: Column) -> Column:
    """How many edits two texts of likeness ``limit`` may be apart."""
    return F.floor((1 - limit) * longer + 1e-9).cast("int")


def gram_pairs(left: DataFrame, right: DataFrame, places: DataFrame, ordered: bool) -> DataFrame:
    """Distinct (a, b, block, limit) of rows of one block whose texts may be as alike as ``limit``.

    ``left``: (a, nid, block, limit), ``right``: (b, nid, block). Of k edits each destroys at most two bigrams of a text, one that
    only makes the other text longer at most one; so among that many and one more of the rarest bigrams of either text
    is one that the other has, too, at most k places away. Limits are above 2/3, where that leaves a bigram at any length.
    Rows are ids and numbers: texts aren't moved. ``ordered`` keeps the pairs with a < b.
    """
    kept = F.col("place") <= 2 * _edits(F.col("limit"), F.col("size")) + 2
    x = left.join(places, "nid").filter(kept).select("a", "block", "limit", "gram", *[F.col(c).alias(f"{c}_a") for c in ("size", "pos", "place")])
    y = right.join(places, "nid").select("b", "block", "gram", *[F.col(c).alias(f"{c}_b") for c in ("size", "pos", "place")])
    longer = F.greatest("size_a", "size_b")
    k = _edits(F.col("limit"), longer)
    least = lambda end: F.col(f"place_{end}") <= 2 * k - (longer - F.col(f"size_{end}")) + 1
    fits = (F.abs(F.col("size_a") - F.col("size_b")) <= k) & (F.abs(F.col("pos_a") - F.col("pos_b")) <= k) & least("a") & least("b")
    met = x.join(y, ["block", "gram"]).filter(fits & (F.col("a") < F.col("b")) if ordered else fits)
    return met.select("a", "b", "block", "limit").distinct()


def _likeness(a: Column, b: Column, limit: Column) -> Column:
    """Likeness of two texts if it reaches the limit, else null: edit distances stop there."""
    longer = F.greatest(F.length(a), F.length(b))
    distance = F.call_function("levenshtein", a, b, _edits(limit, longer))
    return F.when(longer == 0, 1.0).when(distance >= 0, 1 - distance / longer)


def alike_texts(texts: DataFrame, least: float) -> DataFrame:
    """(a, b, likeness) of different texts at least as alike, both ways round, and each with itself."""
    own = cut_lineage(texts.select("text").distinct().withColumn("nid", F.monotonically_increasing_id()))
    one = own.select("nid", F.lit(0).alias("block"))
    pairs = gram_pairs(one.select(F.col("nid").alias("a"), "nid", "block", F.lit(least).alias("limit")), one.select(F.col("nid").alias("b"), "nid", "block"), gram_places(own), True)
    of = lambda end: own.select(F.col("nid").alias(end), F.col("text").alias(f"text_{end}"))
    alike = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("likeness", _likeness(F.col("text_a"), F.col("text_b"), F.col("limit"))).filter("likeness IS NOT NULL")
    both = F.array(F.struct(F.col("text_a").alias("a"), F.col("text_b").alias("b")), F.struct(F.col("text_b").alias("a"), F.col("text_a").alias("b")))
    return alike.select("likeness", F.inline(both)).select("a", "b", "likeness").union(own.select("text", "text", F.lit(1.0)))


def candidate_classes(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD, ordered: bool = False) -> DataFrame:
    """(a, b, org_score, limit) of classes (rep, name, org) of two tables that may be similar.

    Different organizations are compared first. How alike two of them are says how alike names under them must
    be for the mean to reach the threshold; so the names under equal organizations meet at ``2 * threshold - 1``, those under others at
    more, and names under organizations that aren't alike not at all.
    """
    low = 2 * threshold - 1
    if low <= 2 / 3:
        raise ValueError("texts of likeness 2/3 or less need not share a gram: the threshold must be above 5/6")
    orgs = alike_texts(left.select(F.col("org").alias("text")).union(right.select("org")), low)
    orgs = cut_lineage(orgs.filter("a <= b") if ordered else orgs).withColumn("block", F.xxhash64("a", "b"))
    blocks = orgs.select(F.col("a").alias("part_a"), F.col("b").alias("part_b"), "block", F.greatest(F.lit(low), 2 * threshold - F.col("likeness")).alias("limit"), "likeness")
    rows = lambda of: of.select(F.col("rep").alias("id"), F.col("org").alias("part"), F.col("name").alias("text"))
    pairs = pairs_in_blocks(rows(left), rows(right), blocks, ordered)
    # A block is a pair of organizations; should two pairs share a hash, the names' own organizations are asked below.
    found = pairs.join(blocks.select("block", F.col("part_a").alias("org_a"), F.col("part_b").alias("org_b"), "limit", F.col("likeness").alias("org_score")), "block")
    if not ordered:
        return found.select("a", "b", "block", "limit", "org_a", "org_b", "org_score")
    turned = F.col("a") > F.col("b")
    way = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    return found.select(way("a", "b").alias("a"), way("b", "a").alias("b"), "block", "limit", way("org_a", "org_b").alias("org_a"), way("org_b", "org_a").alias("org_b"), "org_score")


def similar_classes(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD, ordered: bool = False) -> DataFrame:
    """(a, b, score) of the classes (rep, name, org) of two tables whose mean likeness of name and organization reaches the threshold; with ``ordered`` those with a < b.

    Names under two organizations are compared tile by tile, so a very large organization is spread over tasks; candidates are
    nearly all in the result. Texts are fetched for candidates alone.
    """
    found = candidate_classes(left, right, threshold, ordered)
    of = lambda df, end: df.select(F.col("rep").alias(end), F.col("name").alias(f"name_{end}"), F.col("org").alias(f"org_{end}"))
    met = found.join(of(left, "a"), ["a", "org_a"]).join(of(right, "b"), ["b", "org_b"])
    score = (_likeness(F.col("name_a"), F.col("name_b"), F.col("limit")) + F.col("org_score")) / 2
    return met.select("a", "b", score.alias("score")).filter(F.col("score") >= threshold)


def near_duplicates(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, score) of different classes of one table that are similar."""
    return similar_classes(classes, classes, threshold, ordered=True)


def content_signature(c: dict[str, Column], raw: dict[str, Column]) -> Column:
    """What decides eligibility, as sorted key=value pairs."""
    number = lambda x: F.coalesce(F.regexp_replace(x.cast("string"), "\\.0\\z", ""), F.lit(""))
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    fields = {
        "title": one_blank(c["title"]), "summary": one_blank(c["summary"]), "ageMin": number(c["age_min"]), "ageMax": number(c["age_max"]),
        "incomeKind": text(c["income"]["kind"]), "incomeMaxRatio": number(c["income"]["max_ratio"]),
        "incomeMaxAmount": number(c["income"]["max_amount"]), "incomeRaw": one_blank(c["income"]["raw"]),
        "regionCodes": F.array_join(F.array_sort(c["region_codes"]), ","), "regionText": one_blank(c["region_text"]),
        "isNationwide": text(c["is_nationwide"]), "recruitKind": text(c["recruit"]["kind"]), "recruitStart": text(c["recruit"]["start"]),
        "recruitEnd": text(c["recruit"]["end"]), "category": one_blank(c["category"]),
        "rawText": F.concat_ws("|", *[F.concat(F.lit(f"{k}="), one_blank(raw[k])) for k in HASHED_TEXTS]),
    }
    return F.concat_ws("|", *[F.concat(F.lit(f"{k}="), fields[k]) for k in sorted(fields)])


def content_hash(row_id: Column, last_modified: Column, signature: Column) -> Column:
    """Hash of the id, the date of the last change and the signature; either change shows."""
    return fnv1a(F.concat(row_id, F.lit(" lm "), F.coalesce(non_empty(last_modified), F.lit("")), F.lit(" sig "), signature))


def with_hash(rows: DataFrame) -> DataFrame:
    """Adds content_hash to normalized rows."""
    c, raw = {n: F.col(n) for n in rows.columns}, {k: F.col(f"raw.{k}") for k in HASHED_TEXTS}
    return rows.withColumn("content_hash", content_hash(F.col("id"), F.col("raw.lastModified"), content_signature(c, raw)))


def last_of(previous: DataFrame, key: str, columns: list[str], order: str | None) -> DataFrame:
    """(key, columns) once per key: of several rows the last in ``order``, else the one whose columns are largest."""
    kept = F.struct(*columns)
    best = F.max_by(kept, F.struct(order, F.to_json(kept)) if order else F.to_json(kept))
    return previous.groupBy(key).agg(best.alias("_r")).select(key, "_r.*")


def changed(current: DataFrame, previous: DataFrame, key: str = "id", hash_column: str = "content_hash", order: str | None = None) -> DataFrame:
    """Current rows with ``reparse``: true where no previous row has the key or its hash differs. Of repeated previous rows the last in ``order`` counts."""
    before = last_of(previous, key, [hash_column], order).select(F.col(key).alias("_k"), F.col(hash_column).alias("_h"))
    joined = current.join(before, F.col(key) == F.col("_k"), "left")
    return joined.withColumn("reparse", F.col("_k").isNull() | ~F.col(hash_column).eqNullSafe(F.col("_h"))).drop("_k", "_h")


def enrich_changed(marked: DataFrame, previous: DataFrame, enrich: Callable[[DataFrame], DataFrame], carried: list[str], key: str = "id", order: str | None = None) -> DataFrame:
    """Runs ``enrich`` on changed rows only; the others keep the ``carried`` columns of their previous row."""
    before = last_of(previous, key, carried, order)
    return enrich(marked.filter("reparse")).unionByName(marked.filter("NOT reparse").join(before, key, "left"), allowMissingColumns=True)


def upsert(previous: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows and the previous ones that they don't replace. Nothing is deleted."""
    return previous.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def from_second_catalogue(items: DataFrame) -> DataFrame:
    """Items of the second catalogue to raw records."""
    names = {
        "id": "bizId", "title": "policyName", "orgName": "orgName", "regionText": "regionName", "ageText": "ageInfo", "incomeText": "incomeInfo",
        "recruitText": "applyPeriod", "sourceUrl": "detailUrl",
    }
    kept = [F.col(k) for k in ("ordinal",) if k in items.columns]
    return items.select(*kept, *[(F.col(c) if c in items.columns else F.lit(None)).cast("string").alias(n) for n, c in names.items()], F.lit("mongttang").alias("source"))


def parse_input(rows: DataFrame) -> Column:
    """What a parser is given: the texts that decide eligibility, one a line."""
    texts = [F.col(c) for c in ("title", "summary", "region_text", "income.raw", "category")]
    return F.concat_ws("\n", *[F.nullif(t, F.lit("")) for t in texts])


def fallback_explanation(title: Column) -> Column:
    """What is shown instead of an explanation that isn't grounded."""
    own = non_empty(title)
    return F.when(own.isNull(), FALLBACK_PLAIN).otherwise(F.concat(own, F.lit(FALLBACK_TITLED)))


def grounding_corpus(rows: DataFrame) -> Column:
    """The texts that an explanation may draw on: eight fields, never the id or the raw record."""
    number = lambda c: F.regexp_replace(F.when(F.abs(c) < float("inf"), c).cast("string"), "\\.0\\z", "")
    parts = [non_empty(F.col(c)) if c not in ("age_min", "age_max") else number(F.col(c)) for c in ("title", "summary", "category", "age_min", "age_max", "region_text", "source_url")]
    return F.concat_ws(" ", *parts)


def narrowed(answer: Column) -> Column:
    """A model's JSON answer within its schema: what isn't one of the known values is UNKNOWN; a limit needs its number."""
    text = lambda path: F.get_json_object(answer, path)
    one_of = lambda c, known: F.when(c.isin(known), c).otherwise("UNKNOWN")
    # JSON strings that look like numbers are no numbers: the raw value must not begin with a quote.
    income = F.from_json(text("$.incomeCriterion"), "map<string,string>")
    value = F.from_json(text("$.incomeCriterion"), "struct<value: variant>")["value"]
    number = F.when(F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double"))
    kind = F.try_element_at(income, F.lit("kind"))
    known = F.when(kind == "none", kind).when(kind.isin(INCOME_KINDS) & (F.abs(number) < float("inf")), kind).otherwise("UNKNOWN")
    return F.struct(
        one_of(text("$.householdSeparation"), HOUSEHOLD_STATES).alias("household"), known.alias("income_kind"),
        F.when(known.isin("medianRatio", "amountMax"), number).alias("income_value"), F.try_element_at(income, F.lit("raw")).alias("income_raw"),
        one_of(text("$.duplicateParticipation"), DUPLICATE_STATES).alias("duplicates"),
        text("$.chunks.purpose").alias("purpose"), text("$.chunks.eligibility").alias("eligibility"), text("$.chunks.application").alias("application"),
    )


Step = Callable[[DataFrame], DataFrame]


def _with(rows: DataFrame, **columns: str) -> DataFrame:
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in rows.columns})


def assembled(marked: DataFrame, previous: DataFrame, now: Column, parse_: Step | None, explain: Step | None, vectors: DataFrame | None, force: bool, order: str | None = None) -> DataFrame:
    """Stored rows: what changed is parsed, explained and embedded anew, the rest carried forward.

    ``parse_`` and ``explain`` take rows and add ``parsed`` or ``explanation``; ``vectors`` (id, vector) holds
    what an embedder gave for the changed ids. A missing explanation is filled in; so is a missing vector.
    """
    carried = ["parsed", "explanation", "vector", "updated_at"]
    kept = _with(previous, parsed="string", explanation="string", vector="array<double>", updated_at="timestamp")
    before = last_of(kept, "id", carried, order).withColumnsRenamed({c: f"_{c}" for c in carried})
    rows = marked.join(before, "id", "left")
    fresh = rows.filter("reparse").withColumn("parsed", F.lit(None).cast("string"))
    fresh = parse_(fresh.drop("parsed")) if parse_ else fresh
    rows = fresh.unionByName(rows.filter("NOT reparse").withColumn("parsed", F.col("_parsed")))
    if explain:
        wanted = F.col("reparse") | F.col("_explanation").isNull() | F.lit(force)
        rows = explain(rows.filter(wanted)).unionByName(rows.filter(~wanted).withColumn("explanation", F.col("_explanation")))
    else:
        rows = rows.withColumn("explanation", F.when(~F.col("reparse"), F.col("_explanation")))
    body = index_text(F.get_json_object("parsed", "$.chunks.purpose"), F.get_json_object("parsed", "$.chunks.eligibility"), F.col("title"), F.col("summary"))
    need = (F.col("reparse") | F.col("_vector").isNull()) & (F.trim(body) != "")
    if vectors is not None:
        own = last_of(vectors, "id", ["vector"], None).withColumnRenamed("vector", "_new")
        rows = rows.join(own, "id", "left").withColumn("vector", F.when(need, F.when(F.size("_new") > 0, F.col("_new"))).otherwise(F.col("_vector"))).drop("_new")
    else:
        rows = rows.withColumn("vector", F.col("_vector"))
    return rows.withColumns({
        "fetched_at": now, "updated_at": F.when(F.col("reparse"), now).otherwise(F.coalesce("_updated_at", now)),
        "keywords": index_keywords(F.col("title"), F.col("category")),
    }).drop(*[f"_{c}" for c in carried])


def ingest(
    raw: DataFrame, previous: DataFrame, now: Column, scope: str = "all", secondary: str = "seoul-youth", parse_: Step | None = None, explain: Step | None = None,
    vectors: DataFrame | None = None, force_explain: bool = False, order: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows to store, one row of counters): normalize, newest, scope, suppress, hash, recompute what changed, assemble.

    ``raw``: raw records with ``ordinal``, the order of arrival; ``previous``: the stored rows (id, content_hash and
    what is carried; of repeated ids the last in ``order`` counts). Each step is a filter, a join or an aggregate over all rows; the
    counters are one aggregate over flags.
    """
    rows = normalized(raw).withColumn("last_modified", F.col("raw.lastModified"))
    # Kept, so that the parsers see each record once; rows without an id are one group a source.
    named = cut_lineage(newest(rows, ["source", "id"]))
    verdict = F.lit("pass") if scope == "all" else region_verdict(F.col("region_codes"), F.col("is_nationwide"), F.col("region_text"))
    judged = named.withColumn("verdict", F.when(F.col("id") == "unknown", "no-id").otherwise(verdict))
    canonical = F.coalesce(F.array_contains("region_codes", CITY), F.lit(False)) | F.coalesce("is_nationwide", F.lit(False))
    marked = suppression(judged.filter("verdict = 'pass'"), F.col("title"), F.col("source"), secondary, canonical)
    seen = changed(with_hash(marked), _with(previous, content_hash="string"), order=order)
    every = cut_lineage(judged.filter("verdict <> 'pass'").unionByName(seen, allowMissingColumns=True))
    of = lambda kind: F.col("verdict") == kind
    counts = every.agg(
        F.coalesce(F.sum(F.when(of("no-id"), F.col("copies"))), F.lit(0)).alias("dropped_no_id"), F.count_if(of("non-seoul")).alias("dropped_non_seoul"), F.count_if(of("unknown-region")).alias("dropped_unknown_region"),
        F.coalesce(F.sum(F.when(~of("no-id"), F.col("copies") - 1)), F.lit(0)).alias("merged_duplicates"), F.count_if("suppressed").alias("suppressed_cross_source"),
        F.count_if(~F.col("suppressed") & F.col("reparse")).alias("reparsed"),
    )
    current = every.filter("verdict = 'pass' AND NOT suppressed").drop("suppressed", "verdict")
    return assembled(current, previous, now, parse_, explain, vectors, force_explain, order), counts
