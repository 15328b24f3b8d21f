"""What happens to evaluated rows: year variants, order, labels, checklist, display values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grantlake.functions.constants import CATEGORY_TAGS, DOCUMENTS, ORIGINS, PROVINCES, REVIEW_LABELS, REVIEW_TEXTS
from grantlake.functions.text import js_trim, title_year, without_years
from grantlake.sources.shared import cut_lineage

BUCKET_RANK = {"now": 3, "soon": 2, "review": 1}


def bucket_rank(bucket: Column) -> Column:
    return F.coalesce(*[F.when(bucket == b, r) for b, r in BUCKET_RANK.items()], F.lit(0))


def latest_variants(rows: DataFrame, title: str = "title", bucket: str = "bucket", updated: str = "updated_at", key: str = "id") -> DataFrame:
    """One row per title without its years: best bucket, latest year, latest update, least id.

    Titles of which nothing is left group with no other. The winner is found by a partial maximum in
    every task, so that a title that many rows share is not sorted in one place.
    """
    named = rows.withColumn("_name", without_years(F.col(title)))
    order = F.struct(
        bucket_rank(F.col(bucket)).alias("r"), F.coalesce(title_year(F.col(title)), F.lit(-1)).alias("y"),
        F.coalesce(F.col(updated), F.lit("1000-01-01").cast("timestamp")).alias("u"),
    )
    plain = named.filter("_name <> ''").withColumn("_order", order)
    best = plain.groupBy("_name").agg(F.max("_order").alias("_order"))
    winners = plain.join(best, ["_name", "_order"]).groupBy("_name").agg(F.min_by(F.struct(*rows.columns), F.col(key)).alias("_r"))
    return winners.select("_r.*").unionByName(named.filter("_name = ''").select(*rows.columns))


def review_labels(reasons: Column) -> Column:
    """What is left to check, each once, in the order of the reasons."""
    known = F.create_map(*[F.lit(x) for pair in REVIEW_LABELS.items() for x in pair])
    return F.array_distinct(F.array_compact(F.transform(reasons, lambda r: F.try_element_at(known, r))))


def in_display_order(rows: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Showable rows with ``position``'s sort keys: now, soon, then review with the fewest open points; then arrival."""
    open_points = F.when(F.col("bucket") == "review", F.size(review_labels(F.col("reasons")))).otherwise(0)
    shown = rows.filter(F.col("bucket").isin(*BUCKET_RANK)).withColumn("open_points", open_points)
    return shown.orderBy(F.desc(bucket_rank(F.col("bucket"))), "open_points", ordinal)


def with_positions(shown: DataFrame, within: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Adds ``position``, from 1, in the display order of each list (``within`` names what tells lists apart).

    Rows are dealt by ranges of list and order and numbered in their range; a list that goes on in the next
    range carries its count over. So a list that a third of all rows are in is many tasks, and what meets by
    list is one row a range.
    """
    order = ["_rank", "open_points", ordinal]
    dealt = shown.withColumn("_rank", -bucket_rank(F.col("bucket"))).repartitionByRange(*within, *order).withColumn("_part", F.spark_partition_id())
    dealt = cut_lineage(dealt)  # the limits of the ranges would be drawn anew
    placed = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_part", *within).orderBy(*order)))
    counts = dealt.groupBy("_part", *within).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    names = {c: f"_of_{c}" for c in within}
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n").withColumnsRenamed({**names, "_part": "_of_part"})
    same = F.col("_part") == F.col("_of_part")
    for c, name in names.items():
        same = same & F.col(c).eqNullSafe(F.col(name))
    found = placed.join(before, same).withColumn("position", F.col("_at") + F.col("_before"))
    return found.select(*shown.columns, "position")


def headline_count(rows: DataFrame) -> DataFrame:
    """(n): showable rows after the year variants are merged."""
    return latest_variants(rows.filter(F.col("bucket").isin(*BUCKET_RANK))).agg(F.count("*").alias("n"))


def status_label(bucket: Column, labels: Column) -> Column:
    almost = (bucket == "review") & (F.size(labels) == 1)
    return F.when(almost, "almost").otherwise(bucket)


def checklist(axes: Column, age_min: Column, age_max: Column, nationwide: Column, codes: Column, age: Column) -> Column:
    """array<struct(axis, mark, text)>: a line for every axis that isn't blocked; a passed recruit axis says nothing."""
    whole = lambda c: F.format_string("%d", c.cast("long"))
    span = (
        F.when(age_min.isNotNull() & age_max.isNotNull(), F.concat(whole(age_min), F.lit("~"), whole(age_max), F.lit("세")))
        .when(age_min.isNotNull(), F.concat(whole(age_min), F.lit("세 이상")))
        .otherwise(F.concat(whole(age_max), F.lit("세 이하")))
    )
    own = F.when(age.isNotNull() & ~F.isnan(age.cast("double")), F.concat(F.lit(" — 내 나이 "), whole(age), F.lit("세 충족"))).otherwise(" 충족")
    age_text = F.when(age_min.isNull() & age_max.isNull(), "나이 제한 없음").otherwise(F.concat(F.lit("나이 "), span, own))
    names = F.create_map(*[F.lit(x) for code, name, _ in PROVINCES for x in (code, name)])
    place = F.try_element_at(names, F.get(codes, F.lit(0)))
    region_text = F.when(nationwide, "전국 대상 — 지역 충족").when(place.isNotNull(), F.concat(place, F.lit(" 거주 — 내 지역 충족"))).otherwise("거주 지역 충족")
    review = F.create_map(*[F.lit(x) for pair in REVIEW_TEXTS.items() for x in pair])

    def line(a: Column) -> Column:
        passed = F.when(a["axis"] == "age", age_text).when(a["axis"] == "region", region_text).when(a["axis"] == "income", "소득 제한 없음")
        text = F.when(a["verdict"] == "pass", passed).when(a["verdict"] == "review", F.try_element_at(review, a["axis"]))
        return F.struct(a["axis"].alias("axis"), a["verdict"].alias("mark"), text.alias("text"))

    return F.filter(F.transform(axes, line), lambda x: x["text"].isNotNull())


def display_category(category: Column) -> Column:
    """Comma parts, trimmed, each once."""
    return F.array_join(F.array_distinct(F.filter(F.transform(F.split(category, ","), js_trim), lambda x: x != "")), ", ")


def category_tag(category: Column) -> Column:
    out = F.lit("other")
    for words, tag in reversed(CATEGORY_TAGS):
        out = F.when(F.coalesce(category, F.lit("")).rlike(words), tag).otherwise(out)
    return out


def benefit(explanation: Column, summary: Column) -> Column:
    return F.coalesce(F.nullif(js_trim(explanation), F.lit("")), F.nullif(js_trim(summary), F.lit("")))


def matched_documents(rows: DataFrame, text: str = "documents_text") -> DataFrame:
    """Rows with ``documents``: the known documents that a text names, in the order of the dictionary."""
    entry = lambda i, name, issuer, fee, minutes: F.struct(F.lit(i).alias("id"), F.lit(name).alias("name"), F.lit(issuer).alias("issuer"), F.lit(fee).cast("int").alias("fee"), F.lit(minutes).cast("int").alias("minutes"))
    known = [F.when(F.col(text).contains(d[1]), entry(*d)) for d in DOCUMENTS]
    return rows.withColumn("documents", F.array_compact(F.array(*known)))


def document_of(doc_id: Column) -> Column:
    """struct(id, name, issuer, fee, minutes) of a known document; null for any other id."""
    entry = lambda i, name, issuer, fee, minutes: F.struct(F.lit(i).alias("id"), F.lit(name).alias("name"), F.lit(issuer).alias("issuer"), F.lit(fee).cast("int").alias("fee"), F.lit(minutes).cast("int").alias("minutes"))
    return F.try_element_at(F.create_map(*[x for d in DOCUMENTS for x in (F.lit(d[0]), entry(*d))]), F.coalesce(doc_id, F.lit("")))


def center_of(code: Column) -> Column:
    """struct(region_code, center_name, phone) of a province; names and phones are null until someone has verified them."""
    own = js_trim(code)
    return F.when(own.isin([c for c, _, _ in PROVINCES]), F.struct(own.alias("region_code"), F.lit(None).cast("string").alias("center_name"), F.lit(None).cast("string").alias("phone")))


def fee_text(fee: Column) -> Column:
    return F.when(fee.isNull(), "확인 필요").when(fee == 0, "무료").otherwise(F.concat(F.format_number(fee, 0), F.lit("원")))


def minutes_text(minutes: Column) -> Column:
    return F.concat(F.lit("약 "), minutes.cast("string"), F.lit("분"))


def origin_label(source: Column) -> Column:
    return F.coalesce(*[F.when(source == k, v) for k, v in ORIGINS.items()], F.lit(""))


def updated_text(updated: Column) -> Column:
    """The calendar day of an ISO time stamp, or null."""
    return F.date_format(F.try_to_timestamp(updated), "yyyy-MM-dd")


def _province_name(code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for c, name, _ in PROVINCES for x in (c, name)]), code)


def center_message(code: Column) -> Column:
    name = _province_name(js_trim(code))
    return F.concat(F.lit("혼자 하기 버거우면 "), F.coalesce(F.concat(name, F.lit(" ")), F.lit("")), F.lit("청년센터가 같이 해줘요"))


def _age_text(age: Column) -> Column:
    usable = ~F.isnan(age.cast("double")) & (F.abs(age.cast("double")) < float("inf"))
    return F.when(usable, F.concat(F.regexp_replace(age.cast("string"), "\\.0\\z", ""), F.lit("세")))


def profile_summary(code: Column, age: Column) -> Column:
    """Place and age; an unknown code stands for itself."""
    own = F.nullif(code, F.lit(""))
    return F.concat_ws(" · ", F.coalesce(_province_name(own), own, F.lit("지역")), F.coalesce(_age_text(age), F.lit("나이 입력")))


def match_badge(code: Column, age: Column) -> Column:
    """What of place and age is known."""
    return F.concat_ws(" · ", _province_name(code), _age_text(age))


def stored_profile(age: Column, code: Column) -> Column:
    """struct(age, region_code) of a stored profile: an age between 0 and 150, rounded down, and a trimmed code; else null."""
    number = age.try_cast("double")
    return F.struct(F.when((number > 0) & (number < 150), F.floor(number).cast("int")).alias("age"), F.nullif(js_trim(code), F.lit("")).alias("region_code"))


def client_key(forwarded: Column, real: Column) -> Column:
    """Whom a request counts for: the first hop of x-forwarded-for, else x-real-ip, else 'unknown'."""
    return F.when(F.coalesce(forwarded, F.lit("")) != "", F.trim(F.split(forwarded, ",")[0])).otherwise(F.coalesce(real, F.lit("unknown")))


def toggled(saved: DataFrame, item: DataFrame, limit: int = 100) -> DataFrame:
    """A saved list (id, title, saved_at) after toggling one item: removed if there, else put first; the newest 100 stay."""
    clean = saved.select(js_trim(F.col("id")).alias("id"), js_trim(F.col("title")).alias("title"), "saved_at").filter("id <> '' AND title <> ''")
    once = clean.groupBy("id").agg(F.max_by(F.struct("title", "saved_at"), "saved_at").alias("_r")).select("id", "_r.*")
    added = item.join(once, "id", "left_anti").select("id", "title", "saved_at")
    return once.join(item, "id", "left_anti").unionByName(added).orderBy(F.desc("saved_at"), "id").limit(limit)


def age_input(text: Column) -> Column:
    """A whole, non-negative number written in digits only."""
    t = js_trim(text)
    return F.when(t.rlike("^\\d+\\z"), t.try_cast("int"))


def province_input(code: Column) -> Column:
    t = js_trim(code)
    return F.when(t.isin([c for c, _, _ in PROVINCES]), t)


