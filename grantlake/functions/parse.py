"""Free text to typed columns. Nothing raises: what can't be read becomes null or ``unknown``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grantlake.functions.constants import (
    BLANK_CLASS,
    DOCUMENT_NOUN,
    MENTAL_STRONG,
    MENTAL_TERM,
    NATIONWIDE,
    NO_DOCUMENTS,
    PROVINCES,
)
from grantlake.functions.text import js_trim, let, non_empty

FULL_DATE = "(\\d{4})\\s*[.\\-/]\\s*(\\d{1,2})\\s*[.\\-/]\\s*(\\d{1,2})"
TILDE = "[~～∼〜]"


def _group(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def parse_age(age_min: Column, age_max: Column, text: Column) -> Column:
    """struct(age_min, age_max): numbers win over text; an upper bound in words wins over a lower one; reversed is unknown."""
    age_min, age_max = (F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c) for c in (age_min.cast("double"), age_max.cast("double")))
    text = non_empty(text)
    most, least = _group(text, "(\\d+)\\s*세?\\s*이하", 1), _group(text, "(\\d+)\\s*세?\\s*이상", 1)
    span = "(\\d+)\\s*세?\\s*[~\\-–]\\s*(?:만\\s*)?(\\d+)"
    free = text.rlike("제한\\s*없음|무관")
    numbers = age_min.isNotNull() | age_max.isNotNull()
    low = F.when(numbers, age_min).when(free | most.isNotNull(), None).otherwise(F.coalesce(least, _group(text, span, 1)).try_cast("double"))
    high = F.when(numbers, age_max).when(free, None).when(most.isNotNull(), most.try_cast("double"))
    high = high.when(least.isNotNull(), None).otherwise(_group(text, span, 2).try_cast("double"))
    reversed_ = F.coalesce(low > high, F.lit(False))
    return F.struct(F.when(~reversed_, low).alias("age_min"), F.when(~reversed_, high).alias("age_max"))


def parse_income(text: Column) -> Column:
    """struct(kind, max_ratio, max_amount, raw). A stated ratio wins over 'no limit', which must end the text."""
    raw = non_empty(text)
    ratio = _group(raw, "중위소득\\s*(\\d+)\\s*%", 1).try_cast("double")
    kind = F.when(raw.isNull(), "unknown").when(ratio.isNotNull(), "medianRatio")
    kind = kind.when(raw.rlike("(무관|제한\\s*없음|상관\\s*없음)\\s*\\z"), "none").otherwise("unknown")
    return F.struct(kind.alias("kind"), ratio.alias("max_ratio"), F.lit(None).cast("double").alias("max_amount"), raw.alias("raw"))


def parse_region(text: Column) -> Column:
    """struct(codes, text, nationwide): every province named anywhere, in dictionary order."""
    text = non_empty(text)
    codes = F.filter(F.array(*[F.when(text.rlike(p), code) for code, _, p in PROVINCES]), lambda c: c.isNotNull())
    return F.struct(codes.alias("codes"), text.alias("text"), F.coalesce(text.rlike(NATIONWIDE), F.lit(False)).alias("nationwide"))


def to_date(text: Column) -> Column:
    """A calendar date written Y-M-D with points, slashes or dashes; null if there is no such day."""
    norm = F.regexp_replace(js_trim(text), "[./]", "-")
    return let(norm, lambda n: F.when(n.rlike("^\\d{4}-\\d{1,2}-\\d{1,2}\\z"), F.try_to_date(n, "yyyy-M-d")))


def recruit_window(start: Column, end: Column) -> Column:
    """struct(kind, start, end) of two given texts: dated, or unknown if one is broken, both are missing or they are reversed."""

    def window(x: Column) -> Column:
        first, last = x["first"], x["last"]
        bad = x["broken"] | (first.isNull() & last.isNull()) | F.coalesce(last < first, F.lit(False))
        return F.struct(F.when(bad, "unknown").otherwise("dated").alias("kind"), F.when(~bad, first).alias("start"), F.when(~bad, last).alias("end"))

    def dated(x: Column) -> Column:
        broken = (x["start"].isNotNull() & x["first"].isNull()) | (x["end"].isNotNull() & x["last"].isNull())
        return let(F.struct(x["first"].alias("first"), x["last"].alias("last"), broken.alias("broken")), window)

    def given(x: Column) -> Column:
        return let(F.struct(x["start"].alias("start"), x["end"].alias("end"), to_date(x["start"]).alias("first"), to_date(x["end"]).alias("last")), dated)

    return let(F.struct(start.alias("start"), end.alias("end")), given)


def parse_recruit(start: Column, end: Column, text: Column) -> Column:
    """Explicit texts win; then 'always'; then the first two dates in the text."""
    none = F.lit(None).cast("date")
    always = F.struct(F.lit("always").alias("kind"), none.alias("start"), none.alias("end"))

    def read(x: Column) -> Column:
        given = x["start"].isNotNull() | x["end"].isNotNull()
        dates = F.regexp_extract_all(x["text"], F.lit("(\\d{4}[.\\-/]\\d{1,2}[.\\-/]\\d{1,2})"), 1)
        found = let(dates, lambda d: recruit_window(F.get(d, F.lit(0)), F.get(d, F.lit(1))))
        return F.when(given, recruit_window(x["start"], x["end"])).when(F.coalesce(x["text"].rlike("상시|연중|수시"), F.lit(False)), always).otherwise(found)

    return let(F.struct(non_empty(start).alias("start"), non_empty(end).alias("end"), non_empty(text).alias("text")), read)


def clean_documents(text: Column) -> Column:
    """Required documents as written, or null where the text says nothing."""
    t = js_trim(text)
    compact = F.regexp_replace(t, "[\\s☞→▶►※·.\\-~()]", "")
    notice = t.rlike("붙임|첨부") & t.rlike("확인|참고|바랍니다") & ~t.rlike(DOCUMENT_NOUN) & (F.length(t) <= 100)
    return F.when((F.regexp_count(t, F.lit("[가-힣]")) >= 2) & ~compact.rlike(NO_DOCUMENTS) & ~notice, t)


def is_mental_health(title: Column, category: Column) -> Column:
    title, category = F.coalesce(title, F.lit("")), F.coalesce(category, F.lit(""))
    return title.rlike(MENTAL_STRONG) | (category.contains("건강") & title.rlike(MENTAL_TERM))


def decode_entities(c: Column) -> Column:
    """Six entities, the ampersand first, so that a doubly written one is decoded twice."""
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def strip_tags(c: Column) -> Column:
    return js_trim(F.regexp_replace(decode_entities(F.regexp_replace(c, "<[^>]+>", " ")), f"{BLANK_CLASS}+", " "))


def list_items(html: Column) -> Column:
    """array<struct(key, title)> of a crawled list page, both non-empty."""
    pattern = "goView\\('([^']+)'\\)\\s*;?\\s*\"[^>]*>([^<]+)<"
    pairs = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(pattern), 1).alias("key"), F.regexp_extract_all(html, F.lit(pattern), 2).alias("title")
    )
    made = F.transform(pairs, lambda p: F.struct(js_trim(p["key"]).alias("key"), decode_entities(js_trim(p["title"])).alias("title")))
    return F.filter(made, lambda p: (p["key"] != "") & (p["title"] != ""))


def is_native_key(key: Column) -> Column:
    key = js_trim(key)
    return (key != "") & ~key.rlike("^\\d+\\z")


def label_values(html: Column) -> Column:
    """map(label, value) of a detail page's definition rows; the first of a repeated label counts."""
    clean = F.regexp_replace(F.regexp_replace(html, "(?is)<script.*?</script>", ""), "(?is)<style.*?</style>", "")
    row = "(?is)<(dt|th)[^>]*>(.*?)</\\1>\\s*<(dd|td)[^>]*>(.*?)</\\3>"
    raw = let(clean, lambda c: F.arrays_zip(F.regexp_extract_all(c, F.lit(row), 2).alias("label"), F.regexp_extract_all(c, F.lit(row), 4).alias("value")))
    named = F.transform(raw, lambda r: F.struct(F.regexp_replace(strip_tags(r["label"]), f"{BLANK_CLASS}+", "").alias("label"), strip_tags(r["value"]).alias("value")))
    kept = F.filter(named, lambda r: F.length(r["label"]).between(1, 39))
    # Each list is made once a page, not once a row of it.
    labelled = let(kept, lambda k: F.struct(k.alias("rows"), F.transform(k, lambda x: x["label"]).alias("labels")))
    return F.map_from_entries(let(labelled, lambda x: F.filter(x["rows"], lambda r, k: F.array_position(x["labels"], r["label"]) == k + 1)))


def field(fields: Column, *labels: str) -> Column:
    """The first of the labels that has a value."""
    return F.coalesce(*[non_empty(F.try_element_at(fields, F.lit(x))) for x in labels])


def loose_date(text: Column, k: int) -> Column:
    """The k-th date in a text as yyyy-MM-dd, whether or not the calendar has it."""
    parts = [F.get(F.regexp_extract_all(text, F.lit(FULL_DATE), g), F.lit(k)) for g in (1, 2, 3)]
    return F.concat(parts[0], *[F.concat(F.lit("-"), F.lpad(p, 2, "0")) for p in parts[1:]])


def _month_end(year: Column, month: Column) -> Column:
    """The last day of a month; months beyond 12 run on into the next year."""
    return F.day(F.last_day(F.add_months(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), month.cast("int") - 1)))


def _ymd(year: Column, month: Column, day: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day.cast("string"), 2, "0"))


def coarse_end(text: Column) -> Column:
    """The end of an operation period as yyyy-MM-dd, inferred from what follows the first tilde.

    A full date stands; a month ends on its last day; a year ends in June if it says first half, else in
    December; without a year the start's year is taken, or the next one if the month comes before the
    start's. Years are 2000 to 2099 and no part of a longer number. An open end is null.
    """
    year = "(?<!\\d)(20\\d{2})(?!\\d)"
    month_day = "\\s*[.\\-/]\\s*(\\d{1,2})\\s*[.\\-/]\\s*(\\d{1,2})"
    of_month = year + "\\s*[.\\-/]\\s*(\\d{1,2})(?!\\s*[.\\-/]\\s*\\d)"
    start = year + "\\s*[.\\-/]\\s*(\\d{1,2})"
    pair = "(\\d{1,2})\\s*[.\\-/]\\s*(\\d{1,2})"

    def last(c: Column, pattern: str, group: int) -> Column:
        return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), group), F.lit(-1))

    def parted(t: Column) -> Column:
        head = lambda cut: F.when(cut > 0, F.substring(t, F.lit(1), cut - 1)).alias("head")
        tail = lambda cut: F.when(cut > 0, F.substring(t, cut + 1, F.length(t))).otherwise(t).alias("tail")
        return let(F.regexp_instr(t, F.lit(TILDE)), lambda cut: F.struct(head(cut), tail(cut)))

    def of_year(tail: Column, p: Column) -> Column:
        """The end without a year: ``p`` has the start's year and month, and the end's month."""
        y = F.when(p["m"] < p["start_month"], p["start_year"] + 1).otherwise(p["start_year"])
        ends = F.struct(y.alias("y"), p["m"].alias("m"), F.when(p["m"].between(1, 12), _month_end(y, p["m"])).alias("last_day"))
        dated = lambda e: F.struct(e["y"].alias("y"), e["m"].alias("m"), e["last_day"].alias("last_day"), F.coalesce(_group(tail, pair, 2).cast("int"), e["last_day"]).alias("d"))
        made = lambda e: F.when((e["d"] >= 1) & (e["d"] <= e["last_day"]), _ymd(e["y"], e["m"], e["d"]))
        return F.when(p["start_year"].isNotNull(), let(let(ends, dated), made))

    def read(x: Column) -> Column:
        head, tail = x["head"], x["tail"]
        full = _ymd(last(tail, year + month_day, 1), last(tail, year + month_day, 2), last(tail, year + month_day, 3))
        month = let(F.struct(last(tail, of_month, 1).alias("y"), last(tail, of_month, 2).alias("m")), lambda p: _ymd(p["y"], p["m"], _month_end(p["y"], p["m"])))
        whole = F.concat(last(tail, year, 1), F.when(tail.contains("상반기"), "-06-30").otherwise("-12-31"))
        m = F.coalesce(_group(tail, pair, 1), _group(tail, "(?<!\\d)(\\d{1,2})(?=\\s*(?:[.\\-/월]|\\z))", 1)).cast("int")
        begun = F.struct(last(head, start, 1).cast("int").alias("start_year"), last(head, start, 2).cast("int").alias("start_month"), m.alias("m"))
        return F.coalesce(full, month, whole, let(begun, lambda p: of_year(tail, p)))

    # Each part is a value that is computed once: written out, every pattern would be searched again wherever its result is named.
    return let(let(text, parted), read)


def crawled_recruit(apply_text: Column, operation_text: Column) -> Column:
    """struct(start_text, end_text, text): application dates, else the operation period, else 'always'."""

    def dated(x: Column) -> Column:
        dates = {"a0": loose_date(x["a"], 0), "a1": loose_date(x["a"], 1), "o0": loose_date(x["o"], 0), "o1": loose_date(x["o"], 1), "coarse": coarse_end(x["o"])}
        return F.struct(x["a"].alias("a"), *[c.alias(name) for name, c in dates.items()])

    def chosen(x: Column) -> Column:
        applied, run = x["a0"].isNotNull(), x["o1"].isNotNull()
        always = ~applied & ~run & x["coarse"].isNull() & F.coalesce(x["a"].rlike("상시|수시|연중"), F.lit(False))
        return F.struct(
            F.when(applied, x["a0"]).when(run, x["o0"]).alias("start_text"),
            F.when(applied, x["a1"]).when(run, x["o1"]).otherwise(x["coarse"]).alias("end_text"),
            F.when(always, "상시").alias("text"),
        )

    return let(let(F.struct(apply_text.alias("a"), operation_text.alias("o")), dated), chosen)


def region_text(zip_codes: Column, institution: Column) -> Column:
    """The provinces of a list of codes by name; ten or more are nationwide; none known gives the institution."""
    known = F.create_map(*[F.lit(x) for code, name, _ in PROVINCES for x in (code, name)])
    codes = F.filter(F.transform(F.split(F.coalesce(zip_codes, F.lit("")), ","), js_trim), lambda c: c != "")
    heads = F.array_distinct(F.transform(codes, lambda c: F.substring(c, 1, 2)))
    names = F.filter(F.transform(heads, lambda h: F.try_element_at(known, h)), lambda n: n.isNotNull())
    return F.when(F.size(heads) >= 10, "전국").when(F.size(names) > 0, F.array_join(names, " ")).otherwise(F.nullif(institution, F.lit("")))


def source_url(*urls: Column) -> Column:
    """The first URL with a path or a query of its own, else the first there is."""
    found = [non_empty(u) for u in urls]
    own = [F.when((F.length(F.try_parse_url(u, F.lit("PATH"))) > 1) | F.try_parse_url(u, F.lit("QUERY")).isNotNull(), u) for u in found]
    return F.coalesce(*own, *found)


def eight_digits(c: Column) -> Column:
    """yyyyMMdd as yyyy-MM-dd by shape alone."""
    return F.when(js_trim(c).rlike("^\\d{8}\\z"), F.regexp_replace(js_trim(c), "^(\\d{4})(\\d{2})(\\d{2})\\z", "$1-$2-$3"))


def age_number(c: Column) -> Column:
    """A positive finite number, or null."""
    n = c.try_cast("double")
    return F.when((n > 0) & (n < float("inf")) & ~F.isnan(n), n)


def document_segments(text: Column) -> Column:
    """array<struct(type, text)>: a document list cut at its marks; every meaningful character is kept."""
    from grantlake.functions.constants import LEADING_NOISE, MEANINGFUL, SEGMENT_BOUNDARY

    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), LEADING_NOISE, ""), "\r\n|\r|\n")
    pieces = F.flatten(F.transform(lines, lambda x: F.split(F.regexp_replace(x, SEGMENT_BOUNDARY, "\u0001$0"), "\u0001")))
    kept = F.filter(F.transform(pieces, js_trim), lambda p: p.rlike(MEANINGFUL))

    def typed(p: Column) -> Column:
        kind = F.when(p.rlike("^(?:[0-9]{1,2}\\.|[①-⑳])"), "item").when(p.rlike("^[*※☞]"), "note")
        kind = kind.when(p.rlike("^[\\[［]"), "header").when(p.rlike("^[（(][^)）]*(?:제출|업로드)[)）]"), "header").otherwise("text")
        return F.struct(kind.alias("type"), p.alias("text"))

    return F.transform(kept, typed)
