from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from grantlake.functions import parse, text


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def lit(x):
    return F.lit(x).cast("string") if x is None else F.lit(x)


@pytest.mark.parametrize(("words", "want"), [
    ("19~34", (19, 34)), ("만 19세~만 34세", (19, 34)), ("34세 이하", (None, 34)), ("19세 이상", (19, None)), ("제한없음", (None, None)),
    ("19세 이상 34세 이하", (None, 34)), ("34~19", (None, None)), ("", (None, None)), ("청년", (None, None)), (None, (None, None)),
])
def test_age(spark, words, want):
    none = F.lit(None).cast("double")
    assert tuple(one(spark, parse.parse_age(none, none, lit(words))).c0) == want


def test_age_numbers_win(spark):
    r = one(spark, parse.parse_age(F.lit(20.0), F.lit(None).cast("double"), F.lit("19~34")), parse.parse_age(F.lit(40.0), F.lit(30.0), F.lit("")))
    assert tuple(r.c0) == (20, None) and tuple(r.c1) == (None, None)


@pytest.mark.parametrize(("words", "want"), [
    ("중위소득 150% 이하", ("medianRatio", 150)), ("소득 무관", ("none", None)), ("중위소득 120% 또는 소득 무관", ("medianRatio", 120)),
    ("소득과 무관하게 지원", ("unknown", None)), ("제한 없음\n", ("none", None)), ("﻿ ", ("unknown", None)), (None, ("unknown", None)),
])
def test_income(spark, words, want):
    assert tuple(one(spark, parse.parse_income(lit(words))).c0)[:2] == want


@pytest.mark.parametrize(("words", "codes", "nationwide"), [
    ("서울특별시 부산광역시", ["11", "26"], False), ("전국", [], True), ("전국체전 입상자", [], False), ("서울, 전국 거주", ["11"], True), (None, [], False),
])
def test_region(spark, words, codes, nationwide):
    r = one(spark, parse.parse_region(lit(words))).c0
    assert (r.codes, r.nationwide) == (codes, nationwide)


@pytest.mark.parametrize(("start", "end", "words", "want"), [
    (None, None, "2026.06.01~2026.08.31", ("dated", date(2026, 6, 1), date(2026, 8, 31))), (None, None, "상시모집", ("always", None, None)),
    ("2026-02-30", None, None, ("unknown", None, None)), ("2026-09-01", "2026-08-01", None, ("unknown", None, None)),
    ("2026-6-1", None, "상시", ("dated", date(2026, 6, 1), None)), (None, None, None, ("unknown", None, None)),
])
def test_recruit(spark, start, end, words, want):
    assert tuple(one(spark, parse.parse_recruit(lit(start), lit(end), lit(words))).c0) == want


@pytest.mark.parametrize(("words", "want"), [
    ("2026.01 ~ 2026년", "2026-12-31"), ("2025.03 ~ 2026.02", "2026-02-28"), ("2026년 상반기", "2026-06-30"), ("2026.3 ~ 11월", "2026-11-30"),
    ("2026.11 ~ 2월", "2027-02-28"), ("2026.3.2 ~ 10.15", "2026-10-15"), ("2026.03 ~", None), ("문의 02-1234-5678", None), ("~ 2024.02", "2024-02-29"), (None, None),
])
def test_coarse_end(spark, words, want):
    assert one(spark, parse.coarse_end(lit(words))).c0 == want


def test_documents_and_titles(spark):
    r = one(
        spark, parse.clean_documents(F.lit("--> -")), parse.clean_documents(F.lit("해당 없음")), parse.clean_documents(F.lit(" 신청서, 등본 ")),
        parse.clean_documents(F.lit("자세한 내용은 붙임파일을 확인해주시기 바랍니다")), parse.is_mental_health(F.lit("청년 심리 상담"), F.lit(None)),
        parse.is_mental_health(F.lit("우울 예방"), F.lit("건강")), parse.is_mental_health(F.lit("창업 상담"), F.lit("일자리")),
    )
    assert tuple(r) == (None, None, "신청서, 등본", None, True, True, False)


def test_region_text_and_url(spark):
    many = ",".join(f"{k}110" for k in (11, 26, 27, 28, 29, 30, 31, 36, 41, 43))
    r = one(
        spark, parse.region_text(F.lit(many), F.lit("x")), parse.region_text(F.lit("11110,26110"), F.lit("x")), parse.region_text(F.lit("99"), F.lit("구청")),
        parse.source_url(F.lit("https://a.example/"), F.lit("https://b.example/p")), parse.source_url(F.lit(" "), F.lit("nonsense")),
    )
    assert tuple(r) == ("전국", "서울특별시 부산광역시", "구청", "https://b.example/p", "nonsense")


def test_entities_are_decoded_ampersand_first(spark):
    assert one(spark, parse.strip_tags(F.lit("<b>a</b>&amp;lt;&nbsp;b"))).c0 == "a < b"


def test_segments_keep_every_meaningful_character(spark):
    import random
    import re

    rng = random.Random(20260712)
    parts = ["1. ", "※ ", "[필수] ", "가나", "abc", "○ ", "(온라인 제출) ", "\n", " ", "- ", "①", "12"]
    texts = ["".join(rng.choice(parts) for _ in range(12)) for _ in range(30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", parse.document_segments(F.col("t")).alias("s")).collect()
    keep = re.compile("[가-힣0-9A-Za-z①-⑳]")
    for r in rows:
        assert "".join(keep.findall("".join(s.text for s in r.s))) == "".join(keep.findall(texts[r.id]))


def test_similarities(spark):
    r = one(
        spark, text.trigram_similarity(F.lit("word"), F.lit("two words")), text.normalize_name(F.lit("(재) 서울시 청년-재단")), text.fnv1a(F.lit("가a")),
        text.pair_similarity(F.lit("abcd"), F.lit("x"), F.lit("abce"), F.lit("x")), text.pair_similarity(F.lit(""), F.lit("-"), F.lit("a"), F.lit("b")),
        text.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0))), text.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(3.0), F.lit(4.0))),
    )
    h = 0x811C9DC5
    for c in "가a":
        h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
    assert round(r.c0, 6) == 0.363636 and r.c1 == "서울청년재단" and r.c2 == f"{h:08x}"
    assert (r.c3, r.c4, r.c5, r.c6) == (0.875, 0.0, 0.0, 1.0)
