"""Korean citations, references within a law, identifiers and repairs, on rows made by hand."""

import datetime as dt

from pyspark.sql import functions as F

from casewright.functions import text as x
from casewright.operators import statute


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s")).alias("v")).first()["v"]


def test_citations_in_order_and_once(spark):
    text = "대법원 2020두12345 판결, 조심 2022서1234, 서울고등법원 2019누1, 2020두12345 및 대법원 2020두12345"
    assert one(spark, text, x.cited) == ["대법원 2020두12345", "조심 2022서1234", "서울고등법원 2019누1", "2020두12345"]
    assert one(spark, None, x.cited) == []


def test_guard_knows_hyphens_and_marks_once(spark):
    valid = x.valid_ids(spark.createDataFrame([("대법원-2015-두-1731", None)], "case_no string, dem_no string"), ["case_no", "dem_no"])
    t = spark.createDataFrame([(1, "대법원 2015두1731 과 대법원 2020두5 와 2020두5"), (2, None)], "id int, t string")
    got = {r.id: (r.t, r.unverified) for r in x.guard(t, "id", "t", valid).collect()}
    assert got[1] == ("대법원 2015두1731 과 **[unverified: 대법원 2020두5]** 와 **[unverified: 2020두5]**", "2020두5|대법원 2020두5")
    assert got[2] == ("", "")


def test_pieces_alternate_even_around_the_mark_itself(spark):
    for text, want in [("a 2020두1, 조심 2022서2", ["a ", "2020두1", ", ", "조심 2022서2", ""]), ("", [""]), ("\u0001 2020두1\u0001", ["\u0001 ", "2020두1", "\u0001"]), ("2020두1", ["", "2020두1", ""])]:
        assert one(spark, text, x.pieces) == want


def test_each_text_is_searched_once(spark):
    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    t = spark.createDataFrame([("소득세법 제1조", 1)], "s string, id int")
    parsed = t.select(x.parse_target(F.col("s")).alias("p"), "id").select("p.law", "p.article_id", "p.item", "id")
    assert plan(parsed).count("regexp_replace(") == 1
    valid = spark.createDataFrame([("2020두1",)], "id string")
    guarded = x.guard(spark.range(50).select("id", F.concat(F.lit("2020두"), "id").alias("s")), "id", "s", valid)
    assert guarded.filter("unverified = ''").count() == 1
    guarded.collect()
    final = guarded._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in final.split("== Initial Plan ==")[0]


def test_targets(spark):
    p = one(spark, "소득세법 시행령 제65조의2 제3항 제4호의5 가목", x.parse_target)
    assert p.asDict() == {"law": "소득세법 시행령", "article_id": "ART_65_2", "paragraph": "3", "item": "4", "item_sub": "5", "sub_item": "가"}
    assert one(spark, "아무 말", x.parse_target) is None


def test_internal_references(spark):
    for said, law in [("이 법 제3조", "소득세법"), ("같은 법 제3조", "소득세법"), ("같은 법 시행령 제3조", "소득세법 시행령"), ("같은 규칙 제1조", "소득세법 시행규칙"), ("해당 시행규칙 제1조", "소득세법 시행규칙"), ("제7조", "소득세법 시행령"), ("법인세법 제7조", None)]:
        assert one(spark, said, lambda c: x.internal_target(c, F.lit("소득세법 시행령"))) == law, said


def test_article_inputs(spark):
    for said, want in [("65", "65"), ("65조", "65"), ("65 의 2", "65_2"), ("065의02", "65_2"), ("abc", ""), (None, ""), ("의2", "")]:
        assert one(spark, said, x.article_input) == want, said


def test_enumerators_keep_years_and_amounts(spark):
    for said, want in [("① 가나", "가나"), ("1. 가나", "가나"), ("2) 가나", "가나"), ("2020년 귀속", "2020년 귀속"), ("1.5배", "1.5배"), ("<p>1. x</p>", "<p>1. x</p>"), (None, "")]:
        assert one(spark, said, x.strip_enumerator) == want, said


def test_small_ones(spark):
    assert one(spark, "제34조의3", lambda c: x.unit_no(c, "조")) == "34_3"
    assert one(spark, "x(2020두12345)y", x.case_id_of) == "2020두12345"
    assert one(spark, "ANNEX_0000", x.annex_parts).asDict() == {"base": "ANNEX_0000", "part": 0}
    assert one(spark, "ANNEX_0001_2", x.annex_parts).asDict() == {"base": "ANNEX_0001", "part": 2}
    assert one(spark, "제1장 총칙 <개정 2020>", x.norm_title) == "제1장 총칙"
    assert one(spark, "대법원_2022도13402", x.file_parts).asDict() == {"court": "대법원", "case_no": "2022도13402", "year": "2022", "case_type": "CRIMINAL"}
    assert one(spark, "beps 대응", lambda c: x.any_of(c, x.CROSS_BORDER)) is True
    assert one(spark, "대통령", lambda c: x.source_type(c, F.lit("가나법"))) == "LAW"
    assert one(spark, "법인세법 시행령에 따른 제3조", x.law_name) == "법인세법 시행령"
    assert one(spark, "Sure:\n```json\n[{}, {\"a\": 1}, // note\n {}]\n```", x.repaired_json).replace(" ", "").replace("\n", "") == '[{"a":1}]'


def test_references_resolve_to_the_deepest_part(spark):
    v = spark.createDataFrame([("소득세법", "v1", dt.date(2020, 1, 1)), ("소득세법", "v2", dt.date(2021, 1, 1))], "law_name string, version_key string, effective_at date")
    u = spark.createDataFrame([("v1", "ART_3", "ARTICLE", None, None, None, "old"), ("v2", "ART_3", "ARTICLE", None, None, None, "whole"), ("v2", "ART_3", "PARAGRAPH", "2", None, None, "second")], "law_id string, article_id string, level string, para_no string, item_no string, subitem_no string, text string")
    r = spark.createDataFrame([(1, "소득세법 제3조 제2항"), (2, "이 법 제3조"), (3, "소득세법 제9조"), (4, "없는 것")], "id int, target string").withColumn("citing_law", F.lit("소득세법")).withColumn("day", F.lit("2022-05-05").cast("date"))
    got = {k.id: (k.text, k.reason) for k in statute.resolve_references(r, v, u).collect()}
    assert got == {1: ("second", None), 2: ("whole", None), 3: (None, "not_found"), 4: (None, "no_pattern")}
