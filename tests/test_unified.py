"""Laws of mixed shape: one node, a list, lists in lists, missing and stray parts."""

import json

import pytest
from pyspark.sql import functions as F

from casewright.functions import variants as v
from casewright.operators import unified as u


def laws(spark, *raw):
    return spark.createDataFrame([(k, json.dumps({"법령": r}, ensure_ascii=False)) for k, r in enumerate(raw)], "law_id int, j string").select("law_id", F.parse_json("j").alias("law"))


def test_lists_in_lists_to_any_depth(spark):
    deep = "x"
    for _ in range(60):
        deep = [deep, "y"]
    raw = ['["a",["b [",["c\\"]"]],{"k":"no"},null,3]', '"alone"', "[]", None, json.dumps(deep)]
    df = spark.createDataFrame([(r,) for r in raw], "j string").select(F.parse_json("j").alias("v"))
    got = [tuple(r) for r in df.select(v.texts(F.col("v")), v.depth(F.col("v"))).collect()]
    assert got == [(["a", "b [", 'c"]', "3"], 3), (["alone"], 0), ([], 1), ([], 0), (["x"] + ["y"] * 60, 60)]
    blocks = spark.createDataFrame([('["t",{"b":"2","a":"1","n":5,"l":["no"]},7]',)], "j string").select(v.block_texts(F.parse_json("j"))).first()[0]
    assert blocks == "t\n1\n2\n7"


def test_headers_of_every_shape(spark):
    a = {"기본정보": {"법령ID": "7", "법령명_한글": "소득세법 시행령", "법종구분": {"content": " 대통령령 "}, "소관부처": "기재부", "공포번호": 12}, "개정문": {"개정문내용": "one\ntwo"},
         "별표": {"별표단위": {"별표번호": "1", "별표제목": "t", "별표내용": [["r1"], "r2"], "별표이미지파일명": ["i"]}}, "부칙": {"부칙단위": "  kept  "}}
    b = {"기본정보": {"법종구분": {"code": "부령"}}, "개정문": {}, "제개정이유": {"제개정이유내용": []}, "부칙": {"부칙단위": [{"부칙공포일자": "2020", "부칙내용": [[" a "], "b"]}, [["c"]], 5]}}
    rows = [r.h for r in laws(spark, a, b, {}, "odd").select(u.header(F.col("law")).alias("h")).collect()]
    assert (rows[0].law_id, rows[0].kind.strip(), rows[0].ministry, rows[0].source_type, rows[0].promulgation_no) == ("7", "대통령령", "기재부", "DECREE", "12")
    assert rows[0].amendments[0].text == "one\ntwo" and rows[0].revision_reasons == [] and [(x.id, x.content_raw, x.images) for x in rows[0].annexes] == [("ANNEX_1", "r1\nr2", ["i"])]
    assert [tuple(x) for x in rows[0].addenda] == [(None, "kept")]
    assert (rows[1].source_type, rows[1].amendments[0].text, rows[1].revision_reasons[0].text) == ("RULE", "", "")
    assert [tuple(x) for x in rows[1].addenda] == [("2020", "a b"), (None, "c"), (None, "5")]
    for r in rows[2:]:
        assert (r.law_id, r.source_type, r.amendments, r.annexes, r.addenda) == (None, "UNKNOWN", [], [], [])


def test_articles_under_their_headings(spark):
    entries = [
        {"조문여부": "전문", "조문내용": "제1장 총칙", "조문번호": "1"}, {"조문여부": "조문", "조문내용": "목적", "조문번호": "1", "조문변경여부": "Y", "조문참고자료": "note"},
        {"조문내용": [["제2절의3"], "절"]}, {"조문내용": "제3관 관", "조문번호": "9"}, "stray",
        {"조문내용": ["제4조의2(제목)", ["2. line", "<b>3. kept</b>"]], "항": [{"항번호": "①", "항내용": "① 본문", "항제개정유형": "신설", "호": {"호번호": "1.", "호내용": ["1. 호", ["a"]], "목": [{"목번호": "가", "목내용": None}, 3]}}, "no"]},
        {"조문내용": "제2장 둘"}, {"조문내용": "제5조", "항": "text"},
    ]
    df = laws(spark, {"조문": {"조문단위": entries}}, {"조문": {"조문단위": {"조문내용": "제9조 홀로"}}})
    rows = u.unified_articles(df).orderBy("law_id", "pos").collect()
    assert [(r.law_id, r.chapter_id, r.section_id, r.subdivision_id, r.article_id) for r in rows] == [
        (0, "CH_1", None, None, "ART_1"), (0, "CH_1", "CH_1_SEC_2_3", "CH_1_SEC_2_3_SUB_3", "ART_4_2"), (0, "CH_2", None, None, "ART_5"), (1, "CH_0", None, None, "ART_9")]
    assert (rows[0].changed, rows[0].reference_notes, rows[0].paragraphs) == (True, ["note"], [])
    assert rows[1].raw_text == "제4조의2(제목)\nline\n<b>3. kept</b>"
    p = rows[1].paragraphs[0]
    assert (p.para_no, p.text, p.changed, p["items"][0].item_no, p["items"][0].text) == ("①", "본문", True, "1.", "호 a")
    assert [tuple(s) for s in p["items"][0].subitems] == [("가", "")] and rows[2].paragraphs == []
    with pytest.raises(Exception, match="before the first chapter"):
        u.unified_articles(df, strict=True).collect()


def test_a_value_is_worked_out_once(spark):
    # 20 nested calls, each naming its value several times, would work out the innermost text 3 ** 20 times
    v_ = F.parse_json(F.lit('{"a":[["1. x"],"<b>"]}'))
    c = v.field(v_, "a")
    for _ in range(20):
        c = F.to_variant_object(F.array(v.once(c, lambda u: F.when(v.is_list(u) & ~v.is_node(u), u).otherwise(u))))
    assert spark.range(1).select(v.texts(c).alias("t")).first().t == ["1. x", "<b>"]
    odd = spark.createDataFrame([('"[no list"',), ('"{}"',), ("{}",), ("[]",), ("null",), ("1.5",), (None,)], "j string").select(F.parse_json("j").alias("v"))
    assert [tuple(r) for r in odd.select(v.scalar(F.col("v")), v.is_list(F.col("v")), v.is_node(F.col("v")), v.texts(F.col("v"))).collect()] == [
        ("[no list", False, False, ["[no list"]), ("{}", False, False, ["{}"]), (None, False, True, []), (None, True, False, []), (None, False, False, []), ("1.5", False, False, ["1.5"]), (None, False, False, [])]
