"""Readers, writers, statutes, merges and model hooks on small hand-made inputs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from casewright.operators import merge, models, segment, statute
from casewright.sources import io, schemas
from casewright.streaming import ingest


def test_json_lines_keep_good_rows_and_name_bad_ones(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"doc_id": "1", "title": "x"}\n\n{oops\n{"title": "y"}\n')
    good, bad = io.json_lines(spark, str(tmp_path), schemas.T.StructType.fromDDL("doc_id string, title string"), key="doc_id")
    rows = {r.title: r.doc_id for r in good.collect()}
    assert rows["x"] == "1" and len(rows["y"]) == 16 and [r.value for r in bad.collect()] == ["{oops"]


def test_json_documents(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"law_id": "L", "law_name": "소득세법"}, indent=1))
    (tmp_path / "2.json").write_text("not json")
    assert [r.law_id for r in io.json_documents(spark, str(tmp_path), schemas.LAW_DOCUMENT).filter("law_id is not null").collect()] == ["L"]


def test_version_index_keeps_numbers_of_different_years(spark):
    m = {"17": {"version_key": "20200101_00017", "pdate": "20200101", "pno": "00017", "eff_date": "20200201"}, "017": {"version_key": "20210101_17", "pdate": "20210101", "pno": "17", "eff_date": ""}}
    rows = io.version_index(spark.createDataFrame([(json.dumps(m),)], "j string"), "j").orderBy("pdate").collect()
    assert [(r.pno_norm, r.pdate, r.eff_date) for r in rows] == [("17", dt.date(2020, 1, 1), dt.date(2020, 2, 1)), ("17", dt.date(2021, 1, 1), None)]


def test_lookup_prefers_the_first_column(spark):
    d = spark.createDataFrame([("a", "b"), ("b", "c")], "doc_id string, id string")
    assert io.point_lookup(d, "b", "doc_id", "id").first().id == "c"
    assert io.point_lookup(d, "zz", "doc_id", "id").count() == 0


def test_failures_are_loud(spark):
    d = spark.createDataFrame([("xa",), ("ya",), ("b",)], "k string")
    assert io.one_by_suffix(d, "k", "b").first().k == "b"
    with pytest.raises(Exception, match="several rows"):
        io.one_by_suffix(d, "k", "a").collect()
    with pytest.raises(Exception, match="duplicate key"):
        io.unique_index(d.union(d), "k").collect()


def test_required_and_artifacts(spark):
    d = spark.createDataFrame([("1", "x"), ("2", " ")], "id string, name string")
    good, bad = io.required(d, ["id", "name"])
    assert good.count() == 1 and bad.first().lacks == "name"
    f = spark.createDataFrame([("a/A.md",), ("a/B.json",), ("b/C.md",)], "path string")
    rows = {r.group: (r.A, r.B) for r in io.artifacts(f, F.split("path", "/")[0], {"A": "A[.]md$", "B": "B[.]json$"}).collect()}
    assert rows == {"a": (True, True), "b": (False, False)}


def test_stages_and_reports(spark, tmp_path):
    now = dt.datetime(2024, 1, 1)
    s = spark.createDataFrame([("1", "raw", "r", now), ("1", "logic", "old", now), ("1", "logic", "new", now + dt.timedelta(1)), ("2", "raw", "r2", now)], schemas.STAGE)
    io.write_stage(s, f"{tmp_path}/st")
    back = spark.read.schema(schemas.STAGE).parquet(f"{tmp_path}/st")
    assert [(r.case_id, r.raw, r.logic, r.pdf) for r in io.cases_with(back, ["raw", "logic"], ["pdf"]).collect()] == [("1", "r", "new", None)]
    assert io.report(s.limit(1), "case_id", "stage", {"Body": "body"}).first().markdown == "# raw\n\n## Body\n\nr\n"
    assert io.full_report({"raw": io.stage_rows(back, "raw"), "logic": io.stage_rows(back, "logic")}).filter("report.logic is null").first().case_id == "2"


def test_load_only_when_the_stamp_differs(spark, tmp_path):
    build = lambda: spark.range(3).toDF("id")
    assert [io.load_if_newer(spark, build, f"{tmp_path}/t", v) for v in ("1", "1", "2")] == [True, False, True]


def test_binary_documents_and_missing_ids(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes("가나다".encode())
    assert io.binary_documents(spark, str(tmp_path), most=2).first().text == "가나"
    assert io.binary_documents(spark, str(tmp_path), extract=lambda b: b.decode() + "!").first().text == "가나다!"
    assert [r.n for r in io.missing_ids(spark, 1, 4, spark.createDataFrame([(2,)], "n long"), "n").orderBy("n").collect()] == [1, 3, 4]


LAW = {"law_id": "L", "chapters": [{"id": "CH_1", "domain": "d1", "articles": [{"id": "ART_1", "title": "t1", "raw_text": "x", "paragraphs": [{"para_no": "1", "text": "p1", "items": [{"item_no": "1", "text": "i1", "subitems": [{"subitem_no": "가", "text": "s1"}]}]}]}],
        "sections": [{"id": "S_1", "domain": None, "articles": [{"id": "ART_2", "domain": "own", "title": "t2", "raw_text": "y", "paragraphs": []}]}]}]}


def test_statutes_flatten_with_inherited_domains(spark):
    laws = spark.createDataFrame([(json.dumps(LAW),)], "j string").select(F.from_json("j", schemas.LAW_DOCUMENT).alias("l")).select("l.*")
    a = statute.articles(laws)
    assert {r.article_id: (r.domain, r.section_id) for r in a.collect()} == {"ART_1": ("d1", None), "ART_2": ("own", "S_1")}
    u = statute.units(a)
    assert sorted((r.article_id, r.level, r.text) for r in u.collect()) == [("ART_1", "ARTICLE", "t1\nx"), ("ART_1", "ITEM", "i1"), ("ART_1", "PARAGRAPH", "p1"), ("ART_1", "SUBITEM", "s1"), ("ART_2", "ARTICLE", "t2\ny")]
    assert statute.chapter_texts(a, u).first().text == "[CHAPTER] CH_1\nt1\nx\np1\ni1\ns1\nt2\ny"
    assert statute.ranked_article(u.withColumn("text", F.concat(F.lit("제1조("), "text")), "1").first().article_id in ("ART_1", "ART_2")


def test_headings_carry_and_laws_without_chapters(spark):
    rows = [("a", i, s) for i, s in enumerate(["제1장 총칙", "제1절 통칙", "제1조", "제2장 세액", "제2조"])] + [("b", 0, "제1조")]
    h = statute.headings(spark.createDataFrame(rows, "law_id string, pos int, text string"))
    got = {(r.law_id, r.pos): (r.chapter, r.section) for r in h.collect()}
    assert got[("a", 2)] == ("1", "1") and got[("a", 4)] == ("2", None) and got[("b", 0)] == ("CH_0", None)


def test_cross_law_and_external_targets(spark):
    v = spark.createDataFrame([("국세기본법", "k1", 1), ("국세기본법", "k2", 2)], "law_name string, version_key string, effective_at int")
    got = {(r.linked, r.version_key) for r in statute.cross_law_impact(spark.createDataFrame([("관세법",)], "law_name string"), v).collect()}
    assert got == {("부가가치세법", None), ("국세기본법", "k2")}
    t = spark.createDataFrame([("관세법 제1조",), ("관세법 제2조",), ("소득세법 제1조",), ("제3조",)], "target string")
    assert [(r.law_name, r.n) for r in statute.external_targets(t, spark.createDataFrame([("소득세법",)], "law_name string")).collect()] == [("관세법", 2)]


def test_annex_parts_merge_by_base(spark):
    rows = [("v", "ANNEX_0001_2", "table", " ", ["b"]), ("v", "ANNEX_0001_1", "table", "first", ["a"]), ("v", "ANNEX_0001", "form", None, ["a"]), ("v", "ANNEX_0002", "form", "x", [])]
    d = spark.createDataFrame(rows, "version_key string, annex_id string, role string, description string, articles array<string>")
    got = {r.base: (r.parts, r.role, r.description, r.articles) for r in statute.number_of_annexes(d).collect()}
    assert got == {"ANNEX_0001": (3, "table", "first", ["a", "b"]), "ANNEX_0002": (1, "form", "x", [])}


def test_appended_text_and_null_keys(spark):
    d = spark.createDataFrame([(1, 1, "a b"), (1, 2, "a"), (1, 3, "c"), (1, 4, None)], "k int, o int, t string")
    assert merge.append_text(d, ["k"], ["o"], "t").first().t == "a b\nc"
    units = spark.createDataFrame([("A", None), ("A", "1")], "a string, p string")
    tags = spark.createDataFrame([("A", None, "x")], "a string, p string, tag string")
    assert {r.p: r.tag for r in merge.enrich(units, tags, ["a", "p"], {"tag": "-"}).collect()} == {None: "x", "1": "-"}


def test_packs_hold_their_input(spark):
    d = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([3, 4, 20, 1, 1])], "d int, i int, t string")
    rows = segment.pack_rows(d, "d", "i", "t", F.length, 8, "").orderBy("chunk").collect()
    assert [len(r.t) for r in rows] == [7, 20, 2] and "".join(r.t for r in rows) == "x" * 29
    one = segment.reduce_until_one(d, "d", "i", "t", F.length, 8, lambda c: F.substring(c, 1, 3)).collect()
    assert len(one) == 1


def test_models_are_plugged_in(spark):
    d = spark.createDataFrame([(1, "ab"), (2, " "), (3, None)], "id int, t string")
    e = {r.id: r.embedding for r in models.embed(d, "t", lambda ts: [[float(len(t))] for t in ts], batch=2).collect()}
    assert e == {1: [2.0], 2: [1.0], 3: [1.0]}
    index = spark.createDataFrame([(1, "ab", [9.0])], "id int, t string, embedding array<float>")
    assert sorted((r.id, r.embedding) for r in models.embed_pending(d, index, "id", "t", lambda ts: [[0.0] for _ in ts]).collect()) == [(1, [9.0])]
    x = models.extract(d.filter("id = 1"), "id", "t", lambda t: {"n": len(t)}, "n int").collect()
    assert [(r.id, r.n) for r in x] == [(1, 2)]


def test_stream_ingests_each_key_once_and_restarts(spark, tmp_path):
    s = schemas.T.StructType.fromDDL("k long, v string")
    spark.createDataFrame([(1, "a"), (2, "b")], s).write.parquet(f"{tmp_path}/in")
    run = lambda: ingest.run_available(ingest.new_rows(spark, f"{tmp_path}/in", s, "k"), ingest.into_table(f"{tmp_path}/out", "k"), f"{tmp_path}/ck")
    run()
    spark.createDataFrame([(2, "again"), (3, "c")], s).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert sorted((r.k, r.v) for r in ingest.read_table(spark, f"{tmp_path}/out", s, "k").collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_article_by_number_tells_sub_numbers_apart(spark):
    u = spark.createDataFrame([("a", "ART_12", "1", "제12조의2(둘)"), ("a", "ART_12", "2", "제12조 삭제"), ("b", "ART_12", "1", "제12조(하나)"), ("b", "ART_12", "0", "제12조 삭제"), ("c", "ART_12", "1", "제12조의2(셋)")], "law_id string, article_id string, level string, text string")
    got = lambda n: sorted((r.law_id, r.text) for r in statute.ranked_article(u, n).collect())
    assert got("12") == got("제12조") == [("a", "제12조 삭제"), ("b", "제12조(하나)")]
    assert got("12의2") == got("제12조의2") == [("a", "제12조의2(둘)"), ("c", "제12조의2(셋)")]


def test_late_rows_do_not_reopen_a_window(spark, tmp_path):
    day = lambda d: f"2024-01-{d:02d} 12:00:00"
    schema = "at timestamp, kind string"
    for days in ((1, 1, 9), (20,), (1, 21)):
        spark.createDataFrame([(day(d), "a") for d in days], "at string, kind string").select(F.col("at").cast("timestamp").alias("at"), "kind").write.mode("append").parquet(f"{tmp_path}/in")
        counts = ingest.windowed_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "at", "kind")
        ingest.run_available(counts, ingest.into_table(f"{tmp_path}/out", "start"), f"{tmp_path}/state", mode="update")
    out = ingest.latest_rows(spark, f"{tmp_path}/out", counts.schema, ["start", "kind"])
    assert sorted((r.start.day, r.n) for r in out.collect()) == [(1, 2), (9, 1), (20, 1), (21, 1)]
