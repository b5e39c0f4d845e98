"""Tags in nested laws, lookups that fail by name, levels of any depth, texts reduced in one job."""

import pytest
from pyspark.sql import functions as F

from casewright.operators import graph, nested, segment
from casewright.sources.versioned import VersionedTable

ART = "struct<id:string,paragraphs:array<struct<para_no:string,text:string,items:array<struct<item_no:string,text:string,subitems:array<struct<subitem_no:string,text:string>>>>>>>"
LAW = f"law_id int, chapters array<struct<id:string,articles:array<{ART}>,sections:array<struct<id:string,articles:array<{ART}>,subdivisions:array<struct<id:string,articles:array<{ART}>>>>>>>"
KEY = "law_id int, article_id string, level string, ref string"


def test_tags_reach_every_level_and_nothing_moves(spark):
    a = lambda k: (k, [("1", "t", [("가", "t", [("1)", "t")]), (None, "t", None)]), ("2", "t", [])])
    rows = [(1, [("c2", [a("A9")], [("s", [a("A1")], [("d", [("A3", None)])])]), ("c1", [], [])]), (2, [("c", [("A1", [])], [])])]
    laws = spark.createDataFrame(rows, LAW)
    norms = spark.createDataFrame([(1, "A1", "SUBITEM", "1|가|1)", ["r"], "l"), (1, "A3", "ARTICLE", "", ["x"], "top"), (1, "A9", "PARAGRAPH", "2", ["b"], "z"), (1, "A9", "PARAGRAPH", "2", ["a"], "y"), (7, "A1", "ARTICLE", "", [], "no")], f"{KEY}, roles array<string>, short_label string")
    refs = spark.createDataFrame([(1, "A1", "ITEM", "1|~", [("t", "u", None)]), (2, "A1", "ARTICLE", "", [("k", "m", "n")])], f"{KEY}, cross_refs {nested.CROSS_REFS}")
    out = {r.law_id: r.chapters for r in nested.with_norm_units(laws, norms, refs).collect()}
    c2 = out[1][0]
    assert [c.id for c in out[1]] == ["c2", "c1"] and out[1][1].articles == []
    told = lambda art: [(u.level, u.ref, u.roles, u.short_label, [tuple(x) for x in u.cross_refs]) for u in art.norm_units]
    plain = [("ARTICLE", ""), ("PARAGRAPH", "1"), ("ITEM", "1|가"), ("SUBITEM", "1|가|1)"), ("ITEM", "1|~"), ("PARAGRAPH", "2")]
    assert told(c2.articles[0]) == [(*p, ["a"] if p[1] == "2" else [], "y" if p[1] == "2" else None, []) for p in plain]
    assert told(c2.sections[0].articles[0]) == [(*p, ["r"] if p[0] == "SUBITEM" else [], "l" if p[0] == "SUBITEM" else None, [("t", "u", None)] if p[1] == "1|~" else []) for p in plain]
    assert told(c2.sections[0].subdivisions[0].articles[0]) == [("ARTICLE", "", ["x"], "top", [])]
    assert told(out[2][0].articles[0]) == [("ARTICLE", "", [], None, [("k", "m", "n")])]


def test_a_missing_part_fails_by_name(spark):
    s = spark.createDataFrame([(1, "a_1", "b_1", "c_1"), (2, "a_1", None, "c_9")], "id int, law string, decree string, rule string")
    index = spark.createDataFrame([("LAW:a_1", "p1"), ("DECREE:b_1", "p2"), ("RULE:c_1", "p3")], "key string, path string")
    scopes = {"LAW": "law", "DECREE": "decree", "RULE": "rule"}
    assert [tuple(r) for r in nested.snapshot_paths(s.filter("id = 1"), index, "id", scopes).collect()] == [(1, "p1", "p2", "p3")]
    with pytest.raises(Exception, match="DECREE path, RULE path not found for 2"):
        nested.snapshot_paths(s, index, "id", scopes).collect()


def test_entries_are_written_once(spark, tmp_path):
    store = VersionedTable.create(spark, f"file://{tmp_path}/s", "k int, v string", ["k"], 2)
    nested.save_once(spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string"), store)
    nested.save_once(spark.createDataFrame([(1, "z"), (3, "n")], "k int, v string"), store)
    assert sorted(map(tuple, store.read().collect())) == [(1, "a"), (2, "c"), (3, "n")]


def test_levels_go_to_any_depth_and_cycles_fail(spark):
    edges = spark.range(25).select(F.col("id").cast("string").alias("parent"), (F.col("id") + 1).cast("string").alias("child"))
    got = {r.id: r.depth for r in graph.descendants(edges, spark.createDataFrame([("0",)], "root string")).collect()}
    assert got == {str(k): k for k in range(26)}
    with pytest.raises(Exception, match="a cycle leads back to 0"):
        graph.descendants(edges.union(spark.createDataFrame([("25", "0")], "p string, c string")), spark.createDataFrame([("0",)], "root string"))


@pytest.mark.parametrize("block", [10_000, 3])
def test_texts_are_reduced_as_by_rounds(spark, block):
    rows = [("a", k, f"w{k}") for k in range(11)] + [("b", 0, "alone and long enough"), ("c", 0, "xx"), ("c", 1, None)]
    df = spark.createDataFrame(rows, "doc string, k int, t string")
    size, half = (lambda t: F.length(t).cast("long")), (lambda t: F.concat(F.lit("("), F.regexp_replace(t, "[()\n]", ""), F.lit(")")))
    got = {r.doc: r.t for r in segment.reduce_in_one_job(df, "doc", "k", "t", size, 60, half, block=block).collect()}
    assert got == {"a": "(" + "".join(f"w{k}" for k in range(11)) + ")", "b": "alone and long enough", "c": "(xx)"}
    if block > 3:
        small = lambda t: F.substring(t, 1, 4)
        one = {r.doc: r.t for r in segment.reduce_in_one_job(df.filter("t IS NOT NULL"), "doc", "k", "t", size, 9, small).collect()}
        two = {r.doc: r.t for r in segment.reduce_until_one(df.filter("t IS NOT NULL and doc <> 'c'"), "doc", "k", "t", size, 9, small).collect()}
        assert one["a"] == two["a"]
    with pytest.raises(Exception, match="do not fit the budget: a"):
        segment.reduce_in_one_job(df.filter("doc = 'a'"), "doc", "k", "t", size, 3, half, block=block).collect()


def test_articles_are_found_once_and_large_groups_fail(spark):
    from casewright.operators import statute, vector

    a = lambda k, n=0: (k, [(str(i), "t", None) for i in range(n)])
    laws = spark.createDataFrame([(1, [("c1", [a("A1", 2)], [("s", [a("A2"), a("A1", 5)], [])]), ("c2", [a("A3", 1)], [])])], LAW)
    asks = spark.createDataFrame([(1, "A1"), (1, "A1"), (1, "A2"), (1, "A9"), (2, "A1")], "law_id int, article_id string")
    got = sorted((r.law_id, r.article_id, r.chapter_id, r.article and len(r.article.paragraphs)) for r in statute.find_articles(laws, asks).collect())
    assert got == [(1, "A1", "c1", 2), (1, "A2", "c1", 0), (1, "A9", None, None), (2, "A1", None, None)]
    rows = spark.range(12).select(F.col("id").alias("k"), F.lit("g").alias("g"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    assert vector.nearest_match(rows, rows, "g", "k", "k", "v", most=12).count() == 12
    with pytest.raises(Exception, match="too many rows to match in group g"):
        vector.nearest_match(rows, rows, "g", "k", "k", "v", most=11).collect()


def test_a_laws_parts_and_tags_come_together_once(spark, sf_dir):
    import re

    import __spark_entry__ as e

    plan = e.queries()["norm_units_in_place"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    moved = re.findall(r"Exchange hashpartitioning\((?:law_id|o_custkey)#[^)]*", plan)
    assert len(moved) == 2, moved
