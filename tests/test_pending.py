"""Paged collection, memoised models and known names."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from casewright.operators import memo, names
from casewright.sources import paged
from casewright.sources.versioned import VersionedTable

CASES = "id string, keyword string, page int, body string"


def test_an_interrupted_collection_goes_on_and_has_each_id_once(spark, tmp_path):
    pages = {("a", 1): [("1", "x")], ("a", 2): [("2", "x"), ("3", "x")], ("a", 5): [("4", "x")], ("a", 9): [("never", "x")], ("b", 1): [("3", "y"), ("5", "y")], ("c", 1): [("6", "z")], ("c", 3): [("7", "z")]}

    def fetch(keyword, page):
        if keyword == "c" and page == 2:
            raise OSError("no answer")
        return pages.get((keyword, page), [])

    home = f"file://{tmp_path}"
    cases = VersionedTable.create(spark, f"{home}/cases", CASES, ["id"], 4)
    source = paged.paged_source("test_pages", fetch)
    run = lambda **o: paged.collect(spark, source, ["a", "b", "c"], cases, f"{home}/log", **o).collect()
    got = run(pages=2)
    assert sorted((r.keyword, r.page, r.status) for r in got if r.status != "item") == [("b", 2, "empty"), ("c", 2, "error")]
    assert {r.id for r in cases.read().collect()} == {"1", "2", "3", "5", "6"}
    again = run()
    assert sorted((r.keyword, r.page) for r in again if r.keyword == "a") == [("a", 3), ("a", 4), ("a", 5), ("a", 6), ("a", 7), ("a", 8)]
    assert [r.page for r in again if r.keyword == "b"] == [2, 3, 4]
    found = {r.id: (r.keyword, r.body) for r in cases.read().collect()}
    assert found == {"1": ("a", "x"), "2": ("a", "x"), "3": ("a", "x"), "4": ("a", "x"), "5": ("b", "y"), "6": ("c", "z")}
    assert all(r.status != "item" for r in run())


def test_equal_units_are_asked_once_and_a_failed_run_goes_on(spark, tmp_path):
    table = memo.memo_table(spark, f"file://{tmp_path}/memo", 4)
    df = spark.createDataFrame([(k, f"t{k % 5}" if k else None) for k in range(20)], "k int, t string")
    calls = spark.sparkContext.accumulator(0)

    def flaky(text):
        calls.add(1)
        if text == "t3":
            raise ValueError("not this one")
        return (text or "nothing") + "!"

    got = {r.k: r.answer for r in memo.memoised(df, "t", "m", flaky, table, "run1").collect()}
    assert calls.value == 6 and got[1] == got[6] == "t1!" and got[3] is None and got[0] == "nothing!"
    memo.memoised(df, "t", "m", flaky, table, "run2").count()
    memo.memoised(df, "t", "m", flaky, table, "run3").count()
    memo.memoised(df, "t", "m", flaky, table, "run4").count()
    assert calls.value == 8
    ledger = {r.status: (r.calls, r.answer) for r in table.read().filter("status = 'failed'").collect()}
    assert ledger == {"failed": (3, "not this one")}
    # what another run has claimed is left to it, until it is taken over
    digest = df.filter("k = 1").select(F.sha2(F.concat(F.lit("n\u001f"), "t"), 256).alias("d")).first().d
    table.merge(spark.createDataFrame([(digest, "claimed", "dead", 0, None)], memo.SCHEMA))
    one = df.filter("k = 1")
    assert memo.memoised(one, "t", "n", flaky, table, "run5").first().answer is None
    assert memo.memoised(one, "t", "n", flaky, table, "run5", takeover=True).first().answer == "t1!"


def test_texts_move_once_in_a_run_and_not_to_the_answers(spark, sf_dir, capsys, monkeypatch):
    def moved(df):
        """Exchanges that a text, or the first text of a group, goes through."""
        capsys.readouterr()
        df.explain("formatted")
        return sum("text#" in x or "first#" in x for x in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", capsys.readouterr().out))

    found, keep = [], memo.written
    monkeypatch.setattr(memo, "written", lambda df, name: found.append(moved(df)) or keep(df, name))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        told = e.queries()["memoised_tags"](spark, sf_dir)
        assert sum(found) == 2
        assert moved(told) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("block", [100_000, 700])
def test_longest_names_among_thousands(spark, block):
    rng = random.Random(1)
    said = ["".join(rng.choices("가나다라 ", k=rng.randint(1, 9))) for _ in range(5000)]
    texts = ["".join(rng.choices("가나다라 x", k=rng.randint(0, 60))) for _ in range(400)] + [None, "", "zzz"]
    known = {n for n in said if n}
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    laws = spark.createDataFrame([(n,) for n in [*said, "", None]], "n string")
    got = {r.k: r.hit for r in names.longest_name(df, "t", laws, "n", "hit", block).collect()}
    for k, t in enumerate(texts):
        # a name without its blanks counts for the name itself; names that are blank only match as they are
        fits = [n for n in known if t and (n in t or (n.replace(" ", "") and n.replace(" ", "") in t))]
        assert got[k] == min(fits, key=lambda n: (-len(n), n.encode()), default=None), (t, got[k])


def test_more_names_than_an_automaton_holds_are_not_gathered(spark, monkeypatch):
    monkeypatch.setattr(names, "_finder", lambda held: pytest.fail("names gathered on the driver"))
    known = spark.range(3000).select(F.concat(F.lit("law "), "id").alias("n"))
    df = spark.createDataFrame([(1, "see law2999."), (2, "law 17, law 4"), (3, "law x"), (4, "law 17, law 4"), (5, None), (6, "😀 law 5😀")], "k int, t string")
    hits = names.longest_name(df, "t", known, "n", "hit", 1000)
    assert {r.k: r.hit for r in hits.collect()} == {1: "law 2999", 2: "law 17", 3: None, 4: "law 17", 5: None, 6: "law 5"}
    # one search of the texts however many names there are
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def test_slugs_by_name_or_ending(spark):
    laws = spark.createDataFrame([("소득세법", "income", "law"), ("특별시행령", "odd", "law")], "name string, slug string, kind string")
    asked = ["소득세법", "소득세법 시행령", "소득세법시행규칙", "특별시행령", "민법 시행령", "시행령", None]
    df = spark.createDataFrame([(k, a) for k, a in enumerate(asked)], "k int, name string")
    got = {r.k: (r.slug, r.kind) for r in names.slug_and_kind(df, "name", laws).collect()}
    assert got == {0: ("income", "law"), 1: ("income", "decree"), 2: ("income", "rule"), 3: ("odd", "law"), 4: (None, None), 5: (None, None), 6: (None, None)}
