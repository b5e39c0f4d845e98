"""Golden windows, ties, open ends, and properties of the temporal operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from casewright.operators import temporal as t

# Known windows of consistent law, decree and rule versions.
GOLDEN = """
20201222_17651 20210217_31448 20210316_00840 20210316 20211230
20201222_17651 20211228_32274 20210316_00840 20211230 20220101
20211221_18588 20211228_32274 20210316_00840 20220101 20220215
20211221_18588 20220215_32423 20210316_00840 20220215 20220318
20211221_18588 20220215_32423 20220318_00901 20220318 20221227
20211221_18588 20221227_33140 20220318_00901 20221227 20230101
20221231_19191 20221227_33140 20220318_00901 20230101 20230228
20221231_19191 20230228_33272 20220318_00901 20230228 20230320
20221231_19191 20230228_33272 20230320_00983 20230320 20240101
20231231_19928 20231229_34064 20230320_00983 20240101 20240229
20231231_19928 20240229_34264 20230320_00983 20240229 20240322
"""
STARTS = {"20201222_17651": "20210101", "20211221_18588": "20220101", "20221231_19191": "20230101", "20231231_19928": "20240101", "20210217_31448": "20210217", "20211228_32274": "20211230", "20220215_32423": "20220215",
          "20221227_33140": "20221227", "20230228_33272": "20230228", "20231229_34064": "20240101", "20240229_34264": "20240229", "20210316_00840": "20210316", "20220318_00901": "20220318", "20230320_00983": "20230320", "20240322_01053": "20240322"}
LANES = {"law": "LAW", "decree": "DECREE", "rule": "RULE"}


def _versions(spark):
    rows = [line.split() for line in GOLDEN.strip().splitlines()]
    lanes = {r[i]: lane for r in rows for i, lane in enumerate(LANES.values())} | {"20240322_01053": "RULE"}
    return spark.createDataFrame([("F", lane, k, STARTS[k]) for k, lane in lanes.items()], "family string, lane string, no string, d string").withColumn("effective_at", t.parse_date(F.col("d"))).drop("d")


def _golden():
    return [tuple(line.split()) for line in GOLDEN.strip().splitlines()]


def _closed(df):
    rows = df.filter("valid_to is not null").orderBy("valid_from").collect()
    return [(r.law_no, r.decree_no, r.rule_no, r.valid_from.strftime("%Y%m%d"), r.valid_to.strftime("%Y%m%d")) for r in rows]


def test_golden_windows_by_sweep_and_by_join(spark):
    v = _versions(spark)
    assert _closed(t.change_points(v, "family", "lane", LANES)) == _golden()
    w = t.version_windows(v, ["family", "lane"])
    assert _closed(t.overlap_join({n: w.filter(F.col("lane") == k) for n, k in LANES.items()}, "family")) == _golden()


def test_as_of_example(spark):
    found = t.change_points(_versions(spark), "family", "lane", LANES).filter(t.covers(t.parse_date(F.lit("20211219")))).collect()
    assert [(r.valid_from, r.valid_to) for r in found] == [(dt.date(2021, 3, 16), dt.date(2021, 12, 30))]


def test_ties_keep_the_largest_number_and_leave_no_empty_window(spark):
    v = spark.createDataFrame([("a", "L", 1, dt.date(2020, 1, 1)), ("a", "L", 2, dt.date(2020, 1, 1)), ("a", "L", 3, dt.date(2021, 1, 1))], "family string, lane string, no int, effective_at date")
    rows = t.version_windows(v, ["family", "lane"]).orderBy("valid_from").collect()
    assert [(r.no, r.valid_to) for r in rows] == [(2, dt.date(2021, 1, 1)), (3, None)]


def test_windows_are_gap_free_and_join_equals_sweep(spark):
    r = random.Random(3)
    rows = [(f, lane, n, dt.date(2020, 1, 1) + dt.timedelta(days=r.randrange(60))) for f in range(6) for n, lane in enumerate(r.choices(list(LANES.values()), k=25))]
    v = spark.createDataFrame(rows, "family int, lane string, no int, effective_at date")
    w = t.version_windows(v, ["family", "lane"])
    for _, group in w.toPandas().groupby(["family", "lane"]):
        g = group.sort_values("valid_from")
        assert list(g["valid_to"][:-1]) == list(g["valid_from"][1:]) and g["valid_to"].iloc[-1] is None
    joined = t.overlap_join({n: w.filter(F.col("lane") == k) for n, k in LANES.items()}, "family")
    swept = t.change_points(v, "family", "lane", LANES)
    assert sorted(map(str, joined.collect())) == sorted(map(str, swept.select(joined.columns).collect()))


def test_plans_have_no_nested_loop(spark):
    w = t.version_windows(_versions(spark), ["family", "lane"])
    plan = t.overlap_join({n: w.filter(F.col("lane") == k) for n, k in LANES.items()}, "family")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_date_inputs(spark):
    rows = spark.createDataFrame([("2020-01-31",), ("2020.1",), ("202002",), ("20201399",), (None,), ("",)], "s string").select(t.parse_date(F.col("s")).alias("d")).collect()
    assert [r.d for r in rows] == [dt.date(2020, 1, 31), None, dt.date(2020, 2, 1), None, None, None]


def test_fallback_is_the_oldest(spark):
    v = spark.createDataFrame([("a", 1, dt.date(2020, 1, 1)), ("a", 2, dt.date(2021, 1, 1))], "family string, no int, effective_at date")
    asks = spark.createDataFrame([(1, "a", dt.date(2019, 1, 1)), (2, "a", dt.date(2021, 1, 1)), (3, "b", dt.date(2021, 1, 1))], "ask int, family string, day date")
    got = {r.ask: (r.version_no, r.fallback) for r in t.asof_or_oldest(asks, v, "family", "day").collect()}
    assert got == {1: (1, True), 2: (2, False), 3: (None, False)}


def test_deadline(spark):
    c = spark.createDataFrame([(dt.date(2024, 1, 1),), (None,)], "at date")
    rows = t.deadlines(c, "at", "2024-04-01").collect()
    assert (rows[0].deadline, rows[0].overdue, rows[0].elapsed) == (dt.date(2024, 3, 31), True, 91) and rows[1].deadline is None


def test_a_window_that_is_not_the_golden_one_fails_by_name(spark):
    kind = "law string, no int, valid_from date, valid_to date"
    day = dt.date(2020, 1, 1)
    windows = spark.createDataFrame([("a", 1, day, dt.date(2021, 1, 1)), ("a", 2, dt.date(2021, 1, 1), None), ("b", 1, day, None)], kind)
    good = spark.createDataFrame([("a", 1, day, dt.date(2021, 1, 1)), ("a", 2, dt.date(2021, 1, 1), None)], kind)
    assert t.checked_windows(windows, good, ["law", "no"]).count() == 3
    for bad, what in (([("a", 2, day, None)], "a, 2 differs"), ([("c", 9, day, None)], "c, 9 is missing"), ([("b", 1, day, day)], "b, 1 differs")):
        with pytest.raises(Exception, match=f"window of {what}"):
            t.checked_windows(windows, spark.createDataFrame(bad, kind), ["law", "no"]).collect()
