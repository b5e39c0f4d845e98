"""The versioned table, and streams over polled sources."""

import uuid

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from casewright.sources.versioned import Conflict, VersionedTable
from casewright.streaming import ingest, polls


@pytest.fixture
def numbers(spark, tmp_path):
    t = VersionedTable.create(spark, f"file://{tmp_path}/t", "k long, v string", ["k"], 8)
    t.merge(spark.range(100).select(F.col("id").alias("k"), F.lit("a").alias("v")))
    return t


def one(spark, k, v):
    return spark.createDataFrame([(k, v)], "k long, v string")


def files_of(table, version):
    return table.manifest(version)["folders"]


def buckets_apart(spark, t):
    """Keys of two different buckets."""
    rows = spark.range(100).select(F.col("id").alias("k")).select("k", t._bucket(t.manifest()).alias("b")).collect()
    first = rows[0]
    return first.k, next(r.k for r in rows if r.b != first.b), next(r.k for r in rows[1:] if r.b == first.b)


def test_a_merge_rewrites_only_what_it_touches_and_survives_a_restart(spark, numbers):
    before = files_of(numbers, 1)
    again = VersionedTable(spark, numbers.path)
    assert again.merge(spark.createDataFrame([(5, "b"), (1000, "n"), (None, "none")], "k long, v string")) == 2
    after, touched = files_of(again, 2), again.manifest(2)["touched"]
    assert 1 <= len(touched) <= 3 and {b for b in after if after[b] != before.get(b)} == set(map(str, touched))
    got = {r.k: r.v for r in again.read().collect()}
    assert got == {k: "a" for k in range(100)} | {5: "b", 1000: "n", None: "none"}
    assert again.read(1).count() == 100 and again.read(0).count() == 0
    assert again.merge(one(spark, None, "x")) == 3 and {r.k: r.v for r in again.read().collect()}[None] == "x"


def test_writers_of_the_same_bucket_conflict_and_others_do_not(spark, numbers):
    a, b, c = buckets_apart(spark, numbers)
    first, second, third = (numbers.prepare_merge(one(spark, k, "z")) for k in (a, b, c))
    assert numbers.commit(first) == 2
    assert numbers.commit(second) == 3
    with pytest.raises(Conflict):
        numbers.commit(third)
    assert {r.k for r in numbers.read().filter("v = 'z'").collect()} == {a, b}
    with pytest.raises(Conflict):
        VersionedTable.create(spark, numbers.path, "k long", ["k"])


def test_a_lost_race_is_run_again(spark, numbers, monkeypatch):
    prepare, calls = numbers.prepare_merge, []

    def raced(*args):
        change = prepare(*args)
        if not calls:
            calls.append(1)
            numbers.commit(prepare(one(spark, 7, "other")))
        return change

    monkeypatch.setattr(numbers, "prepare_merge", raced)
    assert numbers.merge(one(spark, 7, "mine")) == 3
    assert numbers.read().filter("k = 7").first().v == "mine"


def test_tokens_duplicates_deletes_and_vacuum(spark, numbers):
    assert numbers.merge(one(spark, 1, "t"), token="x") == 2
    assert numbers.merge(one(spark, 1, "never"), token="x") == 2
    with pytest.raises(Exception, match="key twice"):
        numbers.merge(one(spark, 1, "p").union(one(spark, 1, "q")))
    numbers.replace(spark.range(50).select(F.col("id").alias("k")))
    assert numbers.read().count() == 50 and numbers.read(2).count() == 100
    assert numbers.vacuum() > 0 and numbers.read().count() == 50 and numbers.versions() == [3]
    numbers.replace(spark.range(100).select(F.col("id").alias("k")))
    assert numbers.read().count() == 0 and files_of(numbers, 4) == {}


def test_reindex_skips_what_did_not_change(spark, tmp_path):
    t = VersionedTable.create(spark, f"file://{tmp_path}/i", "k long, digest string, part int, run int", ["k"], 4)
    cases = spark.createDataFrame([(1, "x", 2), (2, "y", 3)], "k long, digest string, n int")

    def build(run):
        return lambda c: c.select("k", "digest", F.explode(F.sequence(F.lit(1), "n")).alias("part"), F.lit(run).alias("run"))

    assert t.reindex(cases, "digest", build(1)) == 1
    assert t.reindex(cases, "digest", build(2)) == 1
    assert t.reindex(spark.createDataFrame([(2, "z", 1), (3, "w", 1)], cases.schema), "digest", build(3)) == 2
    assert sorted(map(tuple, t.read().collect())) == [(1, "x", 1, 1), (1, "x", 2, 1), (2, "z", 1, 3), (3, "w", 1, 3)]


def test_polls_retract_and_old_polls_say_nothing(spark, tmp_path):
    own = polls.stateful_session(spark)
    home = f"file://{tmp_path}"
    schema = "law string, poll long, listed map<string, string>"
    index = VersionedTable.create(own, f"{home}/index", "law string, version string, digest string, poll long", ["law", "version"], 4)
    told = []

    def poll(*rows):
        own.createDataFrame([*rows], schema).write.mode("append").parquet(f"{home}/in")
        sink = polls.apply_changes(index, lambda c: c.drop("op"))

        def both(batch, number):
            told.extend(sorted((r.law, r.poll, r.op, r.version) for r in batch.collect()))
            sink(batch, number)
            sink(batch, number)

        ingest.run_available(polls.changes(own.readStream.schema(schema).parquet(f"{home}/in")), both, f"{home}/state")

    poll(("a", 1, {"1": "x", "2": "y"}), ("b", 1, {"1": "z"}))
    poll(("a", 2, {"2": "Y", "3": "w"}), ("a", 3, {"3": "w"}), ("b", 2, {}))
    poll(("a", 2, {"9": "late"}))
    assert told == [("a", 1, "added", "1"), ("a", 1, "added", "2"), ("b", 1, "added", "1"), ("a", 2, "added", "3"), ("a", 2, "changed", "2"), ("a", 2, "gone", "1"), ("a", 3, "gone", "2"), ("b", 2, "gone", "1")]
    assert [tuple(r) for r in index.read().collect()] == [("a", "3", "w", 2)]
    assert len(index.versions()) == 3


def test_polls_are_compared_without_python_for_each_law(spark, tmp_path):
    home = f"file://{tmp_path}"
    schema = "law string, poll long, listed map<string, string>"
    index = VersionedTable.create(spark, f"{home}/index", "law string, version string, digest string, poll long", ["law", "version"], 4)
    known = polls.known_table(spark, f"{home}/known", 4)
    told = lambda batch: sorted((r.law, r.poll, r.op, r.version) for r in polls.listing_changes(known.near(batch), batch).collect())

    def poll(*rows):
        spark.createDataFrame([*rows], schema).write.mode("append").parquet(f"{home}/in")
        plans = []

        def sink(batch, number):
            plans.append(polls.listing_changes(known.near(batch), batch)._jdf.queryExecution().toString())
            found.extend(told(batch))
            if number == 1:
                # breaks off after the index was committed, before the lists are
                polls.apply_changes(index, lambda c: c.drop("op"), "polls")(polls.listing_changes(known.near(batch), batch), number)
            apply = polls.apply_polls(index, known, lambda c: c.drop("op"))
            apply(batch, number)
            apply(batch, number)

        found = []
        ingest.run_available(spark.readStream.schema(schema).parquet(f"{home}/in"), sink, f"{home}/state")
        assert not any("Python" in p or "Pandas" in p for p in plans)
        return found

    assert poll(("a", 1, {"1": "x", "2": "y"}), ("b", 1, {"1": "z"}), ("c", 5, {"1": "x"})) == [("a", 1, "added", "1"), ("a", 1, "added", "2"), ("b", 1, "added", "1"), ("c", 5, "added", "1")]
    assert poll(("a", 2, {"2": "Y", "3": "w"}), ("a", 3, {"3": "w"}), ("b", 2, {})) == [("a", 2, "added", "3"), ("a", 2, "changed", "2"), ("a", 2, "gone", "1"), ("a", 3, "gone", "2"), ("b", 2, "gone", "1")]
    assert poll(("a", 2, {"9": "late"}), ("c", 5, {"2": "again"}), ("b", 3, {"1": "z"})) == [("b", 3, "added", "1")]
    assert sorted(tuple(r) for r in index.read().collect()) == [("a", "3", "w", 2), ("b", "1", "z", 3), ("c", "1", "x", 5)]
    assert sorted((r.law, r.poll, r.listed) for r in known.read().collect()) == [("a", 3, {"3": "w"}), ("b", 3, {"1": "z"}), ("c", 5, {"1": "x"})]


def test_groups_wait_for_items_marks_or_time(spark, tmp_path):
    own = polls.stateful_session(spark)
    home, schema = f"file://{tmp_path}", "group string, item string, expected long, done boolean, at timestamp"

    def arrive(day, *rows):
        own.createDataFrame(rows, "group string, item string, expected long, done boolean").withColumn("at", F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp")).write.mode("append").parquet(f"{home}/in")
        rows = own.readStream.schema(schema).parquet(f"{home}/in").withWatermark("at", "0 seconds")
        ingest.run_available(polls.released(rows, 2 * 86_400), ingest.into_table(f"{home}/out", "group"), f"{home}/{uuid.uuid5(uuid.NAMESPACE_OID, 'state')}")
        out = spark.read.schema("group string, n long, status string").parquet(f"{home}/out/*")
        return sorted(map(tuple, out.collect()))

    assert arrive(1, ("a", "1", 2, False), ("a", "1", None, False), ("b", "1", None, False), ("c", "1", 1, False)) == [("c", 1, "complete")]
    assert arrive(2, ("a", "2", None, None), ("b", "2", None, True), ("c", "2", None, False), ("d", "1", 5, False)) == [("a", 2, "complete"), ("b", 2, "complete"), ("c", 1, "complete")]
    assert ("d", 1, "timed out") in arrive(6, ("e", "1", 9, False))


def test_the_gate_calls_the_state_no_more_than_it_must():
    calls, values, items, timers = [], [None], {}, []

    class Value:
        exists = staticmethod(lambda: values[0] is not None)
        get = staticmethod(lambda: values[0])
        update = staticmethod(lambda v: values.__setitem__(0, v))

    class Items:
        def containsKey(self, k):
            calls.append("has")
            return k in items

        def updateValue(self, k, v):
            calls.append("put")
            items[k] = v

        def keys(self):
            calls.append("keys")
            return list(items)

        clear = staticmethod(items.clear)

    class Handle:
        getValueState = staticmethod(lambda *_: Value)
        getMapState = staticmethod(lambda *_: Items())
        registerTimer = staticmethod(timers.append)

    gate = polls._Gate(1000)
    gate.init(Handle)

    def arrive(*said, expected=None):
        calls.clear()
        rows = [Row(item=i, expected=None, done=False, ms=5) for i in said] + [Row(item=None, expected=expected, done=None, ms=7)]
        return [tuple(r) for r in gate.handleInputRows(("g",), iter(rows), None)], calls.copy()

    assert arrive("a", "b", "a", "b") == ([], ["put", "put"]) and timers == [1005]
    assert arrive("b", "c", "c") == ([], ["keys", "put"])
    assert arrive("a", "d", expected=4) == ([("g", 4, "complete")], ["keys"]) and items == {}
    assert arrive("e", expected=9) == ([], []) and list(gate.handleExpiredTimer(("g",), None, None)) == []
