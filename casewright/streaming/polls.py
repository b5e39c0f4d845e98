"""Streams over polled sources: changes with retraction from whole listings, and groups released when they are complete."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from casewright.sources.versioned import VersionedTable

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own with state in RocksDB, which timers and typed state ask for; the caller's settings stay."""
    own = spark.newSession()
    for k, v in (ROCKSDB | {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}).items():
        own.conf.set(k, v)
    return own


class _Differ(StatefulProcessor):
    """State of a law: number and contents of the newest poll."""

    def init(self, handle) -> None:
        self._known = handle.getValueState("known", "poll long, versions array<string>, digests array<string>")

    def handleInputRows(self, key, rows, timerValues):
        state = self._known.get() if self._known.exists() else (-1, [], [])
        newest, known = state[0], dict(zip(state[1], state[2], strict=True))
        out = []
        polls = sorted((int(p), dict(v)) for frame in rows for p, v in zip(frame["poll"], frame["listed"], strict=True))
        for poll, listed in polls:
            if poll <= newest:
                continue
            for v in sorted(known.keys() | listed.keys()):
                if known.get(v) != listed.get(v):
                    op = "added" if v not in known else "gone" if v not in listed else "changed"
                    out.append((key[0], poll, op, v, listed.get(v)))
            newest, known = poll, listed
        self._known.update((newest, list(known), list(known.values())))
        yield pd.DataFrame(out, columns=["law", "poll", "op", "version", "digest"])

    def close(self) -> None:
        pass


def changes(polls: DataFrame) -> DataFrame:
    """A stream law, poll, op (added, changed, gone), version, digest from a stream of polls.

    polls: law string, poll long (their order), listed map<string, string> (every version that the source names, and its
    digest). A poll lists a law as a whole, so what it leaves out is gone; an empty list retracts everything; a poll that
    is not newer than the last one of its law says nothing. A law's list is one row, as its source gives it.
    """
    return polls.groupBy("law").transformWithStateInPandas(_Differ(), "law string, poll long, op string, version string, digest string", "Append", "None")


def apply_changes(index: VersionedTable, build: Callable[[DataFrame], DataFrame], name: str = "changes"):
    """A sink for changes(): index rows (keys law and version) of gone versions go, those of added and changed ones are built anew.

    build: changes -> rows of the index. Each batch becomes one version that carries its number, so a repeated batch
    changes nothing. Several changes of a version in one batch count as the last one.
    """

    def sink(batch: DataFrame, number: int) -> None:
        token = f"{name}-{number}"
        if index.done(token) is not None:
            return
        last = batch.groupBy("law", "version").agg(F.max_by(F.struct("op", "digest", "poll"), "poll").alias("c")).select("law", "version", "c.*")
        last = last.persist()
        try:
            if not last.isEmpty():
                index.replace(last, build(last.filter("op <> 'gone'")), token)
        finally:
            last.unpersist()

    return sink


def known_table(spark: SparkSession, path: str, buckets: int = 64) -> VersionedTable:
    """The newest list of each law, as apply_polls() keeps it."""
    return VersionedTable.create(spark, path, "law string, poll long, listed map<string, string>", ["law"], buckets)


def listing_changes(known: DataFrame, polls: DataFrame) -> DataFrame:
    """The rows of changes() for one batch of polls, given each law's newest list; laws are compared by joins and windows, all at once.

    A law's rows meet by one shuffle, after which neither the comparison of its polls nor that of its versions moves them.
    """
    rows = known.select("law", "poll", "listed", F.lit(False).alias("new")).unionByName(polls.select("law", "poll", "listed", F.lit(True).alias("new"))).repartition("law")
    law = Window.partitionBy("law")
    in_order = law.orderBy("poll", "new", F.array_sort(F.map_entries("listed")))
    head = F.max(F.when(~F.col("new"), F.col("poll"))).over(law)
    rows = rows.withColumn("head", head).filter(~F.col("new") | F.col("head").isNull() | (F.col("poll") > F.col("head")))
    # of two lists with one number the second says nothing
    rows = rows.withColumn("again", F.col("poll") == F.lag("poll").over(in_order)).filter("again IS NULL OR NOT again")
    rows = rows.withColumn("before", F.lag("listed").over(in_order)).filter("new")
    side = lambda c, there: F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("version"), F.lit(there).alias("there"), e["value"].alias("digest")))
    none = F.array().cast("array<struct<version:string,there:boolean,digest:string>>")
    both = rows.select("law", "poll", F.inline(F.concat(F.coalesce(side("before", False), none), F.coalesce(side("listed", True), none))))
    pick = lambda there, value: F.max(F.when(F.col("there") == there, value))
    met = both.groupBy("law", "poll", "version").agg(pick(False, F.lit(True)).alias("had"), pick(True, F.lit(True)).alias("has"), pick(False, F.col("digest")).alias("was"), pick(True, F.col("digest")).alias("digest"))
    op = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "gone").otherwise("changed")
    return met.filter(~F.col("was").eqNullSafe(F.col("digest"))).select("law", "poll", op.alias("op"), "version", "digest")


def apply_polls(index: VersionedTable, known: VersionedTable, build: Callable[[DataFrame], DataFrame], name: str = "polls"):
    """A sink for polls: apply_changes(changes(polls)) without a call of Python and of the state store for each law.

    known: a known_table(). It is committed after the index, each with the batch's number, so a batch that broke off
    between the two is compared with the same lists again, finds the index done and only notes the lists.
    """
    change = apply_changes(index, build, name)

    def sink(batch: DataFrame, number: int) -> None:
        token = f"{name}-{number}"
        if known.done(token) is not None:
            return
        before = known.near(batch)
        change(listing_changes(before, batch), number)
        # the newest list of each law; what is known comes first where a poll is not newer
        every = before.withColumn("new", F.lit(False)).unionByName(batch.select("law", "poll", "listed", F.lit(True).alias("new")))
        first = F.row_number().over(Window.partitionBy("law").orderBy(F.col("poll").desc(), "new", F.array_sort(F.map_entries("listed"))))
        known.merge(every.withColumn("first", first).filter("first = 1 AND new").select("law", "poll", "listed"), token=token)

    return sink


class _Gate(StatefulProcessor):
    """State of a group: items seen, how many there are, whether it was released; and each item until then, to count it once.

    Each use of the state is a call to the JVM, so a batch's items are told apart first, those of a group that it
    completes are not kept, and a released group is left alone.
    """

    def __init__(self, wait_ms: int):
        self._wait = wait_ms

    def init(self, handle) -> None:
        self._handle = handle
        self._group = handle.getValueState("group", "seen long, expected long, status string")
        self._items = handle.getMapState("items", "item string", "at long")

    def handleInputRows(self, key, rows, timerValues):
        first = not self._group.exists()
        seen, expected, status = (0, None, None) if first else self._group.get()
        if status is not None:
            return
        since, items = None, {}
        for r in rows:
            since = r.ms if since is None else min(since, r.ms)
            if r.item is not None:
                items[r.item] = None
            if r.expected is not None:
                expected = r.expected
            if r.done is True:
                expected = -1
        new = self._new(items, seen)
        seen += len(new)
        if expected is not None and (expected < 0 or seen >= expected):
            status = "complete"
            self._items.clear()
            yield Row(group=key[0], n=seen, status=status)
        else:
            for item in new:
                self._items.updateValue((item,), (0,))
            if first:
                self._handle.registerTimer(since + self._wait)
        self._group.update((seen, expected, status))

    def _new(self, items, seen: int) -> list[str]:
        """The items that are not in the state: asked one by one only where most of what is there would be read in vain."""
        if not seen or not items:
            return list(items)
        if seen > 8 * len(items):
            return [i for i in items if not self._items.containsKey((i,))]
        there = {k[0] for k in self._items.keys()}
        return [i for i in items if i not in there]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        seen, expected, status = self._group.get()
        if status is None:
            self._items.clear()
            self._group.update((seen, expected, "timed out"))
            yield Row(group=key[0], n=seen, status="timed out")

    def close(self) -> None:
        pass


def released(rows: DataFrame, wait: int) -> DataFrame:
    """A stream group, n, status of the groups that are complete, or that were not ``wait`` seconds of event time after the first rows.

    rows: a stream, watermarked by its timestamp ``at``, with group string, item string (null for a mere mark), expected long (how many different
    items there will be; null if a row does not say) and done boolean (a mark that nothing more will come). A group is told
    of once; what comes after that is not counted. Time runs with the watermark.
    """
    # rows, not a frame for each group: groups are small and many
    return rows.withColumn("ms", F.unix_millis("at")).groupBy("group").transformWithState(_Gate(wait * 1000), "group string, n long, status string", "Append", "EventTime")
