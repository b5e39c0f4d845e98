"""A Parquet table in versions: keyed merges rewrite only the buckets they touch, and a version appears as a whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written


class Conflict(RuntimeError):
    """Another writer has changed the same buckets since this change was prepared."""


@dataclass
class Change:
    """Written, but not yet visible: the version it was made from, the buckets it replaces and where their rows now lie."""

    base: int
    operation: str
    touched: list[int]
    folders: dict[int, str] = field(default_factory=dict)
    token: str | None = None


class VersionedTable:
    """Rows under ``path`` in buckets by the hash of ``keys``; ``versions`` holds one manifest a version, which names each bucket's folder.

    Files are never changed. A change reads and rewrites only the buckets that hold its keys, then commits by a rename of
    its manifest to the next number, which fails where another writer was first; if that one touched other buckets, the
    change moves on top of it, else it is prepared again or given up. Readers see one version throughout. Objects hold no
    state but the path, so a new session goes on where the last one stopped; a writer that dies leaves files that no
    manifest names. A change with the ``token`` of an earlier one is skipped, so a stream may repeat a batch.

    The number of buckets is set at creation: choose it so that a bucket's rows make a few files (about 1 GB) at the size
    the table will have. Null keys are a key like others.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str], buckets: int = 64) -> VersionedTable:
        """An empty table, version 0; an error if there is one."""
        table = cls(spark, path)
        kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        table._publish(0, {"schema": kind.json(), "keys": keys, "buckets": buckets, "folders": {}, "touched": [], "operation": "create", "token": None})
        return table

    # ---- versions

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._at("versions").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        """Numbers of the versions that can be read."""
        fs, home = self._files(), self._at("versions")
        names = [s.getPath().getName() for s in fs.listStatus(home)] if fs.exists(home) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        stream = self._files().open(self._at(f"versions/{self.versions()[-1] if version is None else version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> None:
        """The manifest under its number, by a rename that does not overwrite."""
        draft, final = self._at(f"drafts/{uuid.uuid4().hex}.json"), self._at(f"versions/{version:012d}.json")
        fs = self._files()
        fs.mkdirs(final.getParent())
        out = fs.create(draft, False)
        try:
            out.write(json.dumps(manifest).encode())
        finally:
            out.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = getattr(rename, "NONE")
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(draft, final, options)
        except Exception as e:
            fs.delete(draft, False)
            if "AlreadyExists" in str(e):
                raise Conflict(f"version {version} of {self.path} exists") from e
            raise

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default of the newest."""
        return self._rows(self.manifest(version))

    def near(self, keys: DataFrame) -> DataFrame:
        """The rows of the buckets that hold the keys, and so all rows of the keys."""
        m = self.manifest()
        return self._rows(m, self._touched(m, keys))

    def _rows(self, m: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(m["schema"]))
        folders = [f"{self.path}/{f}" for b, f in m["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # ---- changes

    def _bucket(self, m: dict) -> Column:
        return F.pmod(F.xxhash64(*m["keys"]), F.lit(m["buckets"])).cast("int")

    def _write(self, base: int, m: dict, operation: str, touched: list[int], rows: DataFrame, token: str | None) -> Change:
        names = T.StructType.fromJson(json.loads(m["schema"])).fieldNames()
        folder = f"data/{uuid.uuid4().hex}"
        # rows of a bucket come together, and a bucket beyond a partition's size is split
        rows.select(*names, self._bucket(m).alias("_bucket")).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        made = {int(s.getPath().getName().split("=")[1]): f"{folder}/{s.getPath().getName()}" for s in self._files().listStatus(self._at(folder)) if s.isDirectory()}
        return Change(base, operation, touched, made, token)

    def _touched(self, m: dict, keys: DataFrame) -> list[int]:
        """At most as many numbers as the table has buckets."""
        return sorted(r[0] for r in keys.select(self._bucket(m)).distinct().collect())

    def _checked(self, source: DataFrame, keys: list[str]) -> DataFrame:
        """The source; the plan fails where it has a key twice."""
        twice = F.count("*").over(Window.partitionBy(*keys)) > 1
        return source.withColumn("_twice", twice).filter(F.when(F.col("_twice"), F.raise_error(F.lit("a merge's source has a key twice")).cast("boolean")).otherwise(True)).drop("_twice")

    def prepare_merge(self, source: DataFrame, keep: tuple[str, ...] = (), token: str | None = None) -> Change:
        """Rows of the source in place of those of the same key, others added; ``keep`` columns stay as the table has them."""
        base = self.versions()[-1]
        m = self.manifest(base)
        keys = m["keys"]
        s = written(self._checked(source, keys), "merge-source")
        touched = self._touched(m, s)
        old = self._rows(m, touched)
        joined = old.withColumn("_old", F.lit(True)).alias("t").join(s.withColumn("_new", F.lit(True)).alias("s"), reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]), "full")
        pick = lambda c: F.when(F.col("_new").isNull() | (F.col("_old") if c in keep else F.lit(False)), F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
        return self._write(base, m, "merge", touched, joined.select(*map(pick, old.columns)), token)

    def prepare_replace(self, gone: DataFrame, rows: DataFrame | None = None, token: str | None = None) -> Change:
        """All rows of the keys in ``gone`` go; ``rows``, whose keys are among these, come instead."""
        base = self.versions()[-1]
        m = self.manifest(base)
        lost = written(gone.select(*m["keys"]).distinct(), "replace-keys")
        touched = self._touched(m, lost)
        old = self._rows(m, touched)
        left = old.join(lost.select(*[F.col(k).alias(f"_{k}") for k in m["keys"]]), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in m["keys"]]), "left_anti")
        return self._write(base, m, "replace", touched, left if rows is None else left.unionByName(rows.select(*old.columns)), token)

    def commit(self, change: Change) -> int:
        """The version that the change became. Conflict where a later version than its base touched one of its buckets."""
        base = change.base
        while True:
            newest = self.versions()[-1]
            for v in range(base + 1, newest + 1):
                if set(self.manifest(v)["touched"]) & set(change.touched):
                    raise Conflict(f"version {v} of {self.path} changed the same buckets")
            m = self.manifest(newest)
            kept = {b: f for b, f in m["folders"].items() if int(b) not in change.touched}
            m |= {"folders": kept | {str(b): f for b, f in change.folders.items()}, "touched": change.touched, "operation": change.operation, "token": change.token}
            try:
                self._publish(newest + 1, m)
                return newest + 1
            except Conflict:
                base = newest

    def done(self, token: str | None) -> int | None:
        """The version with this token, if there is one."""
        return next((v for v in reversed(self.versions()) if self.manifest(v)["token"] == token), None) if token else None

    def _apply(self, prepare: Callable[[], Change], token: str | None, tries: int = 3) -> int:
        if (v := self.done(token)) is not None:
            return v
        for k in range(tries):
            try:
                return self.commit(prepare())
            except Conflict:
                if k == tries - 1:
                    raise
        raise AssertionError

    def merge(self, source: DataFrame, keep: tuple[str, ...] = (), token: str | None = None) -> int:
        """Upserts the source and returns the version; prepared again where another writer came first."""
        return self._apply(lambda: self.prepare_merge(source, keep, token), token)

    def replace(self, gone: DataFrame, rows: DataFrame | None = None, token: str | None = None) -> int:
        """Replaces all rows of some keys, or deletes them, and returns the version."""
        return self._apply(lambda: self.prepare_replace(gone, rows, token), token)

    def reindex(self, cases: DataFrame, digest: str, build: Callable[[DataFrame], DataFrame], token: str | None = None) -> int:
        """Rows of unchanged and of vanished cases stay; those of new cases and of cases with another digest are built anew.

        cases: the keys, ``digest`` and inputs, one row a case; build: cases -> rows of this table. Where nothing changed
        there is no new version.
        """
        m = self.manifest()
        on = reduce(lambda a, b: a & b, [F.col(f"c.{k}").eqNullSafe(F.col(f"i.{k}")) for k in m["keys"]])
        known = self._rows(m).select(*m["keys"], F.col(digest).alias("_known")).distinct()
        changed = written(self._checked(cases, m["keys"]).alias("c").join(known.alias("i"), on, "left").filter(~F.col(f"c.{digest}").eqNullSafe(F.col("_known"))).select("c.*"), "reindex-changed")
        return self.versions()[-1] if changed.isEmpty() else self.replace(changed, build(changed), token)

    def vacuum(self, versions: int = 1) -> int:
        """Deletes the data folders that none of the last ``versions`` versions names, and the older manifests; returns how many. Only while no writer is at work."""
        fs, every = self._files(), self.versions()
        used = {f.rsplit("/", 1)[0] for v in every[-versions:] for f in self.manifest(v)["folders"].values()}
        old = [self._at(f"versions/{v:012d}.json") for v in every[:-versions]]
        data = self._at("data")
        stale = [s.getPath() for s in fs.listStatus(data) if f"data/{s.getPath().getName()}" not in used] if fs.exists(data) else []
        for p in (*old, *stale):
            fs.delete(p, True)
        return len(stale)
