"""A paged collection as a data source: a partition for each keyword, a rule when to stop, and runs that go on where the last one stopped."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from casewright.sources.versioned import VersionedTable

from .shared import written

SCHEMA = "keyword string, page int, id string, body string, status string"


class _Keyword(InputPartition):
    def __init__(self, keyword: str, first: int):
        self.keyword, self.first = keyword, first


class _Pages(DataSourceReader):
    def __init__(self, fetch, options):
        self.fetch, self.start = fetch, json.loads(options["start"])
        self.empties, self.errors, self.pages = (int(options.get(k, d)) for k, d in (("empties", 3), ("errors", 5), ("pages", 1 << 30)))

    def partitions(self):
        return [_Keyword(k, p) for k, p in self.start.items()]

    def read(self, partition):
        empties = errors = 0
        page, last = partition.first, partition.first + self.pages
        while page < last and empties < self.empties:
            try:
                items = list(self.fetch(partition.keyword, page))
            except Exception as e:
                errors += 1
                if errors == self.errors:
                    yield partition.keyword, page, None, str(e)[:500], "error"
                    return
                continue
            empties = 0 if items else empties + 1
            if not items:
                yield partition.keyword, page, None, None, "empty"
            for id_, body in items:
                yield partition.keyword, page, str(id_), body, "item"
            page += 1


def paged_source(name: str, fetch: Callable[[str, int], Iterable[tuple[str, str]]]) -> type[DataSource]:
    """A source to register: ``fetch(keyword, page)`` gives (id, body) pairs and runs on executors.

    Options: start (JSON: keyword -> first page), empties (a keyword ends after so many empty pages one after the other,
    3), errors (or after so many failures, 5; a page that fails is asked again), pages (most pages of a keyword in a run).
    A keyword's pages are read as a stream; a row with status empty or error tells of a page without items.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return _Pages(fetch, self.options)

    return Paged


def collect(spark: SparkSession, source: type[DataSource], keywords: list[str], cases: VersionedTable, log: str, **options: object) -> DataFrame:
    """One run over all keywords; the rows that it read.

    cases (key id; keyword, page, body) gets each id once, whatever keywords find it: what is there stays, and of a run's
    finds the one of the earliest keyword, then page. ``log`` notes which pages had items, after the cases are committed,
    so a run that breaks off is read again and changes nothing twice. Each keyword goes on behind its last page with items.
    """
    spark.dataSource.register(source)
    there = {}
    if _exists(spark, log):
        there = {r.keyword: r.page for r in spark.read.parquet(log).filter(F.col("keyword").isin(keywords)).groupBy("keyword").agg(F.max("page").alias("page")).collect()}
    start = {k: there.get(k, 0) + 1 for k in keywords}
    reader = spark.read.format(source.name()).option("start", json.dumps(start, ensure_ascii=False))
    for k, value in options.items():
        reader = reader.option(k, str(value))
    rows = written(reader.load(), "collected")
    rank = F.array_position(F.array(*map(F.lit, keywords)), F.col("keyword"))
    found = rows.filter("status = 'item' AND id <> ''").groupBy("id").agg(F.min_by(F.struct("keyword", "page", "body"), F.struct(rank, "page", "body")).alias("c")).select("id", "c.*")
    cases.merge(found, keep=("keyword", "page", "body"))
    rows.filter("status = 'item'").select("keyword", "page").distinct().write.mode("append").parquet(log)
    return rows


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def page_files(root: str) -> Callable[[str, int], Iterable[tuple[str, str]]]:
    """fetch over a landing area of JSON lines (id, body) under keyword=K/page=N, in any store that pyarrow reads."""

    def fetch(keyword: str, page: int):
        import pyarrow.fs as fs

        store, base = fs.FileSystem.from_uri(root)
        files = store.get_file_info(fs.FileSelector(f"{base}/keyword={keyword}/page={page}", allow_not_found=True))
        for f in sorted(f.path for f in files if f.path.endswith(".json")):
            with store.open_input_stream(f) as stream:
                for line in stream.read().decode().splitlines():
                    row = json.loads(line)
                    yield row["id"], row.get("body")

    return fetch
