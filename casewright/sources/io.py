"""Readers and writers: JSON lines and documents, version indexes, stage tables, artifacts, reports, versioned loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.operators.temporal import parse_date

from . import schemas


def json_lines(spark: SparkSession, path: str, schema: T.StructType, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines, and the malformed lines apart. A row without key gets a hash of its content, the same every time."""
    bad = "_corrupt_record"
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", T.StructType([*schema.fields, T.StructField(bad, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("r"))
    good = parsed.filter(F.col(f"r.{bad}").isNull()).select("value", "r.*").drop(bad)
    if key:
        good = good.withColumn(key, F.coalesce(F.col(key), F.substring(F.sha2("value", 256), 1, 16)))
    return good.drop("value"), parsed.filter(F.col(f"r.{bad}").isNotNull()).select("value")


def json_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row for each JSON file, with its file; unreadable files are passed over."""
    read = spark.read.schema(schema).option("multiLine", True).option("ignoreCorruptFiles", True).option("mode", "DROPMALFORMED")
    return read.json(path).withColumn("file", F.input_file_name())


def point_lookup(df: DataFrame, value: str, *columns: str) -> DataFrame:
    """At most one row with the value in one of the columns; an earlier column's match comes first."""
    rank = F.coalesce(*[F.when(F.col(c).cast("string") == value, i) for i, c in enumerate(columns)])
    return df.withColumn("_k", rank).filter("_k is not null").orderBy("_k", *columns).limit(1).drop("_k")


def one_by_suffix(df: DataFrame, column: str, suffix: str) -> DataFrame:
    """The row whose column ends so; the job fails if there are several."""
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    found = df.filter(F.col(column).endswith(suffix)).limit(2).withColumn("_n", n)
    return found.filter(F.assert_true(F.col("_n") == 1, F.lit(f"several rows end with {suffix}")).isNull()).drop("_n")


def binary_documents(spark: SparkSession, path: str, extract=None, most: int = 4000) -> DataFrame:
    """path, text of binary files; ``extract`` (bytes -> text) is a plug-in, UTF-8 by default. Files are read on executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if extract is None:
        return files.select("path", F.substring(F.decode("content", "UTF-8"), 1, most).alias("text"))

    def each(batches):
        for pdf in batches:
            yield pdf.assign(text=[(extract(b) or "")[:most] for b in pdf["content"]])[["path", "text"]]

    return files.select("path", "content").mapInPandas(each, "path string, text string")


def missing_ids(spark: SparkSession, first: int, last: int, existing: DataFrame, key: str) -> DataFrame:
    """The ids of a range that are not there yet."""
    return spark.range(first, last + 1).withColumnRenamed("id", key).join(existing.select(key), key, "left_anti")


def version_index(entries: DataFrame, column: str) -> DataFrame:
    """Rows of a JSON map number -> version entry, keyed by day and number (numbers recur across years)."""
    rows = entries.select(F.explode(F.from_json(column, T.MapType(T.StringType(), schemas.VERSION_ENTRY))).alias("_k", "v"))
    v = rows.select("v.*")
    return v.withColumn("pno_norm", F.regexp_replace("pno", "^0+(?=.)", "")).withColumn("pdate", parse_date(F.col("pdate"))).withColumn("eff_date", parse_date(F.col("eff_date"))).dropDuplicates(["pdate", "pno_norm", "version_key"])


def unique_index(df: DataFrame, key: str) -> DataFrame:
    """The rows; the job fails if a key stands twice."""
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("_n", n).filter(F.assert_true(F.col("_n") == 1, F.concat(F.lit("duplicate key "), F.col(key).cast("string"))).isNull()).drop("_n")


def required(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that have all the columns, and the others with the names of what they lack."""
    lacks = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", c) for c in columns]))
    marked = df.withColumn("_lacks", lacks)
    return marked.filter(F.size("_lacks") == 0).drop("_lacks"), marked.filter(F.size("_lacks") > 0).withColumn("lacks", F.array_join("_lacks", ",")).drop("_lacks")


def artifacts(files: DataFrame, group: Column, marks: dict[str, str]) -> DataFrame:
    """For each group of files whether one matches each pattern."""
    return files.groupBy(group.alias("group")).agg(*[F.coalesce(F.max(F.col("path").rlike(p)), F.lit(False)).alias(n) for n, p in marks.items()])


def sections(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows whose key begins so, in the order of the key."""
    return df.filter(F.col(key).startswith(prefix)).orderBy(key)


def stage_rows(stages: DataFrame, stage: str) -> DataFrame:
    """case_id, body of one stage, the newest of each case."""
    last = F.max(F.struct("updated_at", "body")).alias("m")
    return stages.filter(F.col("stage") == stage).groupBy("case_id").agg(last).select("case_id", F.col("m.body").alias("body"))


def cases_with(stages: DataFrame, needed: list[str], optional: list[str] = ()) -> DataFrame:
    """Cases with a column for each stage; all needed ones are there, optional ones may be null."""
    wide = stages.filter(F.col("stage").isin([*needed, *optional])).groupBy("case_id").agg(*[F.max(F.when(F.col("stage") == s, F.struct("updated_at", "body"))).alias(s) for s in [*needed, *optional]])
    return wide.select("case_id", *[F.col(f"{s}.body").alias(s) for s in [*needed, *optional]]).dropna(subset=list(needed))


def not_done(inputs: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Inputs that none of the keys shows as done: a key equal on its own is enough."""
    for k in keys:
        inputs = inputs.join(done.select(k).filter(F.col(k).isNotNull()).distinct(), k, "left_anti")
    return inputs


def write_stage(df: DataFrame, path: str) -> None:
    """Appends stage rows, laid out by stage so that reading one prunes the others."""
    df.select(*schemas.STAGE.fieldNames()).write.mode("append").partitionBy("stage").parquet(path)


def load_if_newer(spark: SparkSession, build, path: str, version: str) -> bool:
    """Builds and overwrites a table unless its stamp says that it has this version; the stamp is written last."""
    stamp = f"{path.rstrip('/')}__version"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(stamp)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop) and spark.read.text(stamp).filter(F.col("value") == version).limit(1).count():
        return False
    build().write.mode("overwrite").parquet(path)
    spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(stamp)
    return True


def report(df: DataFrame, key: str, title: str, sections: dict[str, str]) -> DataFrame:
    """key, markdown: a report for each row, with a heading for each section that is not empty."""
    parts = [F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) != "", F.concat(F.lit(f"\n## {h}\n\n"), F.col(c), F.lit("\n"))) for h, c in sections.items()]
    return df.select(key, F.concat_ws("", F.concat(F.lit("# "), F.col(title), F.lit("\n")), *parts).alias("markdown"))


def full_report(stages: dict[str, DataFrame], key: str = "case_id") -> DataFrame:
    """key, report: the stages' rows as one struct; a missing stage is null."""
    names = list(stages)
    out = stages[names[0]].select(key, F.struct(*[c for c in stages[names[0]].columns if c != key]).alias(names[0]))
    for n in names[1:]:
        out = out.join(stages[n].select(key, F.struct(*[c for c in stages[n].columns if c != key]).alias(n)), key, "left")
    return out.select(key, F.struct(*names).alias("report"))
