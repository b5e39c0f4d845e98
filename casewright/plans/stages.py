"""Queries of the readers and of tables of stages. A document stands for a case, a label for one of its stages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.sources import io
from casewright.sources.shared import shared_dir

from .registry import query, table


@query("""SELECT doc_id::VARCHAR AS id, lang, n_chars FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 5 <> 0
UNION ALL SELECT substring(sha256('{"lang":"' || lang || '","n_chars":' || n_chars || ',"no":' || doc_id || '}'), 1, 16), lang, n_chars FROM documents WHERE doc_id % 4 = 0 AND doc_id % 5 <> 0""")
def json_lines_scan(spark, sf_dir):
    # of five lines one is cut short, and some have no id
    d = table(spark, sf_dir, "documents")
    whole = F.to_json(F.struct(F.when(F.col("doc_id") % 4 != 0, F.col("doc_id").cast("string")).alias("id"), "lang", "n_chars", F.when(F.col("doc_id") % 4 == 0, F.col("doc_id")).alias("no")))
    lines = d.select(F.when(F.col("doc_id") % 5 == 0, F.substring(whole, 1, 9)).otherwise(F.concat(whole, F.lit("\n  "))).alias("value"))
    home = f"{shared_dir(spark)}/json-lines-{uuid.uuid4().hex}"
    lines.write.text(home)
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_chars", d.schema["n_chars"].dataType)])
    return io.json_lines(spark, home, schema, "id")[0]


@query("""SELECT 'p' || page_id AS path, page_id FROM pages""")
def unique_paths(spark, sf_dir):
    return io.unique_index(table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("path"), "page_id"), "path")


@query("""SELECT conv_id AS "group", bool_or(role = 'user') AS asks, bool_or(role = 'assistant' AND turn >= 3) AS answers, bool_or(role = 'system') AS setup FROM conversations GROUP BY 1""")
def artifact_flags(spark, sf_dir):
    files = table(spark, sf_dir, "conversations").select("conv_id", F.concat_ws("/", "conv_id", "role", F.lpad("turn", 3, "0")).alias("path"))
    return io.artifacts(files, F.col("conv_id"), {"asks": "/user/", "answers": "/assistant/(?!00[012])", "setup": "/system/"})


@query("""SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant')""")
def section_listing(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("block_id", F.concat_ws("_", F.when(F.col("role") == "system", "X").otherwise("B"), "conv_id", F.lpad("turn", 6, "0")))
    return io.sections(rows, "block_id", "B_").select("conv_id", "turn", "role")


@query("""SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 3 = 0 THEN 'lang' END, CASE WHEN doc_id % 4 = 0 THEN 'source' END) AS lacks FROM documents""")
def required_fields(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("source"))
    good, bad = io.required(d, ["doc_id", "lang", "source"])
    return good.select("doc_id", F.lit("").alias("lacks")).unionByName(bad.select("doc_id", "lacks"))


@query("""SELECT i AS doc_id FROM range(0, (SELECT max(doc_id) + 1 FROM documents)) r(i) WHERE i NOT IN (SELECT doc_id FROM labels)""")
def id_gaps(spark, sf_dir):
    last = table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0]
    return io.missing_ids(spark, 0, -1 if last is None else last, table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT doc_id, lang, source FROM documents WHERE doc_id = 77""")
def point_lookup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return io.point_lookup(d, "77", "source", "doc_id")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 123""")
def suffix_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit("서울고법_"), "o_orderkey").alias("folder"))
    return io.one_by_suffix(o, "folder", "_123").drop("folder")


@query("""SELECT o_orderkey::VARCHAR AS version_key, (o_orderkey % 1000)::VARCHAR AS pno_norm, o_orderdate::DATE AS pdate, o_orderdate::DATE + 30 AS eff_date FROM orders""")
def version_index_rows(spark, sf_dir):
    day = lambda n: F.date_format(F.date_add(F.col("o_orderdate").cast("date"), n), "yyyyMMdd")
    entry = F.struct(F.lpad((F.col("o_orderkey") % 1000).cast("string"), 5, "0").alias("pno"), day(0).alias("pdate"), day(30).alias("eff_date"), F.col("o_orderkey").cast("string").alias("version_key"))
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("k"), entry.alias("v"))
    maps = o.groupBy("o_custkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("index"))
    return io.version_index(maps, "index").select("version_key", "pno_norm", "pdate", "eff_date")


@query("""SELECT d.doc_id AS case_id, sha256(d.text) AS digest FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND d.n_chars NOT IN (SELECT b.n_chars FROM documents b JOIN labels USING (doc_id) WHERE quality = 0)""")
def skip_done(spark, sf_dir):
    # done by the case's own id, or by a second key that another case shares
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    own = lab.filter("toxic = 1").select(F.col("doc_id").alias("case_id"), F.lit(None).cast(d.schema["n_chars"].dataType).alias("n_chars"))
    other = d.join(lab.filter("quality = 0"), "doc_id").select(F.lit(None).cast("long").alias("case_id"), "n_chars")
    todo = io.not_done(d.select(F.col("doc_id").alias("case_id"), "n_chars", "text"), own.unionByName(other), "case_id", "n_chars")
    return todo.select("case_id", F.sha2("text", 256).alias("digest"))


def _stages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("case_id"), F.col("role").alias("stage"), F.timestamp_seconds("turn").alias("updated_at"), F.col("text").alias("body"))


_LAST = "(SELECT conv_id, role, max_by(text, turn) AS body FROM conversations GROUP BY ALL)"


@query(f"""SELECT u.conv_id AS case_id, sha256(u.body) AS asked, sha256(a.body) AS answered, sha256(s.body) AS setup FROM {_LAST} u JOIN {_LAST} a ON a.conv_id = u.conv_id AND a.role = 'assistant' LEFT JOIN {_LAST} s ON s.conv_id = u.conv_id AND s.role = 'system' WHERE u.role = 'user'""")
def stages_wide(spark, sf_dir):
    w = io.cases_with(_stages(spark, sf_dir), ["user", "assistant"], ["system"])
    return w.select("case_id", F.sha2("user", 256).alias("asked"), F.sha2("assistant", 256).alias("answered"), F.sha2("system", 256).alias("setup"))


@query(f"""SELECT conv_id AS case_id, sha256(body) AS digest FROM {_LAST} WHERE role = 'assistant'""")
def stage_rows(spark, sf_dir):
    return io.stage_rows(_stages(spark, sf_dir), "assistant").select("case_id", F.sha2("body", 256).alias("digest"))


@query(f"""SELECT u.conv_id AS case_id, sha256('# ' || u.conv_id || chr(10) || CASE WHEN trim(u.body) <> '' THEN chr(10) || '## Asked' || chr(10) || chr(10) || u.body || chr(10) ELSE '' END
|| CASE WHEN trim(coalesce(a.body, '')) <> '' THEN chr(10) || '## Answered' || chr(10) || chr(10) || a.body || chr(10) ELSE '' END) AS digest FROM {_LAST} u LEFT JOIN {_LAST} a ON a.conv_id = u.conv_id AND a.role = 'assistant' WHERE u.role = 'user'""")
def markdown_reports(spark, sf_dir):
    st = _stages(spark, sf_dir)
    one = {s: io.stage_rows(st, s).withColumnRenamed("body", s) for s in ("user", "assistant")}
    whole = io.full_report(one).select("case_id", "report.*").select("case_id", F.col("case_id").cast("string").alias("title"), F.col("user.user").alias("asked"), F.col("assistant.assistant").alias("answered"))
    return io.report(whole, "case_id", "title", {"Asked": "asked", "Answered": "answered"}).select("case_id", F.sha2("markdown", 256).alias("digest"))


@query("SELECT c_custkey, c_name FROM customer")
def versioned_load(spark, sf_dir):
    # loaded once, skipped while the stamp is current, loaded anew for another one
    home = f"{shared_dir(spark)}/versioned-{uuid.uuid4().hex}"
    n = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    for version, part in (("1", n.limit(3)), ("2", n), ("2", n.limit(3))):
        io.load_if_newer(spark, lambda part=part: part, home, version)
    return spark.read.parquet(home)
