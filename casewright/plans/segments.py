"""Sequence queries. A conversation stands for a judgment, its turns for sentences; a document's lines for paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import segment as s

from .registry import query, table

_FLAGS = "f AS (SELECT conv_id, turn, role, text, (role = 'user' AND len(text) % 3 <> 0) AS st, (role = 'assistant' AND len(text) % 2 = 0) AS en FROM conversations)"


def _c(spark, sf_dir):
    n = F.length("text")
    return table(spark, sf_dir, "conversations").withColumn("st", (F.col("role") == "user") & (n % 3 != 0)).withColumn("en", (F.col("role") == "assistant") & (n % 2 == 0))


@query(f"""WITH {_FLAGS}, g AS (SELECT *, sum(st::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM f),
h AS (SELECT *, coalesce(max(en::INT) OVER (PARTITION BY conv_id, n ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed, max(n) OVER (PARTITION BY conv_id) AS most FROM g)
SELECT conv_id, turn, (CASE WHEN n = 0 AND role = 'system' AND most > 0 THEN 1 WHEN n = 0 OR closed = 1 THEN 0 ELSE n END)::INTEGER AS block FROM h""")
def block_segments(spark, sf_dir):
    b = s.blocks(_c(spark, sf_dir), "conv_id", ["turn"], F.col("st"), F.col("en"), F.col("role") == "system")
    return b.select("conv_id", "turn", "block")


@query(f"WITH {_FLAGS} SELECT conv_id, turn, (sum(st::INT) OVER (PARTITION BY conv_id ORDER BY turn))::INTEGER AS block FROM f")
def block_segments_plain(spark, sf_dir):
    return s.running_blocks(_c(spark, sf_dir), "conv_id", ["turn"], F.col("st")).select("conv_id", "turn", "block")


@query(f"WITH {_FLAGS} SELECT conv_id, turn FROM f QUALIFY turn <= coalesce(max(turn) FILTER (en) OVER (PARTITION BY conv_id), turn)")
def truncate_after_last(spark, sf_dir):
    return s.truncate_after_last(_c(spark, sf_dir), "conv_id", "turn", F.col("en")).select("conv_id", "turn")


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, string_agg(role || ': ' || substring(text, 1, 600), chr(10) ORDER BY turn) AS history FROM d WHERE r <= 6 GROUP BY 1""")
def history_window(spark, sf_dir):
    return s.last_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


_LINES = r"lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))


def _fold(size: str, budget: int) -> str:
    return f"""WITH RECURSIVE {_LINES}, z AS (SELECT doc_id, i, ({size})::BIGINT AS n FROM lines),
r(doc_id, i, chunk, used) AS (SELECT doc_id, i, 0, n FROM z WHERE i = 1 UNION ALL
  SELECT z.doc_id, z.i, CASE WHEN r.used + z.n > {budget} THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.used + z.n > {budget} THEN z.n ELSE r.used + z.n END FROM r JOIN z ON z.doc_id = r.doc_id AND z.i = r.i + 1)
SELECT doc_id, chunk, count(*) AS n_items, sum(len(line)) + count(*) - 1 AS n_chars FROM r JOIN lines USING (doc_id, i) GROUP BY 1, 2"""


@query(_fold("len(line)", 1500))
def greedy_chunks(spark, sf_dir):
    p = s.pack_rows(_lines(spark, sf_dir), "doc_id", "i", "line", F.length, 1500)
    return p.select("doc_id", "chunk", "n_items", F.length("line").cast("long").alias("n_chars"))


@query(_fold("greatest(300, len(line) // 3)", 1200))
def token_packs(spark, sf_dir):
    size = lambda x: F.greatest(F.lit(300), F.floor(F.length(x) / 3))
    p = s.pack_rows(_lines(spark, sf_dir), "doc_id", "i", "line", size, 1200)
    return p.select("doc_id", "chunk", "n_items", F.length("line").cast("long").alias("n_chars"))


@query(_fold("(len(line) * 22) // 10", 2500))
def string_packs(spark, sf_dir):
    size = lambda x: F.floor(F.length(x) * 22 / 10)
    p = s.pack_rows(_lines(spark, sf_dir), "doc_id", "i", "line", size, 2500)
    return p.select("doc_id", "chunk", "n_items", F.length("line").cast("long").alias("n_chars"))


@query("""SELECT doc_id, part::INTEGER AS part, sha256(substring(text, (part - 1) * 700 + 1, 700)) AS digest FROM (SELECT doc_id, text, unnest(range(1, ceil(len(text) / 700.0)::BIGINT + 1)) AS part FROM documents)""")
def fixed_chunks(spark, sf_dir):
    c = s.char_chunks(table(spark, sf_dir, "documents"), ["doc_id"], "text", 700)
    return c.select("doc_id", "part", F.sha2("text", 256).alias("digest"))


@query("SELECT conv_id, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3)::INTEGER AS chunk FROM conversations")
def count_chunks(spark, sf_dir):
    return s.count_chunks(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "chunk")


@query("""WITH v AS (SELECT conv_id, turn, CASE WHEN role = 'system' OR turn = 0 THEN turn END AS a, CASE WHEN role = 'user' THEN turn END AS b FROM conversations),
x AS (SELECT *, last_value(a IGNORE NULLS) OVER w AS chapter, count(a) OVER w AS k FROM v WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, chapter, last_value(b IGNORE NULLS) OVER (PARTITION BY conv_id, k ORDER BY turn) AS section FROM x""")
def state_carry(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    levels = {"chapter": F.when((F.col("role") == "system") | (F.col("turn") == 0), F.col("turn")), "section": F.when(F.col("role") == "user", F.col("turn"))}
    return s.carry(c, "conv_id", ["turn"], levels).select("conv_id", "turn", "chapter", "section")


@query("SELECT conv_id, turn, 'ISSUE_' || row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS issue_id FROM conversations")
def reindex_issues(spark, sf_dir):
    return s.reindex(table(spark, sf_dir, "conversations"), ["conv_id", "role"], ["turn"], "ISSUE_", "issue_id").select("conv_id", "turn", "issue_id")


@query(r"""WITH t AS (SELECT conv_id, turn, role, unnest(regexp_split_to_array(text, '\. ')) AS sentence, generate_subscripts(regexp_split_to_array(text, '\. '), 1) - 1 AS sid FROM conversations WHERE role <> 'system')
SELECT conv_id, turn, sid::INTEGER AS sid, coalesce(nullif(role, 'assistant'), 'court') AS speaker, len(sentence) >= 20 AS long_enough FROM t WHERE trim(sentence) <> ''""")
def sentence_flatten(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role <> 'system'")
    c = c.select("conv_id", "turn", "role", F.posexplode(F.split("text", r"\. ")).alias("sid", "sentence")).filter(F.trim("sentence") != "")
    return c.select("conv_id", "turn", "sid", F.when(F.col("role") == "assistant", "court").otherwise(F.col("role")).alias("speaker"), (F.length("sentence") >= 20).alias("long_enough"))
