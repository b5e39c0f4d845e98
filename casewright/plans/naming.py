"""Queries of known names in texts and of law names."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import names

from .registry import query, table

_NAME = "p_name || ' ' || p_partkey"


@query(f"""WITH n AS (SELECT {_NAME} AS name, replace({_NAME}, ' ', '') AS short FROM part),
q AS (SELECT o_orderkey, 'q' || o_orderkey || ': ' || a.p_name || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' ' END || a.p_partkey || ' and ' || {_NAME.replace('p_', 'b.p_')} || '?' AS t
FROM orders JOIN part a ON a.p_partkey = o_custkey % (SELECT count(*) FROM part) JOIN part b ON b.p_partkey = o_orderkey % (SELECT count(*) FROM part))
SELECT o_orderkey, min_by(name, (-len(name), name)) AS name FROM q JOIN n ON contains(t, name) OR contains(t, short) GROUP BY 1""")
def names_in_texts(spark, sf_dir):
    """Every order's question names two parts: the longest known name in it, of all parts' names at once."""
    part = table(spark, sf_dir, "part").withColumn("name", F.concat("p_name", F.lit(" "), "p_partkey"))
    n = part.count()
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % n).alias("a"), (F.col("o_orderkey") % n).alias("b"))
    first = part.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("pa"))
    second = part.select(F.col("p_partkey").alias("b"), F.col("name").alias("pb"))
    gap = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(" ")
    asked = o.join(first, "a").join(second, "b").select("o_orderkey", F.concat(F.lit("q"), "o_orderkey", F.lit(": "), "pa", gap, "a", F.lit(" and "), "pb", F.lit("?")).alias("t"))
    return names.longest_name(asked, "t", part, "name", "name").filter("name IS NOT NULL").select("o_orderkey", "name")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 AND p_partkey IS NOT NULL THEN 'law' || p_partkey END AS slug,
CASE WHEN p_partkey IS NULL THEN NULL ELSE ['law', 'decree', 'rule', 'special', NULL][(o_orderkey % 5 + 1)::INT] END AS kind FROM orders LEFT JOIN part ON p_partkey = o_custkey AND p_partkey % 2 = 0""")
def law_slugs(spark, sf_dir):
    """Names of laws, their decrees and rules; every fourth decree has an entry of its own, half of the laws are unknown."""
    base = F.concat(F.lit("제"), "p_partkey", F.lit("호 세법"))
    even = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0")
    laws = even.select(base.alias("name"), F.concat(F.lit("law"), "p_partkey").alias("slug"), F.lit("law").alias("kind")).unionByName(
        even.select(F.concat(base, F.lit(" 특별시행령")).alias("name"), F.concat(F.lit("law"), "p_partkey").alias("slug"), F.lit("special").alias("kind")))
    ends = F.element_at(F.array(*map(F.lit, ["", " 시행령", "시행규칙", " 특별시행령", " 고시"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("제"), "o_custkey", F.lit("호 세법"), ends).alias("name"))
    return names.slug_and_kind(asked, "name", laws).select("o_orderkey", "slug", "kind")
