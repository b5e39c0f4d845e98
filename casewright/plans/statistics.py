"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import stats

from .registry import query, table


def _days(df):
    return df.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


_E = "(SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events)"


@query(f"""WITH f AS (SELECT 'event_type' AS facet, event_type AS value FROM events UNION ALL SELECT 'day', day FROM {_E}), g AS (SELECT facet, value, count(*) AS n FROM f GROUP BY ALL)
SELECT facet, value, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY facet), 1) AS share FROM g QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 10""")
def facet_counts(spark, sf_dir):
    return stats.facets(_days(table(spark, sf_dir, "events")), ["event_type", "day"], 10)


@query("""WITH s AS (SELECT * FROM events ORDER BY event_id LIMIT 500) SELECT 'event_type' AS facet, event_type AS value, count(*) AS n, round(count(*) * 100.0::DOUBLE / 500, 1) AS share FROM s GROUP BY ALL""")
def facet_sample(spark, sf_dir):
    return stats.facets(stats.sample_first(table(spark, sf_dir, "events"), "event_id", 500), ["event_type"])


@query("""SELECT count(*) AS n, count(*) FILTER (o_orderstatus IN ('F', 'P')) AS won, round(count(*) FILTER (o_orderstatus IN ('F', 'P')) * 100.0::DOUBLE / count(*), 1) AS win_rate FROM orders""")
def combined_win_rate(spark, sf_dir):
    return stats.combined_rate(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "P"])


@query("""SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS resolved, count(*) FILTER (o_orderstatus = 'P') AS unresolvable, count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS pending FROM orders GROUP BY 1""")
def status_rollup(spark, sf_dir):
    s = F.col("o_orderstatus")
    return stats.status_counts(table(spark, sf_dir, "orders"), ["o_orderpriority"], {"resolved": s == "F", "unresolvable": s == "P", "pending": ~s.isin("F", "P")})


@query("""SELECT user_id, count(*) AS used, greatest(10 - count(*), 0) AS left_over FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1""")
def usage_quota(spark, sf_dir):
    return stats.usage_left(table(spark, sf_dir, "events"), "user_id", "ts", "2024-01-20").withColumnRenamed("left", "left_over")


def words(spark, sf_dir):
    w = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")
    return table(spark, sf_dir, "documents").select("doc_id", w).filter("word <> ''")


_W = r"w AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS word FROM documents) WHERE word <> '')"


@query(f"WITH {_W} SELECT word, count(*) AS docs, CASE WHEN count(*) < 2 THEN 'unique' WHEN count(*) < 5 THEN 'medium' ELSE 'common' END AS bucket FROM w GROUP BY 1")
def keyword_signature(spark, sf_dir):
    return stats.keyword_signature(words(spark, sf_dir), "word", "doc_id")


@query(f"WITH {_W} SELECT word, doc_id // 1000 AS part, count(*) AS docs, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS listed FROM w GROUP BY 1, 2")
def inverted_index(spark, sf_dir):
    return stats.inverted_index(words(spark, sf_dir), "word", "doc_id", F.floor(F.col("doc_id") / 1000))


@query("""WITH g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type, n FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type DESC) = 1""")
def majority_merge(spark, sf_dir):
    return stats.majority(table(spark, sf_dir, "events"), ["user_id"], "event_type")


NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in NAMES))
def catalog_counts(spark, sf_dir):
    return stats.table_counts({n: table(spark, sf_dir, n) for n in NAMES})


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def integrity_audit(spark, sf_dir):
    return stats.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT o.o_custkey, o.o_orderstatus, string_agg(l.l_partkey::VARCHAR, '|' ORDER BY o.o_orderkey, l.l_partkey) AS parts FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2""")
def winning_patterns(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    lines = o.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return stats.collected(lines, ["o_custkey", "o_orderstatus"], ["o_orderkey", "l_partkey"], F.col("l_partkey"), "parts")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 10")
def top_cited(spark, sf_dir):
    return stats.top_values(table(spark, sf_dir, "lineitem"), "l_partkey", 10)


@query("SELECT count(*) FILTER (o_orderstatus = 'F') || ' of ' || count(*) || ' cases won (' || round(count(*) FILTER (o_orderstatus = 'F') * 100.0::DOUBLE / count(*), 1) || '%)' AS summary FROM orders")
def win_rate_summary(spark, sf_dir):
    return stats.rate_sentence(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F")


@query("""WITH c AS (SELECT *, year(o_orderdate)::INTEGER AS year, (row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) - 1) // 500 AS part FROM orders WHERE o_orderkey % 9 > 0),
t AS (SELECT year, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS wins FROM c GROUP BY 1)
SELECT year, part::INTEGER AS part, total, wins, round(wins * 100.0::DOUBLE / total, 1) AS win_rate, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate::DATE, o_orderkey) AS cases FROM c JOIN t USING (year) WHERE year BETWEEN 1993 AND 1999 GROUP BY ALL""")
def yearly_cases(spark, sf_dir):
    # dates are texts, and some are none
    date = F.when(F.col("o_orderkey") % 9 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("19x0")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", date.alias("date"))
    return stats.yearly_cases(o, "date", "o_orderkey", F.col("o_orderstatus") == "F", 1993, 1999, 500).withColumn("cases", F.array_join(F.transform("cases", lambda c: c.cast("string")), ","))


@query("""WITH c AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS w FROM orders GROUP BY 1),
s AS (SELECT o_custkey, l_partkey, count(*) AS c FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
t AS (SELECT o_custkey, string_agg(l_partkey::VARCHAR, ', ' ORDER BY c DESC, l_partkey) AS names FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY c DESC, l_partkey) <= 4) GROUP BY 1)
SELECT o_custkey, n || ' cases | ' || w || ' won / ' || (n - w) || ' lost' || chr(10) || 'most cited: ' || coalesce(names, 'none') AS pattern FROM c LEFT JOIN t USING (o_custkey)""")
def pattern_lines(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cited = o.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey")
    return stats.pattern_lines(o, cited, "o_custkey", F.col("o_orderstatus") == "F", "l_partkey")


@query("""WITH g AS (SELECT o_custkey, o_orderstatus AS kind, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_custkey, string_agg(kind || '=' || n, ',' ORDER BY position(kind IN 'FOP')) AS kinds FROM g GROUP BY 1""")
def version_counts(spark, sf_dir):
    g = stats.version_counts(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])
    return g.select("o_custkey", F.array_join(F.transform("kinds", lambda k: F.concat(k["kind"], F.lit("="), k["version_count"])), ",").alias("kinds"))


@query("""WITH n AS (SELECT o_custkey AS law, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS pno, max(o_orderdate)::DATE::VARCHAR AS pdate FROM orders GROUP BY 1)
SELECT law, kind, pno, pdate FROM n JOIN (SELECT DISTINCT o_custkey AS law, o_orderstatus AS kind FROM orders) USING (law) WHERE NOT EXISTS (FROM orders WHERE o_custkey = law AND o_orderstatus = kind AND o_orderkey = pno AND o_orderkey % 4 > 0)""")
def newest_unknown(spark, sf_dir):
    """Every customer's newest order against those known of each kind; a quarter of them is not known yet."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("law"), F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("pno"), F.col("o_orderdate").cast("date").cast("string").alias("pdate"))
    return stats.newest_unknown(o, o.filter("pno % 4 > 0"), o, "law", "pno", "pdate")
