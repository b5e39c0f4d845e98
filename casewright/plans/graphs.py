"""Graph queries. region > nation > customer or supplier is the hierarchy; orders cite parts through their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import graph as g
from casewright.operators import temporal as t

from .registry import query, table
from .temporal import LANES, SNAP, V, snapshots


@query("""SELECT DISTINCT p.p_name, o.o_orderkey AS case_id, o.o_orderdate::DATE::VARCHAR AS judged FROM part p JOIN lineitem l ON l.l_partkey = p.p_partkey JOIN orders o ON o.o_orderkey = l.l_orderkey
WHERE contains(p.p_brand, '#1') AND p.p_size <= 5""")
def statute_cases(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter(F.col("p_brand").contains("#1") & (F.col("p_size") <= 5)).select(F.col("p_partkey").alias("pk"), "p_name")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pk"), F.col("l_orderkey").alias("case_id"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderdate").cast("date").cast("string").alias("judged"))
    return g.chain_sorted(p, (lines, "pk"), (o, "case_id")).select("p_name", "case_id", "judged").distinct()


@query("""SELECT n.n_nationkey, n.n_name, coalesce(string_agg(c.c_custkey::VARCHAR, ',' ORDER BY c.c_custkey), '') AS issues, count(c.c_custkey) AS n_issues
FROM nation n LEFT JOIN (SELECT * FROM customer WHERE c_acctbal < 0) c ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2""")
def structure_optional(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    return g.collect_optional(n, c, "n_nationkey", ["c_custkey"], "issues")


def _levels(spark, sf_dir):
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return r, n, c, s


@query("""SELECT 'r' || r_regionkey AS id, 'chapter' AS kind, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'section', n_name FROM nation
UNION ALL SELECT 'c' || c_custkey, 'article', c_name FROM customer UNION ALL SELECT 's' || s_suppkey, 'article', s_name FROM supplier""")
def chapter_graph_nodes(spark, sf_dir):
    r, n, c, s = _levels(spark, sf_dir)
    part = lambda df, p, key, kind, name: df.select(F.concat(F.lit(p), key).alias("id"), F.lit(kind).alias("kind"), F.col(name).alias("name"))
    return g.node_set([part(r, "r", "r_regionkey", "chapter", "r_name"), part(n, "n", "n_nationkey", "section", "n_name"), part(c, "c", "c_custkey", "article", "c_name"), part(c, "c", "c_custkey", "article", "c_name"), part(s, "s", "s_suppkey", "article", "s_name")])


@query("""SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'HAS_SECTION' AS kind FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'HAS_ARTICLE' FROM customer
UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'HAS_ARTICLE' FROM supplier""")
def chapter_graph_edges(spark, sf_dir):
    r, n, c, s = _levels(spark, sf_dir)
    part = lambda df, p, a, q, b, kind: df.select(F.concat(F.lit(p), a).alias("src"), F.concat(F.lit(q), b).alias("dst"), F.lit(kind).alias("kind"))
    return g.edge_list([part(n, "r", "n_regionkey", "n", "n_nationkey", "HAS_SECTION"), part(c, "n", "c_nationkey", "c", "c_custkey", "HAS_ARTICLE"), part(s, "n", "s_nationkey", "s", "s_suppkey", "HAS_ARTICLE")])


@query("SELECT l_orderkey AS issue, l_linenumber AS step, l_partkey AS article, s_name AS basis FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey IN (7, 77)")
def reverse_lookup(spark, sf_dir):
    steps = table(spark, sf_dir, "lineitem").filter(F.col("l_partkey").isin(7, 77))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("basis"))
    return g.hop(steps, s, "l_suppkey").select(F.col("l_orderkey").alias("issue"), F.col("l_linenumber").alias("step"), F.col("l_partkey").alias("article"), "basis")


@query("""SELECT l_partkey, CASE WHEN p.p_partkey IS NOT NULL THEN 'ARTICLE' ELSE 'TARGET' END AS linked_to, count(*) AS n FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 25) p ON p.p_partkey = l_partkey GROUP BY 1, 2""")
def exists_else_fallback(spark, sf_dir):
    targets = table(spark, sf_dir, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    cites = table(spark, sf_dir, "lineitem").select("l_partkey")
    return g.link_or_fallback(cites, targets, ["l_partkey"], "ARTICLE", F.lit("TARGET")).groupBy("l_partkey", "linked_to").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
d(root, id, depth) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION ALL SELECT d.root, e.child, d.depth + 1 FROM d JOIN e ON e.parent = d.id) SELECT root, depth, count(*) AS n FROM d GROUP BY ALL""")
def containment_recursive(spark, sf_dir):
    r, n, _, _ = _levels(spark, sf_dir)
    e = n.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    e = e.unionByName(table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("child")))
    return g.descendants(e, r.select(F.concat(F.lit("r"), "r_regionkey").alias("root"))).groupBy("root", "depth").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT c.c_custkey, s.s_suppkey FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN supplier s ON s.s_nationkey = n.n_nationkey WHERE c.c_acctbal > 9900 ORDER BY 1, 2 LIMIT 20""")
def comember_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 9900").select("c_custkey", F.col("c_nationkey").alias("nk"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nk"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nk"))
    # each customer brings a row at least, and the answer begins with the least customers
    least = c.join(n, "nk", "left_semi").join(s, "nk", "left_semi").orderBy("c_custkey").limit(20)
    return g.chain_sorted(least, (n, "nk"), (s, "nk")).select("c_custkey", "s_suppkey").distinct().orderBy("c_custkey", "s_suppkey").limit(20)


@query(f"""WITH {V}, {SNAP}, p AS (SELECT family, law_no, decree_no, rule_no FROM snap WHERE valid_to IS NULL)
SELECT family, 'LAW' AS scope, 0 AS scope_rank, law_no AS version FROM p UNION ALL SELECT family, 'DECREE', 1, decree_no FROM p UNION ALL SELECT family, 'RULE', 2, rule_no FROM p""")
def snapshot_scope_versions(spark, sf_dir):
    s = t.latest_per_group(snapshots(spark, sf_dir).filter("valid_to is null"), ["family"], "valid_from")
    return g.spread_scopes(s, "family", {n.upper(): f"{n}_no" for n in LANES})


@query("""SELECT e.vec_id, o.o_custkey, o.o_orderstatus FROM embeddings e JOIN orders o ON o.o_orderkey = e.vec_id WHERE e.label = 1""")
def hits_to_cases(spark, sf_dir):
    hits = table(spark, sf_dir, "embeddings").filter("label = 1").select("vec_id")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("vec_id"), "o_custkey", "o_orderstatus")
    return g.hop(hits, o, "vec_id").select("vec_id", "o_custkey", "o_orderstatus")


@query("""SELECT n_nationkey AS k FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -900) AND n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def key_intersection(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_acctbal < -900").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s)


@query("""SELECT c.c_custkey, coalesce(c2.domain, n.domain, r.domain) AS domain FROM customer c LEFT JOIN (SELECT c_custkey, 'own' AS domain FROM customer WHERE c_custkey % 7 = 0) c2 ON c2.c_custkey = c.c_custkey
JOIN (SELECT n_nationkey, n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS domain FROM nation) n ON n.n_nationkey = c.c_nationkey JOIN (SELECT r_regionkey, r_name AS domain FROM region) r ON r.r_regionkey = n.n_regionkey""")
def inherit_domain(spark, sf_dir):
    r, n, _, _ = _levels(spark, sf_dir)
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nk"), F.when(F.col("c_custkey") % 7 == 0, "own").alias("d0"))
    n = n.select(F.col("n_nationkey").alias("nk"), F.col("n_regionkey").alias("rk"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("d1"))
    r = r.select(F.col("r_regionkey").alias("rk"), F.col("r_name").alias("d2"))
    return g.chain_sorted(c, (n, "nk"), (r, "rk")).select("c_custkey", F.coalesce("d0", "d1", "d2").alias("domain"))
