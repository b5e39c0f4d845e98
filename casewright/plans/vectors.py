"""Vector queries over ``embeddings``; orders stand for the cases whose order key is the vector's id."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import stats
from casewright.operators import vector as v

from .registry import query, table

SIM = "round(list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {q})), 4)"


def _q(spark, sf_dir, i=0):
    e = table(spark, sf_dir, "embeddings")
    return e, v.vector_of(e, "vec_id", i, "embedding")


def _top(q, k, where="true"):
    return f"SELECT e.vec_id, e.label, {SIM.format(q=q)} AS similarity FROM embeddings e WHERE {where} ORDER BY similarity DESC, vec_id LIMIT {k}"


@query(f"""WITH t AS ({_top(0, 100)}) SELECT year(o.o_orderdate)::INTEGER AS year, count(*) AS total, count(*) FILTER (o.o_orderstatus = 'F') AS wins,
round(count(*) FILTER (o.o_orderstatus = 'F') * 100.0::DOUBLE / count(*), 1) AS win_rate FROM t JOIN orders o ON o.o_orderkey = t.vec_id GROUP BY 1""")
def trend_hybrid(spark, sf_dir):
    e, q = _q(spark, sf_dir)
    hits = v.top_k(e, q, 100, "vec_id", "embedding").select("vec_id", "similarity")
    cases = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("year"))
    return stats.rate_by(hits.join(cases, F.col("vec_id") == F.col("o_orderkey")), ["year"], F.col("o_orderstatus") == "F")


@query(f"SELECT * FROM ({_top(0, 20)})")
def vector_topk(spark, sf_dir):
    e, q = _q(spark, sf_dir)
    return v.top_k(e, q, 20, "vec_id", "embedding").select("vec_id", "label", "similarity")


@query(f"SELECT * FROM ({_top(0, 20, 'label IN (1, 2, 3) AND vec_id % 2 = 0')})")
def vector_topk_prefilter(spark, sf_dir):
    e, q = _q(spark, sf_dir)
    e = e.withColumn("parity", F.col("vec_id") % 2)
    return v.top_k(e, q, 20, "vec_id", "embedding", {"label": [1, 2, 3], "parity": 0}).select("vec_id", "label", "similarity")


@query(f"SELECT vec_id, label, similarity FROM (SELECT * FROM ({_top(0, 30)}) WHERE label % 2 = 0 ORDER BY similarity DESC, vec_id LIMIT 10)")
def vector_overfetch_postfilter(spark, sf_dir):
    e, q = _q(spark, sf_dir)
    return v.top_k_then_filter(e, q, 10, "vec_id", "embedding", F.col("label") % 2 == 0).select("vec_id", "label", "similarity")


@query(f"""WITH s AS ({_top(0, 10, 'label = 77')}), l AS ({_top(0, 10)}) SELECT *, false AS relaxed FROM s WHERE (SELECT count(*) FROM s) >= 3
UNION ALL SELECT *, true FROM l WHERE (SELECT count(*) FROM s) < 3""")
def vector_relax_filter(spark, sf_dir):
    e, q = _q(spark, sf_dir)
    return v.top_k_relaxed(e, q, 10, "vec_id", "embedding", {"label": 77}).select("vec_id", "label", "similarity", "relaxed")


@query("""WITH p AS (SELECT l.vec_id // 50 AS case_id, l.vec_id AS core, r.vec_id AS logic, round(list_cosine_similarity(l.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS score
FROM embeddings l JOIN embeddings r ON l.vec_id // 50 = r.vec_id // 50 WHERE l.vec_id % 3 = 0 AND r.vec_id % 3 <> 0)
SELECT case_id, core AS vec_id, logic AS matched_vec_id, score FROM p QUALIFY row_number() OVER (PARTITION BY core ORDER BY score DESC, logic) = 1""")
def nearest_match_join(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("case_id", F.floor(F.col("vec_id") / 50))
    return v.nearest_match(e.filter("vec_id % 3 = 0"), e.filter("vec_id % 3 <> 0"), "case_id", "vec_id", "vec_id", "embedding")


def _lists(spark, sf_dir):
    e, q = _q(spark, sf_dir)
    out = {}
    for name, labels in (("court", [0, 1, 2, 3]), ("tribunal", [2, 3, 4, 5]), ("reply", [4, 5, 6, 7])):
        hits = v.top_k(e, q, 10, "vec_id", "embedding", {"label": labels})
        out[name] = v.ranked(hits, F.col("similarity").desc(), "vec_id", columns=["vec_id", "similarity"])
    return out


_LISTS = "WITH " + ", ".join(f"{n} AS (SELECT vec_id, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank, {i} AS source_rank, '{n}' AS source FROM ({_top(0, 10, f'label IN ({ls})')}))" for i, (n, ls) in enumerate((("court", "0, 1, 2, 3"), ("tribunal", "2, 3, 4, 5"), ("reply", "4, 5, 6, 7")))) + ", al AS (SELECT * FROM court UNION ALL SELECT * FROM tribunal UNION ALL SELECT * FROM reply)"


@query(f"{_LISTS} SELECT vec_id, similarity, source FROM (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY source_rank, rank) = 1 ORDER BY source_rank, rank LIMIT 15)")
def multi_source_dedup(spark, sf_dir):
    return v.merge_lists(_lists(spark, sf_dir), "vec_id", 15).select("vec_id", "similarity", "source")


@query(f"{_LISTS} SELECT vec_id, round(sum(1.0::DOUBLE / (rank + 60)), 8) AS score FROM al GROUP BY 1 ORDER BY score DESC, vec_id LIMIT 12")
def rrf_fusion(spark, sf_dir):
    return v.fuse_reciprocal(_lists(spark, sf_dir), "vec_id", 12)


@query(f"SELECT count(*) AS n, max(similarity) AS best, CASE WHEN count(*) < 3 OR max(similarity) < 0.6 THEN 'retry' WHEN max(similarity) < 0.7 THEN 'judge' ELSE 'accept' END AS verdict FROM ({_top(0, 10, 'vec_id <> 0')})")
def quality_gate(spark, sf_dir):
    e, q = _q(spark, sf_dir)
    return v.quality_gate(v.top_k(e.filter("vec_id <> 0"), q, 10, "vec_id", "embedding"))


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT {i} AS query, vec_id, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id)::INTEGER AS rank FROM ({_top(i, 5)})" for i in (0, 7, 11)) + ")")
def batch_topk_per_query(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return v.top_k_batch(e, {i: v.vector_of(e, "vec_id", i, "embedding") for i in (0, 7, 11)}, 5, "vec_id", "embedding").select("query", "vec_id", "similarity", "rank")


@query(f"SELECT vec_id, label, similarity FROM ({_top(0, 10, 'label = 1')}) UNION ALL SELECT vec_id, label, similarity FROM ({_top(0, 5, 'label = 2')})")
def stratified_topk(spark, sf_dir):
    e, q = _q(spark, sf_dir)
    return v.top_k_by_class(e, q, {1: 10, 2: 5}, "label", "vec_id", "embedding").select("vec_id", "label", "similarity")


@query(" UNION ALL ".join(f"SELECT vec_id, similarity, '{n}' AS source, row_number() OVER (ORDER BY similarity DESC, vec_id)::INTEGER AS rank FROM ({_top(0, k, f'label IN ({ls})')})" for n, ls, k in (("court", "0, 1, 2, 3", 10), ("tribunal", "2, 3, 4, 5", 6), ("articles", "6, 7", 5))))
def retrieval_bundle(spark, sf_dir):
    """What one agent retrieves: ten court cases, six of the tribunal and five articles, in one scan."""
    e, q = _q(spark, sf_dir)
    limits = {"court": ({"label": [0, 1, 2, 3]}, 10), "tribunal": ({"label": [2, 3, 4, 5]}, 6), "articles": ({"label": [6, 7]}, 5)}
    return v.bundle(e, q, limits, "vec_id", "embedding").select("vec_id", "similarity", "source", "rank")
