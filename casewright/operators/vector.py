"""Exact vector search by cosine, with filters before or after it, and the fusion of several result lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if either vector is zero or missing."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norms > 0, dot(a, b) / norms), F.lit(0.0))


def similarity(vector: str, query: list[float], digits: int = 4) -> Column:
    """Rounded cosine of a column with one query vector, whose norm is worked out once."""
    norm = sum(x * x for x in query) ** 0.5
    if not norm:
        return F.lit(0.0)
    q = F.array(*[F.lit(x / norm) for x in query])
    own = F.sqrt(dot(F.col(vector), F.col(vector)))
    return F.round(F.coalesce(F.when(own > 0, dot(F.col(vector), q) / own), F.lit(0.0)), digits)


def vector_of(df: DataFrame, key: str, value, vector: str) -> list[float]:
    """One row's vector, as a query; empty if there is none."""
    row = df.filter(F.col(key) == value).select(F.col(vector).cast("array<double>").alias("v")).first()
    return row["v"] if row and row["v"] else []


def where(clauses: dict | None) -> Column:
    """Equality for values, membership for lists, all of them together; true without clauses."""
    tests = [F.col(k).isin(v) if isinstance(v, list | tuple | set) else F.col(k) == v for k, v in (clauses or {}).items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def top_k(df: DataFrame, query: list[float], k: int, key: str, vector: str, clauses: dict | None = None) -> DataFrame:
    """The k most similar rows among those that satisfy the clauses, with ``similarity``; ties by key. None for an empty query."""
    scored = df.filter(where(clauses)).withColumn("similarity", similarity(vector, query))
    return scored.orderBy(F.col("similarity").desc(), key).limit(k if query else 0)


def top_k_then_filter(df: DataFrame, query: list[float], k: int, key: str, vector: str, keep: Column, most: int = 50) -> DataFrame:
    """Fetches min(3k, most) rows, drops those that fail ``keep``, and returns k. The filter never moves below the fetch."""
    fetched = top_k(df, query, min(3 * k, most), key, vector)
    return fetched.filter(keep).orderBy(F.col("similarity").desc(), key).limit(k)


def top_k_relaxed(df: DataFrame, query: list[float], k: int, key: str, vector: str, clauses: dict, least: int = 3) -> DataFrame:
    """The filtered top k or, if those are fewer than ``least``, the unfiltered; ``relaxed`` says which. No action on the driver."""
    strict = top_k(df, query, k, key, vector, clauses).withColumn("relaxed", F.lit(False))
    loose = top_k(df, query, k, key, vector).withColumn("relaxed", F.lit(True))
    both = strict.unionByName(loose)
    # at most 2k rows stand in this window
    n = F.sum(F.when(~F.col("relaxed"), 1).otherwise(0)).over(Window.partitionBy())
    return both.withColumn("_n", n).filter(F.col("relaxed") == (F.col("_n") < least)).drop("_n")


def top_k_batch(df: DataFrame, queries: dict[int, list[float]], k: int, key: str, vector: str) -> DataFrame:
    """The k most similar rows of each of a few queries, not deduplicated: query, rank and the rows' columns.

    Every row is scored against the stated queries in one pass; partial top-k lists are cut before the shuffle.
    """
    scores = F.array(*[F.struct(F.lit(q).alias("query"), similarity(vector, v).alias("similarity")) for q, v in queries.items() if v])
    rows = df.select("*", F.inline(scores))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("similarity").desc(), key))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_k_by_class(df: DataFrame, query: list[float], quotas: dict, klass: str, key: str, vector: str) -> DataFrame:
    """The most similar rows of each class, as many as its quota."""
    quota = reduce(lambda c, q: c.when(F.col(klass) == q[0], q[1]), quotas.items(), F.when(F.lit(False), 0))
    rows = df.filter(F.col(klass).isin(list(quotas))).withColumn("similarity", similarity(vector, query))
    rank = F.row_number().over(Window.partitionBy(klass).orderBy(F.col("similarity").desc(), key))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= quota)


def nearest_match(left: DataFrame, right: DataFrame, group: str, left_key: str, right_key: str, vector: str, most: int = 10_000) -> DataFrame:
    """For each left row the right row of its group with the largest cosine (ties by right key): group, keys, score.

    Every left row meets its group's right rows, so groups must be small (the issues of one case): the job fails, and names
    the group, where one has over ``most`` right rows. Only the best of a task's rows is shuffled.
    """
    n = F.count("*").over(Window.partitionBy(group))
    large = F.raise_error(F.concat(F.lit("too many rows to match in group "), F.coalesce(F.col(group).cast("string"), F.lit("null")))).cast("boolean")
    r = right.select(group, F.col(right_key).alias("_rk"), F.col(vector).alias("_rv")).withColumn("_n", n).filter(F.when(F.col("_n") > most, large).otherwise(True)).drop("_n")
    joined = left.select(group, F.col(left_key).alias("_lk"), F.col(vector).alias("_lv")).join(r, group)
    joined = joined.withColumn("_s", F.round(cosine(F.col("_lv"), F.col("_rv")), 6))
    best = F.max(F.struct(F.col("_s"), (-F.col("_rk")).alias("_n")))
    return joined.groupBy(group, "_lk").agg(best.alias("b")).select(group, F.col("_lk").alias(left_key), (-F.col("b._n")).alias(f"matched_{right_key}"), F.col("b._s").alias("score"))


def quality_gate(hits: DataFrame, least: int = 3, low: float = 0.60, high: float = 0.70) -> DataFrame:
    """One row: n, best, verdict: retry (too few, or best below low), judge (up to high), accept."""
    g = hits.agg(F.count("*").alias("n"), F.max("similarity").alias("best"))
    return g.withColumn("verdict", F.when((F.col("n") < least) | (F.coalesce("best", F.lit(0.0)) < low), "retry").when(F.col("best") < high, "judge").otherwise("accept"))


def expand_query(query: Column, variants: Column, suffix: str) -> Column:
    """Variants, the query and the query with a suffix, each once, in this order."""
    return F.array_distinct(F.concat(variants, F.array(query, F.concat_ws(" ", query, F.lit(suffix)))))


def fan_out(sources: dict[str, DataFrame]) -> DataFrame:
    """Result lists side by side with their source and its position; Spark runs their stages concurrently."""
    named = [df.withColumn("source", F.lit(n)).withColumn("source_rank", F.lit(i)) for i, (n, df) in enumerate(sources.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def first_by_key(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")


def merge_lists(sources: dict[str, DataFrame], key: str, limit: int) -> DataFrame:
    """The lists one after the other by rank, each key once where it first comes, at most ``limit`` rows."""
    return first_by_key(fan_out(sources), key, "source_rank", "rank").orderBy("source_rank", "rank").limit(limit)


def fuse_reciprocal(sources: dict[str, DataFrame], key: str, limit: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: key, score = sum of 1 / (rank + constant)."""
    score = F.round(F.sum(1 / (F.col("rank") + constant)), 8)
    return fan_out(sources).groupBy(key).agg(score.alias("score")).orderBy(F.col("score").desc(), key).limit(limit)


def ranked(df: DataFrame, *order: str | Column, columns: list[str]) -> DataFrame:
    """Selected columns with ``rank``, from 1, of a result list (which has a bounded number of rows)."""
    return df.select(*columns, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("rank"))


def bundle(df: DataFrame, query: list[float], limits: dict[str, tuple[dict, int]], key: str, vector: str) -> DataFrame:
    """A retrieval bundle: the nearest rows of several collections side by side, each with its own filter and limit; adds source, rank.

    limits: source -> (clauses as for where(), how many). One scan for all: a row counts for each source whose clauses it meets.
    """
    sim = df.withColumn("similarity", similarity(vector, query))
    tagged = sim.withColumn("source", F.explode(F.array_compact(F.array(*[F.when(where(c), F.struct(F.lit(n).alias("name"), F.lit(k).alias("most"))) for n, (c, k) in limits.items()]))))
    order = Window.partitionBy("source").orderBy(F.col("similarity").desc(), key)
    ranked_ = tagged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(k for _, k in limits.values()))
    return ranked_.filter(F.col("rank") <= F.col("source.most")).withColumn("source", F.col("source.name"))
