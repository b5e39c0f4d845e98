"""Approximate nearest neighbours by additive quantisation, reranked exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage

WORDS = 256


def _nearest(x: np.ndarray, book: np.ndarray, step: int = 4096) -> np.ndarray:
    half = (book * book).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + step] @ book.T - half, axis=1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k full-dimensional codewords (repeated ones if x has fewer rows)."""
    book = x[rng.permutation(len(x))[:k]]
    book = book[np.arange(k) % len(book)].copy()
    for _ in range(rounds):
        code = _nearest(x, book)
        order = np.argsort(code, kind="stable")
        first = np.searchsorted(code[order], np.arange(k))
        n = np.bincount(code, minlength=k)
        used = n > 0
        sums = np.add.reduceat(x[order], np.minimum(first, len(x) - 1), axis=0)
        book[used] = (sums[used] / n[used, None]).astype(np.float32)
        if (~used).any():
            book[~used] = x[rng.integers(0, len(x), int((~used).sum()))]
    return book


def fit(sample: np.ndarray, stages: int = 16, rounds: int = 5, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """A coarse codebook, and ``stages`` codebooks of what each stage leaves of the residual scaled to length 1."""
    rng = np.random.default_rng(seed)
    coarse = _kmeans(sample, WORDS, rounds, rng)
    rest = sample - coarse[_nearest(sample, coarse)]
    norm = np.linalg.norm(rest, axis=1)
    rest = rest[norm > 1e-12] / norm[norm > 1e-12, None]
    if not len(rest):
        rest = np.zeros((1, sample.shape[1]), np.float32)
    books = []
    for _ in range(stages):
        book = _kmeans(rest, WORDS, rounds, rng)
        book[0] = 0
        rest = rest - book[_nearest(rest, book)]
        books.append(book)
    return coarse, np.stack(books)


def encode(x: np.ndarray, coarse: np.ndarray, books: np.ndarray, beam: int = 4, step: int = 1024):
    """Codes by beam search: coarse code, scale of the residual, its codes, squared norm of what they add up to."""
    out = []
    for lo in range(0, len(x), step):
        v = x[lo : lo + step]
        c = _nearest(v, coarse)
        rest = v - coarse[c]
        scale = np.linalg.norm(rest, axis=1)
        rest = (rest / np.maximum(scale, 1e-12)[:, None])[:, None, :]
        n, codes = len(v), np.zeros((len(v), 1, 0), np.uint8)
        for book in books:
            b = rest.shape[1]
            cost = (rest * rest).sum(2)[:, :, None] - 2 * (rest @ book.T) + (book * book).sum(1)
            cost = cost.reshape(n, b * WORDS)
            keep = np.argpartition(cost, min(beam, cost.shape[1]) - 1, axis=1)[:, :beam]
            keep = np.take_along_axis(keep, np.argsort(np.take_along_axis(cost, keep, 1), axis=1, kind="stable"), 1)
            parent, word = keep // WORDS, keep % WORDS
            rows = np.arange(n)[:, None]
            rest = rest[rows, parent] - book[word]
            codes = np.concatenate((codes[rows, parent], word[:, :, None].astype(np.uint8)), axis=2)
        codes = codes[:, 0]
        made = sum(books[m][codes[:, m]] for m in range(len(books)))
        made = coarse[c] + scale[:, None] * made
        out.append((c.astype(np.uint8), scale.astype(np.float32), codes, (made * made).sum(1).astype(np.float32)))
    return [np.concatenate(p) for p in zip(*out, strict=True)]


def _vectors(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of the rows that take part (the plan has dropped all others)."""
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), flat.reshape(-1, dim).astype(np.float32)


def usable(df: DataFrame) -> DataFrame:
    """vec_id and v of the rows that may take part: an id, finite components, not all zero."""
    v = F.col("embedding")
    good = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists("v", lambda e: e != 0)
    return df.select("vec_id", v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(good)


def search(df: DataFrame, every: int = 100, k: int = 10, wide: int = 320, sample: int = 16_384, lots: int = 4) -> DataFrame:
    """The k rows found nearest to each row whose vec_id is a multiple of ``every``: query_id, rank, vec_id, score.

    Codebooks are fitted on the driver to at most ``sample`` rows, the first by a hash of vec_id. All rows are encoded:
    one coarse codeword, then codewords that add up to the residual scaled to length 1, so that a dense group of rows is
    told apart as well as the whole. Codes travel packed, thousands to a row; every block of queries meets every block of
    codes, lot by lot, and keeps the ``wide`` rows of the lot whose coded distance is least (equal ones by vec_id). The
    ``wide`` least of all lots are reranked on the original vectors in double precision; ties go to the smaller vec_id.

    Rows whose vector is null, zero or not finite, and those of another length than most others (of equally frequent
    lengths the larger), take no part. Of rows that repeat a vec_id the nearest counts, and rows with the query's own
    vec_id never do. Fewer than k rows give fewer results; an empty table gives none; further columns do not matter.
    """
    spark = df.sparkSession
    good = usable(df)
    lengths = good.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("dim").desc()).first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = int(lengths["dim"])
    rows = stage(good.filter(F.size("v") == dim), "ann-rows")
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()["v"]
    model = spark.sparkContext.broadcast(fit(np.stack(some.to_numpy()).astype(np.float32)))

    def encoded(batches):
        coarse, books = model.value
        for batch in batches:
            ids, x = _vectors(batch, dim)
            for lo in range(0, len(ids), 4096):
                part = ids[lo : lo + 4096]
                packed = encode(x[lo : lo + 4096], coarse, books)
                yield pa.RecordBatch.from_arrays([pa.array([int(part[0])], pa.int64()), pa.array([part.tobytes()]), *[pa.array([p.tobytes()]) for p in packed]], ["block", "ids", "coarse", "scale", "codes", "norm"])

    def packed_queries(batches):
        for batch in batches:
            ids, x = _vectors(batch, dim)
            for lo in range(0, len(ids), 1024):
                yield pa.RecordBatch.from_arrays([pa.array([ids[lo : lo + 1024].tobytes()]), pa.array([x[lo : lo + 1024].tobytes()])], ["ids", "queries"])

    codes = stage(rows.mapInArrow(encoded, "block long, ids binary, coarse binary, scale binary, codes binary, norm binary"), "ann-codes")
    asked = rows.filter(F.col("vec_id") % every == 0)
    asked_blocks = stage(asked.repartition(max(1, asked.count() // 4096), F.xxhash64("vec_id")).mapInArrow(packed_queries, "ids binary, queries binary").withColumn("qb", F.monotonically_increasing_id()), "ann-queries")
    # one number for a thousand queries
    numbers = asked_blocks.agg(F.sort_array(F.collect_list("qb")).alias("all")).first()["all"]
    # queries travel once to each lot, codes once to each block of queries
    left = asked_blocks.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))).withColumn("block", F.lit(None).cast("long"))
    right = codes.withColumn("lot", F.pmod(F.xxhash64("block"), F.lit(lots)).cast("int")).withColumn("qb", F.explode(F.lit(numbers).cast("array<long>")))
    both = left.unionByName(right, allowMissingColumns=True).repartition("qb", "lot").sortWithinPartitions("qb", "lot", F.col("block").asc_nulls_first())
    both = both.select("qb", "lot", "ids", "queries", "coarse", "scale", "codes", "norm")

    def scored(batches):
        coarse, books = model.value

        def flush(best):
            for query, (ids, near) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), query)), pa.array(ids), pa.array(near.astype(np.float64))], ["query_id", "vec_id", "near"])

        qids, best = np.zeros(0, np.int64), {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["queries"] is not None:  # a new block of queries, or the same in another lot
                    yield from flush(best)
                    best = {}
                    qids = np.frombuffer(row["ids"], np.int64)
                    queries = np.frombuffer(row["queries"], np.float32).reshape(-1, dim)
                    continue
                ids, c = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["coarse"], np.uint8)
                scale, norm = np.frombuffer(row["scale"], np.float32), np.frombuffer(row["norm"], np.float32)
                code = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1)
                order = np.argsort(ids, kind="stable")
                ids, c, scale, norm, code = ids[order], c[order], scale[order], norm[order], code[order]
                for lo in range(0, len(qids), 64):
                    q = queries[lo : lo + 64]
                    dots = (books[0] @ q.T)[code[:, 0]]
                    for m in range(1, len(books)):
                        dots += (books[m] @ q.T)[code[:, m]]
                    near = norm[:, None] - 2 * ((coarse @ q.T)[c] + scale[:, None] * dots)
                    for j in range(len(q)):
                        query = int(qids[lo + j])
                        col = near[:, j]
                        if query in best:
                            limit = best[query][1][-1] if len(best[query][1]) >= wide else np.inf
                            new = np.flatnonzero((col <= limit) & (ids != query))
                            all_ids, all_near = np.concatenate((best[query][0], ids[new])), np.concatenate((best[query][1], col[new]))
                        else:
                            keep = ids != query
                            all_ids, all_near = ids[keep], col[keep]
                        if len(all_near) > 4 * wide:
                            cut = np.partition(all_near, wide - 1)[wide - 1]
                            all_ids, all_near = all_ids[all_near <= cut], all_near[all_near <= cut]
                        keep = np.lexsort((all_ids, all_near))[:wide]
                        best[query] = (all_ids[keep], all_near[keep])
        yield from flush(best)

    found = both.mapInArrow(scored, "query_id long, vec_id long, near double").groupBy("query_id", "vec_id").agg(F.min("near").alias("near"))
    # a query brings at most lots * wide rows here
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("near", "vec_id"))
    found = stage(found.withColumn("place", place).filter(F.col("place") <= wide).select("query_id", "vec_id"), "ann-found")
    near = found.join(rows, "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    wide_of = lambda c: F.col(c).cast("array<double>")
    score = F.sqrt(F.aggregate(F.zip_with(wide_of("v"), wide_of("q"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    near = near.select("query_id", "vec_id", score.alias("score")).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)
    return near.select(F.col("query_id").cast("long"), "rank", F.col("vec_id").cast("long"), "score")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for the whole ``embeddings`` table."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
