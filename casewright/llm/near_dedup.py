"""MinHash near-dedup: one-permutation hashing with optimal densification, bands, star-shaped candidates, exact checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, keyed, mix, stage, text_slices, word_hashes
from .components import components

BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
_K = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_BOUNDS = (np.arange(BINS, dtype=np.uint64) << np.uint64(57))
#: Donors of an empty bin, in the order in which they are tried; the same for every document.
_DONORS = (mix(np.arange(BINS, dtype=np.uint64)[:, None] * _K[0] + np.arange(4096, dtype=np.uint64)[None, :] * _K[1]) >> np.uint64(57)).astype(np.int64)
_TURN = _K[2 : 2 + ROWS]
_BAND = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of ``width`` words; a shorter text is one shingle."""
    words, first = word_hashes(data, offsets)
    n = max(0, len(words) - width + 1)
    grams = np.zeros(n, np.uint64)
    for k in range(width):
        grams += words[k : k + n] * _K[8 + k]
    grams = mix(grams)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= width:
            g = np.sort(grams[lo : hi - width + 1])
            out.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
        elif hi > lo:
            short = (words[lo:hi] * _K[40 : 40 + hi - lo]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short + np.uint64(hi - lo)))
        else:
            out.append(grams[:0])
    return out


def band_keys(s: np.ndarray) -> np.ndarray:
    """Keys of the bands of a sorted set: its least hash in each bin, empty bins filled from their donors, four bins to a band."""
    at = np.searchsorted(s, _BOUNDS)
    full = np.concatenate((at[1:], [len(s)])) > at
    values = np.where(full, s[np.minimum(at, len(s) - 1)], np.uint64(0))
    empty = np.flatnonzero(~full)
    if len(empty):
        donors = _DONORS[empty]
        good = full[donors[:, :64]]
        pick = good.argmax(1)
        for k in np.flatnonzero(~good.any(1)):
            more = full[donors[k]]
            pick[k] = more.argmax() if more.any() else -1
        values[empty] = np.where(pick >= 0, values[donors[np.arange(len(empty)), pick]], s[0])
    return mix((mix(values).reshape(BANDS, ROWS) * _TURN).sum(1, dtype=np.uint64) ^ _BAND)


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    at = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (size of the set), k1 and k2 (128 bits that stand for the set), bands."""

    def each(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, data, offsets in text_slices(batch.column(1)):
                sets = shingle_sets(data, offsets, width)
                k = np.array([(mix(s ^ _K[60]).sum(dtype=np.uint64), mix(s ^ _K[61]).sum(dtype=np.uint64)) for s in sets], np.uint64).reshape(len(sets), 2).view(np.int64)
                bands = [band_keys(s) if len(s) else s for s in sets]
                yield pa.RecordBatch.from_arrays([ids[lo : lo + len(sets)], pa.array([len(s) for s in sets], pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), _longs(bands)], ["doc_id", "n", "k1", "k2", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, n long, k1 long, k2 long, bands array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc_id and the whole set of each document in ids."""

    def each(batches):
        for batch in batches:
            for lo, data, offsets in text_slices(batch.column(1)):
                sets = shingle_sets(data, offsets, width)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo : lo + len(sets)], _longs(sets)], ["doc_id", "set"])

    wanted = docs.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id", "left_semi")
    return wanted.mapInArrow(each, "doc_id long, set array<long>")



def links_within(ids: np.ndarray, labels: np.ndarray, rest: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join different labels, no more than join them all. Pairs of which neither is ``rest`` are known."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate(([True], values[1:] != values[:-1]))
    word = np.cumsum(new) - 1
    many = np.bincount(word) > 1
    keep = many[word]
    owner, word = owner[keep], (np.cumsum(many) - 1)[word[keep]]
    both = np.zeros((n, n), np.float32)
    total = int(word[-1]) + 1 if len(word) else 0
    for lo in range(0, total, 4096):
        a, b = np.searchsorted(word, (lo, lo + 4096))
        has = np.zeros((n, min(4096, total - lo)), np.float32)
        has[owner[a:b], word[a:b] - lo] = 1
        both += has @ has.T
    both = both.astype(np.int64)
    near = (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)) & (rest[:, None] | rest[None, :])
    parent = {x: x for x in labels.tolist()}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in np.argwhere(np.triu(near, 1)).tolist():
        x, y = root(int(labels[i])), root(int(labels[j]))
        if x != y:
            parent[x] = y
            out.append((int(ids[i]), int(ids[j])))
    return out


def open_links(buckets: DataFrame, sets: DataFrame, percent: int, block: int = 256) -> DataFrame:
    """a, b: links inside buckets that the stars left in pieces. buckets: key, doc_id, label, main (the hub's label).

    A bucket's members outside the hub's piece meet each other and that piece in blocks of about ``block`` members; a task
    holds two blocks at a time, counts every pair's common shingles exactly, and returns no more links than join the pieces.
    """
    b = buckets.withColumn("rest", F.col("label") != F.col("main"))
    per = b.groupBy("key").agg(F.count_if(F.col("rest")).alias("nr"), F.count_if(~F.col("rest")).alias("nm"))
    per = stage(per.select("key", F.ceil(F.col("nr") / block).alias("rb"), F.ceil(F.col("nm") / block).alias("mb")), "near-blocks")
    b = b.join(per, "key")
    own = F.when(F.col("rest"), F.pmod(F.xxhash64("doc_id"), F.greatest("rb", F.lit(1)))).otherwise(F.pmod(F.xxhash64("doc_id"), F.greatest("mb", F.lit(1))))
    b = b.withColumn("own", own)
    up = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    with_rest = F.transform(up(F.col("rb")), lambda x: F.struct(F.least(x, F.col("own")).alias("p"), F.greatest(x, F.col("own")).alias("q")))
    with_main = F.when(F.col("mb") > 0, F.transform(up(F.greatest("mb", F.lit(1))), lambda y: F.struct(F.col("own").alias("p"), (-1 - y).alias("q")))).otherwise(F.array().cast("array<struct<p:bigint,q:bigint>>"))
    main = F.transform(up(F.col("rb")), lambda x: F.struct(x.alias("p"), (-1 - F.col("own")).alias("q")))
    b = b.withColumn("pq", F.explode(F.when(F.col("rest"), F.concat(with_rest, with_main)).otherwise(main))).select("key", "pq.p", "pq.q", "doc_id", "label", "rest")

    def each(batches):
        at, rows = None, []

        def flush():
            if len(rows) > 1:
                found = links_within(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), [r[3] for r in rows], percent)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        for batch in batches:
            keys, ps, qs, ids, labels, rest = (batch.column(i).to_pylist() for i in range(6))
            starts = batch.column(6).offsets.to_numpy()
            flat = batch.column(6).values.to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                k = (keys[i], ps[i], qs[i])
                if k != at:
                    yield from flush()
                    at, rows = k, []
                rows.append((ids[i], labels[i], rest[i], flat[starts[i] : starts[i + 1]]))
            rows = [(i, x, r, s.copy()) for i, x, r, s in rows]
        yield from flush()

    b = b.join(sets, "doc_id").select("key", "p", "q", "doc_id", "label", "rest", "set").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return b.mapInArrow(each, "a long, b long")


def near_groups(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """Every document: doc_id, n_shingles, component_id, kept.

    Documents with equal sets are one node. Documents that share a band's key form a bucket; each bucket's hub is the
    member that shares most buckets, and every other member is compared with it on the whole sets. Buckets that the
    resulting components leave in pieces are then searched in full, in blocks (open_links), so the star loses no link.

    Texts without words, and null texts, have an empty set and are linked with nothing. Rows that repeat a doc_id count
    as one document. A row without doc_id is linked with nothing, has no component_id and is kept. An empty table gives
    an empty result.
    """
    sig = stage(signatures(docs, width), "near-signatures")
    some = sig.filter("n > 0 and doc_id is not null")
    many = stage(some.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).filter("c > 1").drop("c"), "near-equal")
    nodes = stage(sig.join(many, ["k1", "k2"], "left").select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("rep"), F.when(F.col("n") > 0, F.col("bands")).alias("bands")), "near-nodes")
    drop(sig, many)
    keys = nodes.filter("doc_id = rep and bands is not null").select("doc_id", "n", F.explode("bands").alias("key"))
    shared = stage(keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "near-shared")
    buckets = stage(keys.join(shared, "key").select("key", "doc_id", "n", "c"), "near-buckets")
    weight = stage(buckets.groupBy("doc_id").agg(F.sum("c").alias("w")), "near-weights")
    hubs = buckets.join(weight, "doc_id").groupBy("key").agg(F.max(F.struct("w", (-F.col("doc_id")).alias("id"), "n")).alias("h"))
    hubs = stage(hubs.select("key", (-F.col("h.id")).alias("hub"), F.col("h.n").alias("hub_n")), "near-hubs")
    stars = buckets.join(hubs, "key").filter("doc_id <> hub").filter(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
    stars = stage(stars.select(F.least("doc_id", "hub").alias("x"), F.greatest("doc_id", "hub").alias("y")).distinct(), "near-stars")
    ids = stage(buckets.select("doc_id").distinct(), "near-ids")
    sets = stage(full_sets(docs, ids, width), "near-sets")
    both = F.size(F.array_intersect("s", "t"))
    tested = stars.join(sets.select(F.col("doc_id").alias("x"), F.col("set").alias("s")), "x").join(sets.select(F.col("doc_id").alias("y"), F.col("set").alias("t")), "y")
    tested = tested.filter(100 * both >= percent * (F.size("s") + F.size("t") - both))
    links = stage(tested.select(F.col("x").alias("a"), F.col("y").alias("b")), "near-links")
    labels = components(links)
    labelled = buckets.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    member = F.xxhash64("doc_id")
    state = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("c"), F.sum(F.shiftright(member, 24)).alias("m1"), F.bit_xor(member).alias("m2"))
    state = state.filter("low < high and c > 2").groupBy("c", "m1", "m2").agg(F.min("key").alias("key"))
    main = hubs.join(labels, F.col("hub") == F.col("id"), "left").select("key", F.coalesce("label", "hub").alias("main"))
    opened = stage(state.select("key").join(main, "key"), "near-open")
    if not opened.isEmpty():
        pieces = stage(labelled.join(opened, "key"), "near-pieces")
        more = stage(open_links(pieces, sets, percent), "near-more")
        if not more.isEmpty():
            at = lambda c: F.coalesce(F.col(c), F.col(c[1:]))
            mapped = more.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a", "left").join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b", "left")
            upper = components(mapped.select(at("la").alias("a"), at("lb").alias("b")))
            first = labels.unionByName(upper.join(labels.select("id"), "id", "left_anti").select("id", F.col("id").alias("label")))
            labels = stage(first.join(upper.select(F.col("id").alias("label"), F.col("label").alias("top")), "label", "left").select("id", F.coalesce("top", "label").alias("label")), "near-labels")
        drop(pieces, more)
    drop(shared, buckets, weight, hubs, stars, ids, sets, links, opened)
    out = nodes.drop("bands").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.coalesce("label", "rep")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for the whole ``documents`` table."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group (five-word shingles, similarity of 0.8 or more), and all rows without words.

    Every row is a document of its own, whatever its doc_id; of a group the row with the least doc_id stays (null last),
    of those one by its place in the input.
    """
    rows = keyed(docs, "near-rows")
    # a row for each file of the input; Spark broadcasts the table only while it is small
    numbers = stage(rows.select("__file").distinct().select("__file", (F.row_number().over(Window.orderBy("__file")) - 1).cast("long").alias("__number")), "near-files")
    rows = rows.join(numbers, "__file").select("doc", (F.shiftleft("__number", 40) + F.col("__row")).alias("__n"))
    groups = near_groups(rows.select(F.col("__n").alias("doc_id"), F.col("doc.text").alias("text")), width=5, percent=80).select(F.col("doc_id").alias("__n"), "component_id")
    of = F.col("doc.doc_id")
    first = F.min(F.struct(of.isNull().alias("none"), of.alias("id"), "__n")).alias("w")
    kept = groups.join(rows.select("__n", F.struct(of).alias("doc")), "__n").groupBy("component_id").agg(first).select("w.__n")
    return rows.join(kept, "__n", "left_semi").select("doc.*")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, label) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.label FROM r JOIN u ON u.a = r.id),
l AS (SELECT id, min(label) AS label FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, l.label AS component_id, d.doc_id = l.label AS kept FROM documents d JOIN l ON l.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
