"""Source divergence audit: bitmaps of term ids for each (group, count), whose AND and popcount give a pair's joint cells."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage

#: Terms of about so many bits share the bitmaps of one piece; sources of one block meet those of another in one task.
PIECE, BLOCK = 512, 64
#: Distinct entries that a task counts before it passes them on.
HELD = 400_000
SCALE = 1_000_000_000
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it); a row with a null term for every group.

    Tasks count before anything is shuffled, so a hot source or term arrives as a row or a few for each task.
    """
    names = ["lang", "source", "term", "n", "docs"]

    def told(counts):
        for (lang, source), (n, docs) in counts.items():
            terms = pa.concat_arrays([pa.nulls(1, pa.string()), pa.array(n.keys(), pa.binary()).cast(pa.string())])
            size = len(terms)
            numbers = [pa.array([0, *x], pa.int64()) for x in (n.values(), (docs[t] for t in n))]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), terms, *numbers], names)

    def each(batches):
        counts: dict[tuple, tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            columns = [c.cast(pa.binary()) if k == 2 else c for k, c in enumerate(batch.columns)]
            for lang, source, text in zip(*columns, strict=True):
                terms = _TERM.findall(text.as_buffer().to_pybytes().translate(_LOWER)) if text.is_valid else []
                n, has = counts.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                held -= len(n)
                n.update(terms)
                has.update(set(terms))
                held += len(n)
                if held > HELD:
                    yield from told(counts)
                    counts, held = {}, 0
        yield from told(counts)

    filled = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = filled.mapInArrow(each, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str) -> F.Column:
    """1 + floor(10**9 * (n + 5) / (total + 5 * v)), exactly."""
    return F.expr(f"1 + (cast({n} + 5 AS decimal(20, 0)) * {SCALE}) div cast({total} + 5 * v AS decimal(20, 0))")


def pair_sums(sid: np.ndarray, n: np.ndarray, p: np.ndarray, word: np.ndarray, bits: np.ndarray, size: int, low: int, high: int) -> tuple[np.ndarray, ...]:
    """Pairs of sources (first of block ``low``, second of ``high``, first < second) and their sums of |p - q| over a piece of ``size`` terms.

    Rows are words of bitmaps: the terms that a source has n times. Rows with n = 0 name the sources; their bitmap is the
    complement of the source's others. A cell of a pair is the popcount of the AND of two bitmaps.
    """
    keys, at = np.unique(np.stack((sid, n)), axis=1, return_inverse=True)
    owner, level = keys
    at = at.ravel()
    width = max(1, -(-size // 64))
    maps = np.zeros((len(owner), width), np.uint64)
    some = n > 0
    np.bitwise_or.at(maps, (at[some], word[some]), bits[some].view(np.uint64))
    ps = np.zeros(len(owner), np.int64)
    ps[at] = p
    # levels of a source stand together, its zero first
    zero = np.flatnonzero(level == 0)
    full = np.full(width, ~np.uint64(0))
    if size % 64 or not size:
        full[-1] = np.uint64((1 << size % 64) - 1)
    maps[zero] = full & ~np.bitwise_or.reduceat(maps, zero, axis=0)
    ids = owner[zero]
    ends = np.append(zero[1:], len(owner))
    first, second, value = [], [], []
    for a, (s, e) in zip(ids.tolist(), zip(zero.tolist(), ends.tolist(), strict=True), strict=True):
        others = np.flatnonzero((ids > a) & (ids // BLOCK == high))
        if a // BLOCK != low or not len(others):
            continue
        lo = zero[others[0]]
        theirs = maps[lo : ends[others[-1]]]
        cells = np.zeros((e - s, len(theirs)), np.int64)
        for w in range(width):
            cells += np.bitwise_count(maps[s:e, w, None] & theirs[None, :, w])
        cells *= np.abs(ps[s:e, None] - ps[None, lo : lo + len(theirs)])
        first.append(np.full(len(others), a))
        second.append(ids[others])
        value.append(np.add.reduceat(cells.sum(0), zero[others] - lo))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, second, value))


def audit(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """How each source's words differ from those of its language's other sources, and of the whole language.

    Terms are runs of ASCII letters and of anything beyond ASCII, A-Z lower-cased; a language keeps those in at least
    ``least`` of its documents. Part ``pair`` has a row for each other source of the language, part ``term`` the ``top`` terms
    that the source has oftener than its language. Numbers are integers throughout.

    Bitmaps of term ids are stored for each (group, count) and cut into pieces of about ``PIECE`` terms that are about
    equally frequent; sources are cut into blocks of ``BLOCK``, so a task holds one piece of two blocks, whatever the size of
    a source, term or vocabulary. Pairs that no count tells apart come from the complement, the bitmap of count 0.

    Null text, lang and source are empty, so they form groups like any other; rows that repeat a doc_id are documents of
    their own; a source without terms, or a language without kept ones, still gets its rows (value 0 without terms); equal
    values rank by item in UTF-8 order; texts are read whole, of any length; an empty table gives an empty result. Further
    columns do not matter, whatever their names. The rows of part ``pair`` are as many as the ordered pairs of a
    language's sources. Returns lang, source, part, item, value, rank.
    """
    counts = stage(term_counts(docs), "audit-counts")
    terms = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
    terms = stage(terms.select("lang", "term", "total", F.floor(F.log2("total")).cast("int").alias("band")), "audit-terms")
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_total"))
    bands = terms.groupBy("lang", "band").agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
    placed = terms.join(bands, ["lang", "band"]).withColumn("piece", F.pmod(F.xxhash64("term"), "pieces").cast("int"))
    # a band may hold most of a language's terms, so what numbers them is dealt by the piece
    placed = placed.repartition("lang", "band", "piece").withColumn("pos", F.row_number().over(Window.partitionBy("lang", "band", "piece").orderBy("term")) - 1).join(langs, "lang")
    placed = stage(placed.select("lang", "term", "band", "piece", "pos", share("total", "lang_total").alias("q")), "audit-places")
    kept = stage(counts.filter("term IS NOT NULL").join(placed, ["lang", "term"]).select("lang", "source", "term", "n", "band", "piece", "pos", "q"), "audit-kept")

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs.select("lang", "v"), "lang", "left")
    groups = groups.na.fill(0, ["total", "v"]).withColumn("sid", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = groups.withColumn("blocks", F.floor((F.count("*").over(Window.partitionBy("lang")) - 1) / BLOCK) + 1)
    groups = stage(groups.withColumn("p0", F.when(F.col("v") > 0, share("0", "total")).otherwise(F.lit(0))), "audit-groups")

    known = kept.join(groups, ["lang", "source"]).withColumn("p", share("n", "total"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    top_terms = known.filter("p > q").select("lang", "source", "term", (F.col("p") - F.col("q")).alias("value")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    maps = known.groupBy("lang", "sid", "band", "piece", "n", "p", "blocks", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    sizes = placed.groupBy("lang", "band", "piece").agg(F.count("*").cast("int").alias("size"))
    none = groups.filter("v = 0").select("lang").distinct().select("lang", F.lit(-1).alias("band"), F.lit(0).alias("piece"), F.lit(0).alias("size"))
    zeros = groups.join(sizes.unionByName(none), "lang").select("lang", "sid", "band", "piece", F.lit(0).cast("long").alias("n"), F.col("p0").alias("p"), "blocks", F.lit(0).alias("word"), F.lit(0).cast("long").alias("bits"), "size")
    rows = maps.withColumn("size", F.lit(0)).unionByName(zeros).withColumn("block", F.floor(F.col("sid") / BLOCK))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "other").cast("int")).withColumn("high", F.greatest("block", "other").cast("int"))

    def each(key, table):
        lang, _, _, low, high = (k.as_py() for k in key)
        sid, n, p, word, bits, size = (table.column(c).to_numpy() for c in ("sid", "n", "p", "word", "bits", "size"))
        a, b, value = pair_sums(sid.astype(np.int64), n, p, word, bits, int(size.max()), low, high)
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "value": pa.array(value, pa.int64())})

    sums = rows.select("lang", "band", "piece", "low", "high", "sid", "n", "p", "word", "bits", "size").groupBy("lang", "band", "piece", "low", "high").applyInArrow(each, "lang string, a int, b int, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "value", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("s")).select("lang", F.col("s.a").alias("a"), F.col("s.b").alias("b"), "value")
    mine, theirs = (groups.select("lang", F.col("sid").alias(k), F.col("source").alias(name)) for k, name in (("a", "source"), ("b", "item")))
    pairs = both.join(mine, ["lang", "a"]).join(theirs, ["lang", "b"])
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(
        top_terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows for the whole ``documents`` table."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 30),
n AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS (SELECT lang, source, term, n, 1 + ({SCALE}::HUGEINT * (n + 5)) // (sum(n) OVER s + 5 * count(*) OVER s) AS p FROM c WINDOW s AS (PARTITION BY lang, source)),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
q AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (n + 5)) // (sum(n) OVER s + 5 * count(*) OVER s) AS q FROM l WINDOW s AS (PARTITION BY lang)),
f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
a AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM a
QUALIFY part = 'pair' OR rank <= 50
"""
