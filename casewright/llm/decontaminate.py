"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, scanned over every text, each hit verified by its bytes."""

from __future__ import annotations

from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, mix, powers, stage, text_slices

WIDTH = 10
#: What one broadcast holds at most: pairs of a window and an item, and bytes of their words. Larger benchmarks are cut into blocks.
PAIRS, BYTES = 200_000, 32 << 20
#: Bits of the hash that the first look at a window reads.
LOOK = 22
_RNG = np.random.Generator(np.random.PCG64(1013))
_BYTE = _RNG.integers(0, 2**64, 256, np.uint64)
_PLACE = _RNG.integers(0, 2**63, 1 << 12, np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes, first and last+1 byte of each word, each word's hash, and the first word of each text (one more entry than texts)."""
    low = _LOWER[data]
    n = len(low)
    if not n:
        none = np.zeros(0, np.int64)
        return low, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inner = _INSIDE[low]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inner & (~np.concatenate(([False], inner[:-1])) | cut[:n]))
    ends = np.flatnonzero(inner & (~np.concatenate((inner[1:], [False])) | cut[1:])) + 1
    up, down = powers(n)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[low] * up[:n], dtype=np.uint64)))
    return low, starts, ends, mix((total[ends] - total[starts]) * down[starts]), np.searchsorted(starts, offsets)


def runs_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        out += hashes[k : k + len(out)] * _PLACE[k]
    return mix(out + np.uint64(n))


def windows(benchmark: DataFrame, width: int) -> DataFrame:
    """n, hash, body and item of every window of the items: distinct pairs of a window and an item."""

    def told(batches):
        for batch in batches:
            for lo, data, offsets in text_slices(batch.column(1)):
                low, starts, ends, hashes, first = words(data, offsets)
                by_n = {n: runs_of(hashes, n).view(np.int64) for n in {min(width, k) for k in np.diff(first).tolist() if k}}
                for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    n, item = min(width, b - a), batch.column(0)[lo + k].as_py()
                    text = [low[s:e].tobytes() for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                    for i in range(b - a - n + 1 if n else 0):
                        yield n, int(by_n[n][a + i]), b" ".join(text[i : i + n]), item

    def each(batches):
        rows = told(batches)
        while some := list(islice(rows, 20_000)):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.string()), strict=True)], ["n", "hash", "body", "item"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return items.mapInArrow(each, "n int, hash long, body binary, item string").distinct()


class HashSet:
    """The windows of one block by length: sorted hashes, bytes and items; ``look`` tells fast what cannot be in it."""

    def __init__(self, rows):
        self.by_n: dict[int, tuple] = {}
        for n in sorted({r.n for r in rows}):
            found: dict[tuple[int, bytes], set[str]] = {}
            for r in rows:
                if r.n == n:
                    found.setdefault((r.hash & (1 << 64) - 1, bytes(r.body)), set()).add(r.item)
            keys = sorted(found)
            hashes = np.array([h for h, _ in keys], np.uint64)
            look = np.zeros(1 << LOOK, bool)
            look[hashes >> np.uint64(64 - LOOK)] = True
            self.by_n[n] = (hashes, np.packbits(look), [body for _, body in keys], [found[k] for k in keys])

    def scan(self, low, starts, ends, hashes, first):
        """Which words stand in an occurrence of a window, and the windows (length, number) that occur in each text."""
        hit = np.zeros(len(hashes) + 1, np.int64)
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        seen: dict[int, set[tuple[int, int]]] = {}
        for n, (known, look, bodies, _) in self.by_n.items():
            grams = runs_of(hashes, n)
            top = grams >> np.uint64(64 - LOOK)
            at = np.flatnonzero((look[top >> np.uint64(3)] >> (np.uint8(7) - (top & np.uint64(7)).astype(np.uint8))) & 1)
            at = at[owner[at] == owner[at + n - 1]]
            left = np.searchsorted(known, grams[at])
            same = (left < len(known)) & (known[np.minimum(left, len(known) - 1)] == grams[at])
            for i, k in zip(at[same].tolist(), left[same].tolist(), strict=True):
                body = b" ".join([low[s:e].tobytes() for s, e in zip(starts[i : i + n].tolist(), ends[i : i + n].tolist(), strict=True)])
                h = known[k]
                while k < len(known) and known[k] == h:
                    if bodies[k] == body:
                        hit[i] += 1
                        hit[i + n] -= 1
                        seen.setdefault(int(owner[i]), set()).add((n, k))
                    k += 1
        return np.cumsum(hit[:-1]) > 0, seen


SPAN = "array<struct<first:int,last:int,start:int,end:int>>"
FOUND = f"n_words int, n_hit int, items array<string>, spans {SPAN}"


def _found(counts, runs, items) -> list[pa.Array]:
    """The columns of FOUND."""
    at = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32))
    flat = np.array([x for r in runs for x in r], np.int32).reshape(-1, 4)
    spans = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(4)], ["first", "last", "start", "end"]))
    return [pa.array(counts, pa.int32()), pa.array([sum(b - a for a, b, _, _ in r) for r in runs], pa.int32()), pa.array([sorted(i) for i in items], pa.list_(pa.string())), spans]


def scan(rows: DataFrame, block) -> DataFrame:
    """rows (``text`` and others) without the text, and what one block of windows finds in it."""
    carried = [c for c in rows.columns if c != "text"]

    def each(batches):
        known = block.value
        for batch in batches:
            rest = batch.select(carried)
            for lo, data, offsets in text_slices(batch.column("text")):
                low, starts, ends, hashes, first = words(data, offsets)
                hit, seen = known.scan(low, starts, ends, hashes, first)
                n = len(offsets) - 1
                runs: list[list[tuple]] = [[] for _ in range(n)]
                for k in seen:
                    a, b = int(first[k]), int(first[k + 1])
                    turns = np.flatnonzero(np.diff(np.concatenate(([0], hit[a:b], [0])))).tolist()
                    runs[k] = [(i, j, int(starts[a + i] - offsets[k]), int(ends[a + j - 1] - offsets[k])) for i, j in zip(turns[::2], turns[1::2], strict=True)]
                items = [set().union(*(known.by_n[m][3][w] for m, w in seen.get(k, ()))) for k in range(n)]
                part = rest.slice(lo, n)
                yield pa.RecordBatch.from_arrays([*part.columns, *_found(np.diff(first), runs, items)], [*carried, "n_words", "n_hit", "items", "spans"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema.fields)
    return rows.mapInArrow(each, f"{head}, {FOUND}")


def merged(parts: DataFrame) -> DataFrame:
    """One row per document of what several blocks found: runs of words joined, items told once."""
    keys = ["__file", "__row"]
    per = parts.groupBy(*keys).agg(F.max("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def each(batches):
        for batch in batches:
            runs = []
            for spans in batch.column("spans").to_pylist():
                out: list[list[int]] = []
                for s in spans:
                    if out and s["first"] <= out[-1][1]:
                        if s["last"] > out[-1][1]:
                            out[-1][1], out[-1][3] = s["last"], s["end"]
                    else:
                        out.append([s["first"], s["last"], s["start"], s["end"]])
                runs.append(out)
            yield pa.RecordBatch.from_arrays([batch.column("__file"), batch.column("__row"), *_found(batch.column("n_words"), runs, batch.column("items").to_pylist())], [*keys, "n_words", "n_hit", "items", "spans"])

    return per.mapInArrow(each, f"__file string, __row long, {FOUND}")


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, pairs: int = PAIRS, size: int = BYTES) -> DataFrame:
    """Every document (``doc``, a struct of its columns but text) with the benchmark's words in it.

    Words are runs of ASCII letters, digits and anything beyond ASCII, A-Z lower-cased. An item's windows are its runs of
    ``width`` words; a shorter item that has words is one window. n_words; n_hit (words inside an occurrence of a window);
    items (ids, as strings, of the items with occurring windows, sorted); spans (maximal runs of hit words: first and last
    + 1 word, start and end byte).

    The windows are broadcast only in blocks of at most about ``pairs`` pairs and ``size`` bytes; a benchmark of one block
    is searched in one scan without a shuffle, a larger one in a scan per block whose finds meet by the document's place.
    Null texts have no words; items without an id count as one item, written ''; rows that repeat an id are documents of
    their own, of benchmark items one item. Texts are read whole, of any length. Without benchmark rows nothing is hit;
    an empty table gives an empty result. Further columns stay in ``doc``, whatever their names.
    """
    spark = docs.sparkSession
    known = stage(windows(benchmark, width), "leak-windows")
    n, octets = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()
    blocks = max(1, -(-n // pairs), -(-octets // size))
    part = F.pmod(F.xxhash64("hash", "item"), F.lit(blocks))

    def block(k: int):
        return spark.sparkContext.broadcast(HashSet(known.filter(part == k).collect()))

    kept = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c != "text"]
    if blocks == 1:
        return scan(docs.select(F.struct(*kept).alias("doc"), F.col("text").cast("string").alias("text")), block(0))
    rows = keyed(docs, "leak-docs").select("__file", "__row", F.col("doc.text").cast("string").alias("text"), F.col("doc").dropFields("text").alias("doc"))
    places = rows.select("__file", "__row", "text")
    parts = reduce(DataFrame.unionByName, [scan(places, block(k)).filter("n_hit > 0") for k in range(1, blocks)], scan(places, block(0)))
    return rows.select("__file", "__row", "doc").join(merged(parts), ["__file", "__row"]).drop("__file", "__row")


def clean(docs: DataFrame, benchmark: DataFrame, documents: bool = False, width: int = WIDTH) -> DataFrame:
    """The documents without what the benchmark holds: its spans cut out of their texts, or, with ``documents``, no hit document.

    All columns stay; what a span cuts out is the bytes from its first to its last word. Other rows are as in find().
    """
    found = find(docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("whole"), "text"), benchmark, width).select(F.col("doc.whole").alias("whole"), "n_hit", "spans")
    if documents:
        return found.filter("n_hit = 0").select("whole.*")
    body = F.col("whole.text").cast("binary")
    # the pieces before each span, and what is left after the last
    pieces = F.transform(F.sequence(F.lit(0), F.size("spans")), lambda i: F.substring(
        body, F.when(i == 0, F.lit(0)).otherwise(F.get("spans", i - 1)["end"]) + 1,
        F.coalesce(F.get("spans", i)["start"], F.octet_length(F.col("whole.text"))) - F.when(i == 0, F.lit(0)).otherwise(F.get("spans", i - 1)["end"])).cast("string"))
    text = F.when(F.col("n_hit") == 0, F.col("whole.text")).otherwise(F.array_join(pieces, ""))
    return found.select(F.col("whole").withField("text", text).alias("whole")).select("whole.*")


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for the whole ``documents`` and ``benchmark`` tables."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find(docs.select("doc_id", "text"), bench).select(
        "doc.doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
k AS (SELECT DISTINCT item, least({WIDTH}, len(w)) AS n, array_to_string(w[i : i + least({WIDTH}, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
h AS (SELECT r, i, n, item FROM (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n)) JOIN k USING (n, win)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
