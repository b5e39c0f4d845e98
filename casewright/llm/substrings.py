"""Substring dedup: every byte covered by a long string that also starts elsewhere."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _P, drop, mix, powers, stage, text_slices
from .induce import suffixes

_RNG = np.random.Generator(np.random.PCG64(41))
_B1, _B2 = _RNG.integers(0, 2**64, 256, np.uint64), _RNG.integers(0, 2**64, 256, np.uint64)
_P2 = 0x9FB21C651E98DF25
_P2U = np.uint64(_P2)


class Rolling:
    """Hashes of any piece of some bytes, from running sums of random byte values times powers."""

    def __init__(self, data: np.ndarray, table: np.ndarray, base: int):
        up, self.down = powers(len(data), base)
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(table[data] * up[: len(data)], dtype=np.uint64)))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.total[hi] - self.total[lo]) * self.down[lo] + (hi - lo).astype(np.uint64))


def least_in_windows(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of each run of ``width`` keys."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _anchors(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, length: int, gram: int):
    """Anchors at data[lo:hi]: text number, position in data, ends of the context, two hashes."""
    n = len(data) - gram + 1
    start = np.concatenate([np.arange(max(a, lo - length), min(b - length + 1, hi)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)] or [np.zeros(0, np.int64)])
    if len(data) < length or not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z, z
    one, two = Rolling(data, _B1, _P), Rolling(data, _B2, _P2)
    at = np.arange(n)
    keys = (one.of(at, at + gram) >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64)
    spot = (least_in_windows(keys, length - gram + 1)[start] & np.uint64((1 << 24) - 1)).astype(np.int64)
    # the strings of one anchor start one after the other
    first = np.flatnonzero(np.concatenate(([True], spot[1:] != spot[:-1])))
    left, right, spot = start[first], start[np.append(first[1:], len(start)) - 1] + length, spot[first]
    here = (spot >= lo) & (spot < hi)
    left, right, spot = left[here], right[here], spot[here]
    text = np.searchsorted(offsets, spot, "right") - 1
    # the context's hash also tells where in it the anchor stands
    context = two.of(left, right) ^ mix((spot - left).astype(np.uint64) + _P2U)
    return text, spot, left, right, one.of(spot, spot + gram).view(np.int64), context.view(np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, piece: int = 1 << 23):
    """Anchors of some texts: text number, position, ends of the context (in the text), hash of the anchor and of the context.

    The anchor of a string of ``length`` bytes is, of its pieces of ``gram`` bytes, the one whose hash is least (the first
    of equals), so equal strings have equal anchors at equal places. The context is what the strings with that anchor
    cover; each string is of one context. A text longer than ``piece`` is taken in overlapping pieces.
    """
    if len(data) <= piece:
        parts = [(*_anchors(data, offsets, 0, len(data), length, gram), 0)]
    else:
        parts = []
        for t, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            for at in range(a, b, piece):
                lo, hi = max(a, at - length), min(b, at + piece + 2 * length)
                got = _anchors(data[lo:hi], np.array([0, hi - lo]), at - lo, at - lo + piece, length, gram)
                parts.append((got[0] + t, *got[1:], lo))
    whole = [np.concatenate(c) for c in zip(*[(p[0], p[1] + p[6], p[2] + p[6], p[3] + p[6], p[4], p[5]) for p in parts], strict=True)]
    first = offsets[whole[0]]
    whole[1:4] = [c - first for c in whole[1:4]]
    return whole


def repeated_runs(parts: list[bytes], length: int):
    """Strings of some contexts that also start elsewhere in them: context number, first and last start (in the context).

    The contexts' suffixes are sorted by induction; strings that are neighbours in that order and have ``length`` bytes in
    common are equal, byte by byte.
    """
    order, common = suffixes(parts, length)
    equal = common >= length
    twice = np.zeros(len(order), bool)
    twice[order[equal | np.append(equal[1:], False)]] = True
    ends = np.cumsum([len(x) + 1 for x in parts])
    hit = np.flatnonzero(twice)
    which = np.searchsorted(ends, hit, "right")
    inside = hit + length < ends[np.minimum(which, len(ends) - 1)]
    hit, which = hit[inside], which[inside]
    cut = np.flatnonzero(np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (which[1:] != which[:-1]))))[: len(hit)]
    last = np.append(cut[1:], len(hit))[: len(cut)] - 1
    c = which[cut]
    begin = ends[c] - np.array([len(x) + 1 for x in parts])[c]
    return c, hit[cut] - begin, hit[last] - begin


def _digest(text: F.Column) -> F.Column:
    return F.xxhash64("doc_id", text)


def mark(docs: DataFrame, length: int = 400, gram: int | None = None, hot: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Two staged tables: the documents with what their anchors show, and the runs that open contexts repeat (see remove)."""
    gram = gram or max(1, length * 8 // 25)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), text.alias("text")).withColumn("u", _digest(F.col("text")))

    def each(batches):
        for batch in batches:
            for lo, data, offsets in text_slices(batch.column(2)):
                t, pos, left, right, a, c = anchors(data, offsets, length, gram)
                rows = pa.array(t + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(pos), pa.array((pos - left).astype(np.int16)), pa.array((right - pos).astype(np.int16)), pa.array(a), pa.array(c)], ["u", "d", "pos", "left", "right", "a", "c"])

    every = stage(keyed.filter(F.octet_length("text") >= length).select("u", "d", "text").mapInArrow(each, "u long, d long, pos long, left short, right short, a long, c long"), "sub-anchors")
    seen = stage(every.groupBy("a").agg(F.count("*").alias("n"), (F.min("c") != F.max("c")).alias("mixed")).filter("n > 1").drop("n"), "sub-seen")
    shared = stage(every.join(seen, "a"), "sub-shared")
    drop(every, seen)
    # contexts that stand at several places are repeated as a whole; one of each stands for all where others differ
    same = stage(shared.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("u", "d", "pos")).alias("one"), F.first("mixed").alias("mixed")).filter("n > 1").drop("n"), "sub-same")
    alone = shared.filter("mixed").join(same.select("a", "c"), ["a", "c"], "left_anti")
    # only groups with a context that stands alone are open
    open_a = stage(alone.groupBy("a").agg(F.count("*").alias("singles")), "sub-open")
    heads = same.filter("mixed").select("a", F.col("one.u").alias("u"), F.col("one.d").alias("d"), F.col("one.pos").alias("pos"))
    size = heads.groupBy("a").agg(F.count("*").alias("more"))
    open_a = stage(open_a.join(size, "a", "left").select("a", (F.col("singles") + F.coalesce("more", F.lit(0)) > hot).alias("hot")), "sub-groups")
    info = shared.join(same.select("a", "c", F.lit(True).alias("whole")), ["a", "c"], "left").filter("whole or mixed")
    info = info.join(heads.select("u", "d", "pos", F.lit(True).alias("head")), ["u", "d", "pos"], "left")
    info = info.select("u", "d", "pos", "left", "right", F.when(F.col("whole").isNull() | F.col("head"), F.col("a")).alias("ask"), F.coalesce("whole", F.lit(False)).alias("whole"))
    info = info.groupBy("u", "d").agg(F.collect_set(F.struct("pos", "left", "right", "ask", "whole")).alias("info"))
    joined = keyed.join(info, ["u", "d"], "left").withColumn("n_bytes", F.octet_length("text").cast("long"))
    joined = stage(joined.select("doc_id", "u", "d", "n_bytes", "info", F.when(F.col("info").isNotNull(), F.col("text")).alias("text"), F.when(F.col("info").isNull(), F.sha2(F.col("text").cast("binary"), 256)).alias("kept_sha256")), "sub-joined")
    asked = joined.filter("info is not null").dropDuplicates(["u", "d"]).select("u", "d", F.col("text").cast("binary").alias("text"), F.filter("info", lambda i: i["ask"].isNotNull()).alias("info")).filter(F.size("info") > 0)
    asked = asked.select("u", "d", F.inline(F.transform("info", lambda i: F.struct(i["ask"].alias("a"), (i["pos"] - i["left"]).alias("first"), F.substr(F.col("text"), (i["pos"] - i["left"] + 1).cast("int"), (i["left"] + i["right"]).cast("int")).alias("bytes")))))
    contexts = stage(asked.join(open_a, "a"), "sub-contexts")

    def resolve(batches):
        held, amount, at = [], 0, None

        def flush():
            if held:
                u, d, first, parts = zip(*held, strict=True)
                u, d, first = np.array(u, np.int64), np.array(d, np.int64), np.array(first, np.int64)
                c, lo, hi = repeated_runs(parts, length)
                yield pa.RecordBatch.from_arrays([pa.array(u[c]), pa.array(d[c]), pa.array(first[c] + lo), pa.array(first[c] + hi + length)], ["u", "d", "lo", "hi"])

        for batch in batches:
            for a, u, d, first, part in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if a != at and amount > 1 << 19:
                    yield from flush()
                    held, amount = [], 0
                at = a
                held.append((u, d, first, part))
                amount += len(part)
        yield from flush()

    cold = contexts.filter("not hot").select("a", "u", "d", "first", "bytes")
    # a task sorts about 4 MB of contexts
    tasks = max(1, min(20_000, (cold.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0) >> 22))
    runs = cold.repartition(tasks, "a").sortWithinPartitions("a").mapInArrow(resolve, "u long, d long, lo long, hi long")
    hot_rows, every_window = contexts.filter("hot"), None
    if not hot_rows.isEmpty():

        def windows(batches):
            for batch in batches:
                u, d, first = (batch.column(k).to_numpy() for k in range(3))
                for lo, data, offsets in text_slices(batch.column(3)):
                    one, two = Rolling(data, _B1, _P), Rolling(data, _B2, _P2)
                    sizes = np.maximum(offsets[1:] - offsets[:-1] - length + 1, 0)
                    which = np.repeat(np.arange(len(sizes)), sizes)
                    inner = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    at = offsets[which] + inner
                    for k in range(0, len(at), 50_000):
                        w, x, i = at[k : k + 50_000], which[k : k + 50_000] + lo, inner[k : k + 50_000]
                        yield pa.RecordBatch.from_arrays([pa.array(one.of(w, w + length).view(np.int64)), pa.array(two.of(w, w + length).view(np.int64)), pa.array(u[x]), pa.array(d[x]), pa.array(first[x] + i)], ["w1", "w2", "u", "d", "lo"])

        every_window = stage(hot_rows.select("u", "d", "first", "bytes").mapInArrow(windows, "w1 long, w2 long, u long, d long, lo long"), "sub-windows")
        place = F.xxhash64("u", "d", "lo")
        twice = stage(every_window.groupBy("w1", "w2").agg(F.min(place).alias("p"), F.max(place).alias("q")).filter("p <> q").select("w1", "w2"), "sub-twice")
        found = every_window.join(twice, ["w1", "w2"]).select("u", "d", "lo").distinct()
        line = Window.partitionBy("u", "d").orderBy("lo")
        found = found.withColumn("run", F.col("lo") - F.row_number().over(line)).groupBy("u", "d", "run").agg(F.min("lo").alias("lo"), (F.max("lo") + length).alias("hi"))
        runs = runs.unionByName(found.select("u", "d", "lo", "hi"))
    runs = stage(runs.groupBy("u", "d").agg(F.collect_set(F.struct("lo", "hi")).alias("runs")), "sub-runs")
    drop(shared, same, open_a, contexts)
    if every_window is not None:
        drop(every_window, twice)
    return joined, runs


def remove(docs: DataFrame, length: int = 400) -> DataFrame:
    """Every document without the bytes that a string of ``length`` bytes covers which also starts anywhere else.

    Texts count as UTF-8 bytes, null as empty. Strings are judged on the input and never reach over two documents;
    overlapping ones count. Texts shorter than ``length`` keep everything. Rows that repeat each other are documents that
    repeat each other, so their long strings go. Returns doc_id, n_bytes, n_removed, n_spans (maximal runs removed),
    kept_sha256, kept (the remaining bytes; null where nothing was removed).
    """
    joined, runs = mark(docs, length)
    whole = joined.filter("info is null").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256", F.lit(None).cast("binary").alias("kept"))
    spans = F.transform(F.filter("info", lambda i: i["whole"]), lambda i: F.struct((i["pos"] - i["left"]).alias("lo"), (i["pos"] + i["right"]).alias("hi")))
    cut = joined.filter("info is not null").join(runs, ["u", "d"], "left").select("doc_id", "n_bytes", F.sort_array(F.concat(spans, F.coalesce("runs", F.array().cast("array<struct<lo:bigint,hi:bigint>>")))).alias("spans"), "text")
    cut = cut.select("doc_id", "n_bytes", F.transform("spans", lambda s: s["lo"]).alias("lo"), F.transform("spans", lambda s: s["hi"]).alias("hi"), "text")

    def each(batches):
        for batch in batches:
            out = []
            lows, highs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for lo, hi, text in zip(lows, highs, batch.column(4).cast(pa.binary()), strict=True):
                text, kept, at, end, removed, n = text.as_py(), [], 0, -1, 0, 0
                for a, b in zip(lo, hi, strict=True):
                    if a > end:
                        kept.append(text[at:a])
                        n += 1
                        at = a
                    removed += max(0, b - max(a, end))
                    end = max(end, b)
                    at = end
                kept.append(text[at:])
                kept = b"".join(kept)
                out.append((removed, n, hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]] if out else [batch.column(0), batch.column(1), *[pa.array([], t) for t in (pa.int64(), pa.int64(), pa.string(), pa.binary())]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return whole.unionByName(cut.mapInArrow(each, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for the whole ``documents`` table."""
    return remove(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
