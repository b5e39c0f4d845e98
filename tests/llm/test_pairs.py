"""Near dedup, exact dedup and substring dedup against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from casewright.llm import components, exact_dedup, near_dedup, substrings

SCHEMA = "doc_id long, text string, source string, n long, id long, key string"


def frame(spark, texts, ids=None):
    """Documents with further columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, 7, 7, "k") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def words(rng, n):
    return [rng.choice("abcdefghij") + rng.choice("klmnopqrst") + str(rng.randrange(40)) for _ in range(n)]


def near_texts():
    rng = random.Random(5)
    texts = [" ".join(words(rng, n)) for n in (60, 200, 40, 3, 4)]
    base = words(rng, 90)
    for k in range(90):  # a cloud of copies, many of them too far from each other
        w = list(base)
        for _ in range(k % 9):
            w[rng.randrange(len(w))] = "x" + str(rng.randrange(10**6))
        texts.append(" ".join(w))
    chain = words(rng, 80)
    for k in range(8):  # each a link to the next, the ends far apart
        texts.append(" ".join(chain[4 * k : 4 * k + 60]))
    texts += [texts[0], texts[0].upper(), None, "", " \n ", "one", "one", "ONE two", "a b c", "A b\tc", "a b c d"]
    return texts


def brute_near(ids, texts, width, percent):
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        w = [x.decode() for x in (t or "").encode().lower().split()]
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_groups_equal_brute_force(spark, width, percent):
    texts = near_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(frame(spark, texts), width, percent).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute_near(range(len(texts)), texts, width, percent).items()}


def test_open_buckets_are_searched_in_blocks(spark):
    rng = random.Random(8)
    base, texts = words(rng, 60), []
    for _ in range(60):
        w = list(base)
        for _ in range(4):
            w[rng.randrange(60)] = "y" + str(rng.randrange(30))
        texts.append(" ".join(w))
    sets = near_dedup.full_sets(frame(spark, texts), spark.range(60).toDF("doc_id"), 3)
    b = spark.range(60).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("doc_id"), F.col("id").alias("label"), F.lit(0).cast("long").alias("main"))
    links = near_dedup.open_links(b, sets, 85, block=7).collect()
    want = brute_near(range(60), texts, 3, 85)
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        x, y = root(r.a), root(r.b)
        parent[max(x, y)] = min(x, y)
    assert [root(i) for i in range(60)] == [want[i][1] for i in range(60)]


def test_near_rows_without_id_and_empty_tables(spark):
    got = near_dedup.near_groups(frame(spark, ["a b c", "a b c", "a b c"], [None, 4, 4])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (4, 4, True), (4, 4, True)]
    assert near_dedup.near_groups(frame(spark, [])).collect() == []


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(30)]
    got = {r.id: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in parent if x not in alone}


@pytest.mark.parametrize("files", [None, 1])
def test_exact_groups(spark, files):
    texts = ["a", "b", "a", None, "", "A", "a ", "b", "x" * 200_000, "x" * 200_000]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.dedup(frame(spark, texts).repartition(3), files).collect()}
    assert got == {i: (max(k for k, u in enumerate(texts) if (u or "") == (t or "")), sum((u or "") == (t or "") for u in texts), i == max(k for k, u in enumerate(texts) if (u or "") == (t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in enumerate(texts)}


def test_a_text_that_comes_again_and_again_is_never_called_several(spark):
    """Eight files, one at a trigger, so copies arrive in every batch: no digest stands for several texts."""
    rows = frame(spark, [f"t{k % 3}" for k in range(64)]).repartition(8)
    members, groups = exact_dedup.classes(rows, 1)
    assert members.filter("other IS NOT NULL").count() == groups.filter("other IS NOT NULL").count() == 0
    assert {(r.top.doc_id, r.group_size) for r in groups.collect()} == {(63, 22), (61, 21), (62, 21)}


def test_a_column_may_be_called_like_the_files_metadata(spark, tmp_path):
    spark.createDataFrame([(k, f"one two three four {k % 2}", f"m{k}") for k in range(4)], "doc_id long, text string, _metadata string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for stage in (exact_dedup.exact_dedup_stage, near_dedup.near_dedup_stage):
        kept = stage(spark, docs, "")
        assert kept.columns == docs.columns and sorted(r._metadata for r in kept.collect()) == (["m2", "m3"] if stage is exact_dedup.exact_dedup_stage else ["m0", "m1"])


def test_exact_rows_without_id_and_empty_tables(spark):
    got = exact_dedup.dedup(frame(spark, ["a", "a", "c"], [None, 3, None])).collect()
    assert sorted((r.text_sha256[:4], r.doc_id or -1, r.kept) for r in got) == sorted([(hashlib.sha256(b"a").hexdigest()[:4], -1, False), (hashlib.sha256(b"a").hexdigest()[:4], 3, True), (hashlib.sha256(b"c").hexdigest()[:4], -1, True)])
    assert exact_dedup.dedup(frame(spark, [])).collect() == []


@pytest.mark.parametrize("files", [None, 1])
def test_a_digest_of_several_texts_is_split(spark, files):
    texts = ["a", "b", "a", None, "", "c", "b", "d" * 50, "d" * 50, "a"]
    for weak in (lambda body: F.lit(b"same").cast("binary"), lambda body: F.substring(F.unhex(F.sha2(body, 256)), 1, 0)):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(frame(spark, texts).repartition(3), files, weak).collect()}
        last = {t or "": i for i, t in enumerate(texts)}
        assert got == {i: (last[t or ""], sum((t or "") == (u or "") for u in texts), last[t or ""] == i) for i, t in enumerate(texts)}


def test_stages_keep_one_row_of_repeated_and_null_ids(spark, tmp_path):
    long = "one two three four five six seven eight"
    rows = frame(spark, ["a", "a", "c", "b", "b", "d", long, long, "b", None, ""], [None, 3, None, 4, 4, 4, 5, 5, 3, None, None])
    rows.repartition(2).write.parquet(f"{tmp_path}/docs")
    for docs in (rows, spark.read.parquet(f"{tmp_path}/docs")):
        exact = exact_dedup.exact_dedup_stage(spark, docs, "")
        assert exact.columns == docs.columns
        got = [(r.doc_id, r.text or "") for r in exact.collect()]
        assert sorted(got, key=repr) == sorted([(3, "a"), (None, "c"), (4, "b"), (4, "d"), (5, long), (None, "")], key=repr)
        near = near_dedup.near_dedup_stage(spark, docs, "")
        got = [(r.doc_id, r.text or "") for r in near.collect()]
        assert sorted(got, key=repr) == sorted([(3, "a"), (None, "c"), (3, "b"), (4, "d"), (5, long), (None, ""), (None, "")], key=repr)


def brute_substrings(texts, length):
    docs = [(t or "").encode() for t in texts]
    seen, twice = set(), set()
    for b in docs:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            (twice if w in seen else seen).add(w)
    out = []
    for b in docs:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if b[k : k + length] in twice:
                gone[k : k + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def substring_texts():
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    passage, other = text(130), text(70)
    texts = [text(300), text(40) + passage + text(50), passage + text(30), text(90) + passage, text(10) + passage[:100] + text(20), other * 3, "z" * 200, "ab" * 90, text(500), None, "", "short", passage, passage]
    for k in range(20):  # one passage in many texts, whose edges differ
        texts.append(text(30 + k) + passage[k : 60 + 3 * k] + text(25))
    return [*texts, texts[0], texts[8][100:300] + texts[0][:150]]


@pytest.mark.parametrize("hot", [4096, 2])
def test_substrings_equal_brute_force(spark, hot):
    texts = substring_texts()
    joined, runs = substrings.mark(frame(spark, texts), 60, 20, hot)
    assert joined.count() == len(texts)
    original, substrings.mark = substrings.mark, lambda d, n: original(d, n, 20, hot)
    try:
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove(frame(spark, texts), 60).collect()}
    finally:
        substrings.mark = original
    assert got == dict(enumerate(brute_substrings(texts, 60)))


def test_substrings_of_repeated_rows_and_empty_tables(spark):
    rows = frame(spark, ["q" + "abcdefghij" * 3] * 2, [None, None])
    assert [(r.doc_id, r.n_removed) for r in substrings.remove(rows, 20).collect()] == [(None, 31), (None, 31)]
    assert substrings.remove(frame(spark, []), 20).collect() == []


def test_long_texts_are_cut_into_overlapping_pieces():
    import numpy as np

    rng = np.random.default_rng(0)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    whole = substrings.anchors(data, np.array([0, 5000]), 60, 20)
    pieces = substrings.anchors(data, np.array([0, 5000]), 60, 20, piece=700)
    for a, b in zip(whole, pieces, strict=True):
        assert (a == b).all()
