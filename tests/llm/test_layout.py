"""Nearest neighbours, packing, mixing and the pipeline against plain versions."""

import hashlib
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casewright.llm import ann, mixing, near_dedup, packing, toxicity

from .test_pairs import brute_near

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, uid long, sid long, bucket int, size long"


def frame(spark, rows):
    """Rows (doc_id, text, source) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, "en", len(t or ""), 1, 2, 3, 4) for i, t, s in rows], SCHEMA)


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


# ---- nearest neighbours


def brute_nearest(vectors, queries, k=10):
    out = {}
    for q in queries:
        near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, vectors[q], strict=True))), i) for i, v in vectors.items() if i != q)
        out[q] = near[:k]
    return out


def test_recall_against_brute_force(spark):
    d = "/root/testdata/sf0.1"
    vectors = {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    got = {}
    for r in ann.op2_ann(spark, d).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_nearest(vectors, [i for i in vectors if i % 100 == 0])
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 11)) and [(s, i) for _, i, s in rows] == sorted((s, i) for _, i, s in rows)
        exact = dict((i, s) for s, i in want[q])
        hits += sum(i in exact for _, i, _ in rows)
        for _, i, s in rows:
            assert s == pytest.approx(math.dist(vectors[i], vectors[q]), rel=1e-12)
    assert hits / (10 * len(want)) >= 0.95


def test_vectors_that_take_no_part_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist(), 0) for i in range(1, 30)]
    rows += [(0, [1.0, 0.0, 0.0, 0.0], 0), (100, [0.0] * 4, 0), (200, None, 0), (300, [1.0, None, 0.0, 0.0], 0), (400, [float("nan"), 0.0, 0.0, 1.0], 0), (500, [float("inf"), 0.0, 0.0, 1.0], 0), (None, [1.0, 0.0, 0.0, 0.0], 0), (50, [1.0, 1.0, 0.0, 0.0], 0), (40, [1.0, 1.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    good = {i: [np.float32(x).item() for x in v] for i, v, _ in rows if i is not None and v is not None and None not in v and all(map(math.isfinite, v)) and any(v)}
    got = [(r.rank, r.vec_id, r.score) for r in ann.search(df).orderBy("query_id", "rank").collect()]
    assert [(i, pytest.approx(s)) for s, i in brute_nearest(good, [0])[0]] == [(i, s) for _, i, s in got]
    few = ann.search(df.filter("vec_id in (0, 40, 50)")).collect()
    assert [(r.rank, r.vec_id) for r in few] == [(1, 40), (2, 50)]
    assert ann.search(df.limit(0)).collect() == [] and ann.search(df.filter("vec_id in (100, 200)")).collect() == []


def test_vectors_of_another_length_change_nothing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    more = [(100, rng.normal(size=12).tolist()), (200, [None] * 40), (3, rng.normal(size=2).tolist()), (300, [])]
    out = [sorted(map(tuple, ann.search(spark.createDataFrame(r, "vec_id long, embedding array<double>")).collect())) for r in (rows, rows + more)]
    assert out[0] == out[1] and len(out[0]) == 10
    # repeated ids: the nearest counts; a block of queries meets every lot of codes
    twice = rows + [(7, [9.0] * 6), (7, rows[0][1])]
    got = ann.search(spark.createDataFrame(twice, "vec_id long, embedding array<double>"), lots=3).orderBy("rank").collect()
    assert (got[0].vec_id, got[0].score) == (7, 0.0) and sum(r.vec_id == 7 for r in got) == 1


def test_recall_on_a_table_far_larger_than_the_sample(spark):
    """A third of the rows in one tight group; the codebooks see a tenth of all."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 32)).astype(np.float32)
    x[:7_000] = x[0] + 0.01 * rng.normal(size=(7_000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, sample=2_000).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    x = x.astype(np.float64)
    hit = {True: [], False: []}
    for q in range(0, 20_000, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit[q < 7_000].append(len(set(np.argsort(d, kind="stable")[:10].tolist()) & set(got[q])) / 10)
    assert np.mean(hit[True]) >= 0.9 and np.mean(hit[False]) >= 0.9


def test_beam_search_lowers_the_error():
    x = np.random.default_rng(0).normal(size=(4000, 16)).astype(np.float32)
    coarse, books = ann.fit(x, stages=4)

    def error(beam):
        c, scale, codes, norm = ann.encode(x, coarse, books, beam=beam)
        made = coarse[c] + scale[:, None] * sum(books[m][codes[:, m]] for m in range(4))
        assert np.allclose((made**2).sum(1), norm, rtol=1e-4)
        return ((made - x) ** 2).sum()

    assert error(8) < error(1)


# ---- packing


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))


def test_bounds_pad_least():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.integers(1, 9))
        lengths = sorted(rng.choice(60, n, replace=False).tolist())
        counts = rng.integers(1, 50, n).tolist()
        for buckets in (1, 2, 3, 12):
            got = packing.best_bounds(lengths, counts, [a * b for a, b in zip(lengths, counts, strict=True)], buckets)
            best = min(padding(lengths, counts, [*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], min(buckets, n) - 1))
            assert len(got) <= buckets and padding(lengths, counts, got) == best


def check_packed(rows, sizes, budget):
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in rows) == sorted(sizes)
    batches = {}
    for r in rows:
        assert r.n_tokens <= r.bucket_len
        batches.setdefault(r.batch_id, []).append(r)
    for b in batches.values():
        assert len({(r.bucket, r.bucket_len) for r in b}) == 1
        assert sorted(r.slot for r in b) == list(range(len(b)))
        assert len(b) == 1 or len(b) * max(1, b[0].bucket_len) <= budget
    return batches


def test_batches_hold_every_document_once(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(0, 300)), None) for i in range(200)] + [(7, "w w", None), (7, "w w", None), (None, "w", None), (900, None, None), (901, "", None), (902, "w " * 70_000, None)]
    got = packing.pack(frame(spark, rows), budget=1000, spread=20).collect()
    batches = check_packed(got, [(-1 if i is None else i, n_words(t)) for i, t, _ in rows], 1000)
    full = sum(len(b) == max(1, 1000 // max(1, b[0].bucket_len)) for b in batches.values())
    assert full >= 0.4 * len(batches)
    assert packing.pack(frame(spark, [])).collect() == []


def test_a_table_is_padded_the_least(spark):
    """A plain dynamic programme over all lengths, long ones too, gives no less padding than the packed table has."""
    rng = np.random.default_rng(8)
    sizes = [int(n) for n in np.exp(rng.uniform(0, 9, 120))]
    got = packing.pack(frame(spark, [(i, "w " * n, None) for i, n in enumerate(sizes)]), buckets=5).collect()
    lengths = sorted(set(sizes))
    best = {(-1, 0): 0}
    for k in range(1, 6):
        for j in range(k - 1, len(lengths)):
            best[j, k] = min(best[i, k - 1] + sum(lengths[j] - n for n in sizes if (i < 0 or n > lengths[i]) and n <= lengths[j]) for i in range(-1, j) if (i, k - 1) in best)
    assert sum(r.bucket_len - r.n_tokens for r in got) == min(best[len(lengths) - 1, k] for k in range(1, 6))
    assert {r.bucket_len for r in got} <= set(lengths)


@pytest.mark.parametrize("doc", [None, 7])
def test_rows_without_id_or_of_one_id_are_dealt_over_lots(spark, doc):
    rows = [(doc, "w " * (i % 5), None) for i in range(200)]
    got = packing.pack(frame(spark, rows), buckets=1, budget=40, spread=20).collect()
    check_packed(got, [(-1 if doc is None else doc, n_words(t)) for _, t, _ in rows], 40)
    assert len({r.batch_id.split("-")[1] for r in got}) == 10


# ---- mixing


def brute_mix(rows, block):
    """(doc_id, source) -> size, source_size, target, taken, first slot, slots that begin it, by a plain reading of the contract and the schedule."""
    sources = sorted({s for _, _, s in rows if s is not None}) + ([None] if any(s is None for _, _, s in rows) else [])
    size = {s: sum(n_words(t) for _, t, x in rows if x == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, left, share = {}, set(sources), 1.5 * sum(size.values())
    while left:
        level = (share - sum(target.values())) / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] > 2 * size[s]}
        if not full:
            target |= {s: level * weight[s] for s in left}
            break
        target |= {s: 2.0 * size[s] for s in full}
        left -= full
    out = {}
    total, parts, low = sum(target.values()), [], 0
    for s in sources:
        if target[s] > 0:
            parts.append([s, low, math.floor(sum(target[x] for x in sources[: sources.index(s) + 1]) / total * 2**31)])
            low = parts[-1][2]
    if parts:
        parts[-1][2] = 2**31
    slots = {s: [] for s in sources}
    for i in range(math.ceil(total / block)):
        u = i * 1327217885 % 2**31
        slots[next(s for s, lo, hi in parts if lo <= u < hi)].append(i)
    for s in sources:
        at, take = 0, min(len(slots[s]) * block, 2 * size[s])
        md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
        for i, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: (md5("?" + (r[1] or "")) if r[0] is None else md5(str(r[0])), r[0] or -1)):
            n = n_words(t)
            lots = [(p * size[s] + at, min(take, p * size[s] + at + n)) for p in (0, 1) if n and p * size[s] + at < take]
            out[i, s] = (n, size[s], target[s], sum(b - a for a, b in lots), slots[s][lots[0][0] // block] if lots else None, [slots[s][a // block] for a, _ in lots])
            at += n
    return out


def mix_rows():
    rng = np.random.default_rng(6)
    rows = [(i, "w " * int(rng.integers(0, 90)), ["a", "b", "c", "d", "ä", None, "Z"][int(rng.choice(7, p=[0.4, 0.05, 0.25, 0.1, 0.1, 0.05, 0.05]))]) for i in range(150)]
    return rows + [(200, None, "a"), (201, "", "b"), (202, "w " * 5000, "c"), (203, None, "empty"), (None, "w w w", "d")]


def test_mix_equals_plain_version(spark):
    rows = mix_rows()
    got = mixing.mix(frame(spark, rows), block=16).collect()
    want = brute_mix(rows, 16)
    assert len(got) == len(rows)
    for r in got:
        n, source_size, target, taken, slot, starts = want[r.doc_id, r.source]
        assert (r.size, r.source_size, r.taken, r.slot, r.starts) == (n, source_size, taken, slot, starts) and r.target == pytest.approx(target)
        assert r.taken <= 2 * r.size
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3 * 16
    assert sorted(map(str, mixing.mix(frame(spark, rows), block=16).collect())) == sorted(map(str, got))
    assert mixing.mix(frame(spark, [])).collect() == []


def test_another_order_of_points_gives_another_mix(spark, monkeypatch):
    rows = mix_rows()
    one = {(r.doc_id, r.source): (r.taken, r.slot) for r in mixing.mix(frame(spark, rows), block=16).collect()}
    monkeypatch.setattr(mixing, "GOLDEN", 5)
    two = {(r.doc_id, r.source): (r.taken, r.slot) for r in mixing.mix(frame(spark, rows), block=16).collect()}
    assert sum(one[k][0] != two[k][0] for k in one) > 0 and sum(one[k][1] != two[k][1] for k in one) > len(rows) // 2


def test_schedule_keeps_every_prefix_near_the_weights(spark):
    s = spark.createDataFrame([(1, 5000.0, 9e9), (2, 2000.0, 9e9), (3, 1000.0, 300.0), (4, 0.0, 0.0)], "sid int, target double, full double")
    slots, take = mixing.schedule(spark, s, 10)
    slots, take = slots.orderBy("slot").collect(), {r.sid: r["take"] for r in take.collect()}
    assert len(slots) == 800 and [r.slot for r in slots] == list(range(800))
    for k in (1, 2, 3):
        assert [r["rank"] for r in slots if r.sid == k] == list(range(sum(r.sid == k for r in slots)))
    assert abs(take[1] - 5000) <= 30 and abs(take[2] - 2000) <= 30 and take[3] == 300
    for n in range(20, len(slots), 60):
        for k, share in ((1, 5 / 8), (2, 2 / 8), (3, 1 / 8)):
            assert abs(sum(r.sid == k for r in slots[:n]) - share * n) <= 4


def test_mixing_stage_counts_rows_by_their_place(spark, tmp_path):
    rows = [(1, "a b c", "s"), (1, "d e f g h", "s"), (1, "a b c", "s"), (None, "x y z", "s"), (None, "u v", "s"), (2, None, "s")]
    df = frame(spark, rows).withColumns({"__id": F.lit(1), "__file": F.lit("f"), "doc": F.lit(2), "__slot": F.lit(3), "starts": F.lit(4)})
    df.write.parquet(f"{tmp_path}/docs")
    for docs in (df, spark.read.parquet(f"{tmp_path}/docs")):
        got = mixing.mixing_stage(spark, docs, "")
        assert got.columns == docs.columns
        texts = [r.text for r in got.collect()]
        # 16 words in all, 24 in the mix: one block of 64 and twice the source at most, so every text is begun twice
        assert sorted(texts) == sorted(t for _, t, _ in rows if t for _ in range(2))


# ---- pipeline


def test_each_stage_equals_its_plain_version(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    key = lambda r: (r.doc_id, r.text, r.source, r.lang, r.n_chars)
    steps = dict(corpus_pipeline.STAGES)

    bad = {r.doc_id for r in toxicity.score(docs, labels).filter("predicted = 1").collect()}
    clean = steps["toxicity"](spark, docs, sf_dir)
    assert clean.columns == docs.columns
    assert sorted(map(key, clean.collect())) == sorted(key(r) for r in docs.collect() if r.doc_id not in bad)

    rows = clean.collect()
    last = {}
    for r in rows:
        last[r.text or ""] = max(last.get(r.text or "", -1), r.doc_id)
    single = steps["exact_dedup"](spark, clean, sf_dir)
    assert single.columns == docs.columns
    assert sorted(map(key, single.collect())) == sorted(key(r) for r in rows if last[r.text or ""] == r.doc_id)

    rows = single.collect()
    want = brute_near([r.doc_id for r in rows], [r.text for r in rows], 5, 80)
    apart = steps["near_dedup"](spark, single, sf_dir)
    assert apart.columns == docs.columns
    assert sorted(map(key, apart.collect())) == sorted(key(r) for r in rows if want[r.doc_id][1] == r.doc_id)

    rows = apart.collect()
    plan = {(i, s): v[5] for (i, s), v in brute_mix([(r.doc_id, r.text, r.source) for r in rows], mixing.BLOCK).items()}
    mixed = steps["mixing"](spark, apart, sf_dir)
    assert mixed.columns == docs.columns
    assert sorted(map(key, mixed.collect())) == sorted(key(r) for r in rows for _ in plan[r.doc_id, r.source])
    order = [min(plan[r.doc_id, r.source]) for r in mixed.collect()]
    assert sum(a > b for a, b in zip(order, order[1:])) < len(order) // 2
    by = {}
    for r in mixed.collect():
        by[r.source] = by.get(r.source, 0) + n_words(r.text)
    target = {r.source: (r.target, r.source_size) for r in mixing.mix(apart).collect()}
    longest = max(n_words(r.text) for r in rows)
    assert all(abs(by.get(s, 0) - t) <= longest + 3 * mixing.BLOCK for s, (t, _) in target.items())

    packed = steps["packing"](spark, mixed, sf_dir).collect()
    check_packed(packed, [(r.doc_id, n_words(r.text)) for r in mixed.collect()], 16_384)
    assert sorted((r.doc_id, r.text) for r in packed) == sorted((r.doc_id, r.text) for r in mixed.collect())


def test_batches_keep_the_order_of_the_files(spark, tmp_path):
    rows = [(k % 7 if k % 5 else None, "w " * (k % 11), "s") for k in range(300)]
    frame(spark, rows).coalesce(2).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    got = packing.pack(docs, buckets=3, budget=40, spread=25, in_order=True).collect()
    check_packed(got, [(-1 if i is None else i, n_words(t)) for i, t, _ in rows], 40)
    assert len({(r.file, r.row) for r in got}) == 300
    lots = {}
    for r in sorted(got, key=lambda r: (r.file, r.row)):
        lots.setdefault((r.file, r.row // 25, r.bucket), []).append((int(r.batch_id.split("-")[2]), r.slot))
    assert all(v == sorted(v) for v in lots.values())



def test_stages_of_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        out = step(spark, docs, sf_dir)
        assert out.collect() == []
        docs = docs.sparkSession.createDataFrame([], docs.schema)


def test_near_stage_keeps_clean_documents(spark, sf_dir):
    rows = [(i, f"w{i} x{i} y{i} z{i} q{i} r{i}", "s") for i in range(20)] + [(50, None, "s"), (51, "", "s"), (None, "only one", "s")]
    assert near_dedup.near_dedup_stage(spark, frame(spark, rows), sf_dir).count() == len(rows)


def test_scratch_deletes_what_was_staged_within(spark, tmp_path):
    import os

    from casewright.llm import common, exact_dedup

    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with common.scratch(spark):
        exact_dedup.exact_dedup_stage(spark, frame(spark, [(1, "a", "s"), (2, "a", "s")]), "").write.parquet(f"{tmp_path}/out")
        assert set(os.listdir(folder)) - before
    assert set(os.listdir(folder)) <= before
    assert [r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [2]
    kept = common.stage(frame(spark, [(1, "a", "s")]), "kept")
    with common.scratch(spark):
        pass
    assert kept.count() == 1
