"""Benchmark decontamination against a plain version."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from casewright.llm import decontaminate

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LINE = "one two three four five six seven eight nine ten eleven twelve"
BENCH = [(1, LINE), (2, "Short   ITEM-here"), (3, ""), (None, "nobody owns it"), (5, None), (12, "zero " + LINE), (1, "again the first one"), (7, "über Äpfel ÄPFEL")]
DOCS = [
    (1, LINE + "."), (2, f"x {LINE.upper()} y"), (3, LINE.replace("nine", "nein")), (4, None), (5, ""), (6, "...!?"), (7, "short item here, SHORT item: here"), (8, "a nobody owns it z"),
    (9, "zero one two\nthree four five six seven eight nine ten eleven twelve " * 3), (9, "again the first one"), (None, "again THE first\tone two"), (10, "ÜBER äpfel äpfel über äpfel Äpfel"), (11, "über Äpfel ÄPFEL"),
    (12, "w " * 30_000 + LINE + " w" * 30_000), (13, "short item hereafter"), (14, "item here short item"),
]


def tokens(text):
    return [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))]


def brute(docs, bench):
    wins = set()
    for item, text in bench:
        w = [t[0] for t in tokens(text)]
        n = min(10, len(w))
        wins |= {("" if item is None else str(item), tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n}
    by = {}
    for item, w in wins:
        by.setdefault(w, set()).add(item)
    out = []
    for doc, text in docs:
        t = tokens(text)
        w = [x[0] for x in t]
        hit, items = set(), set()
        for n in {len(x) for x in by}:
            for i in range(len(w) - n + 1):
                if found := by.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    items |= found
        kept, at = "", 0
        for i in sorted(hit):
            if i - 1 not in hit:
                kept += text[at : t[i][1]]
            at = t[i][2]
        kept = text if not hit else kept + text[at:]
        out.append((doc, len(w), len(hit), sorted(items), kept))
    return out


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("pairs", [200_000, 4])
def test_finds_what_a_plain_search_finds(spark, pairs):
    docs = spark.createDataFrame([(d, t, "n", 3, "s") for d, t in DOCS], "doc_id long, text string, items string, __row int, spans string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = decontaminate.find(docs, bench, pairs=pairs).select("doc.doc_id", "n_words", "n_hit", "items", "doc.items").collect()
    assert all(r[4] == "n" for r in got)
    assert order((r[0], r[1], r[2], list(r[3])) for r in got) == order(x[:4] for x in brute(DOCS, BENCH))


def test_cuts_spans_or_documents(spark):
    docs = spark.createDataFrame([(d, t, "n", "w") for d, t in DOCS], "doc_id long, text string, spans string, whole string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    cut = decontaminate.clean(docs, bench)
    assert cut.columns == docs.columns
    want = brute(DOCS, BENCH)
    assert order(tuple(r) for r in cut.select("doc_id", "text").collect()) == order((x[0], x[4]) for x in want)
    left = decontaminate.clean(docs, bench, documents=True)
    assert order(tuple(r) for r in left.select("doc_id", "text").collect()) == order((x[0], x[4]) for x in want if not x[2])


def test_empty_tables_and_colliding_hashes(spark, monkeypatch):
    docs, bench = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(BENCH, "item_id long, text string")
    assert decontaminate.find(docs.limit(0), bench).count() == 0
    assert decontaminate.find(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    rows = decontaminate.windows(bench, 10).collect()
    known = decontaminate.HashSet([type(r)(**(r.asDict() | {"hash": 7})) for r in rows])
    low, starts, ends, hashes, first = decontaminate.words(*_arrays(LINE))
    monkeypatch.setattr(decontaminate, "runs_of", lambda h, n: (h[: max(0, len(h) - n + 1)] * 0) + 7)
    hit, seen = known.scan(low, starts, ends, hashes, first)
    assert hit.all() and {i for n, k in seen[0] for i in known.by_n[n][3][k]} == {"1", "12"}


def _arrays(text):
    import numpy as np

    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def test_digest_columns(spark, sf_dir):
    got = decontaminate.op13_decontaminate(spark, sf_dir).collect()
    docs, bench = (list(map(tuple, spark.read.parquet(f"{sf_dir}/{t}.parquet").select(k, "text").collect())) for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = [(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i, _ in brute(docs, bench)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert any(x[5] for x in want)
