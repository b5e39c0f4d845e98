"""Conversation repair and the divergence audit against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import pairwise

import pytest
from pyspark.sql import Row

from casewright.llm import conversations, divergence

# ---- conversations

WHITE = "\t\n\x0b\x0c\r "


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(WHITE)
        out.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def brute_repair(rows):
    """Least (cost, initials) over all edits, by relaxation of every state after every row, and the repaired lines."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    faults = faults_of(rows)
    best = {"": (0, "", ())}

    def insert(best):
        for _ in range(3):
            for s, (c, e, lines) in list(best.items()):
                who = "a" if s == "u" else "u"
                new = (c + 5, e + "I", (*lines, ("user" if who == "u" else "assistant") + ":"))
                if who not in best or new[:2] < best[who][:2]:
                    best[who] = new

    for (role, text), fault in zip(rows, faults, strict=True):
        insert(best)
        then = {}
        for s, (c, e, lines) in best.items():
            ways = [(c + 2, e + "D", s, lines)]
            if fault not in "bd":
                more = 5 * (fault == "t")
                if (s, role[:1]) in step:
                    ways.append((c + more, e + "K", step[s, role[:1]], (*lines, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if (s, name[0]) in step:
                        ways.append((c + 1 + more, e + "R", name[0], (*lines, f"{name}:{text}")))
            for c2, e2, s2, l2 in ways:
                if s2 not in then or (c2, e2) < then[s2][:2]:
                    then[s2] = (c2, e2, l2)
        best = then
    insert(best)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def brute_row(rows):
    """rows: (turn, role, text) after damage, in order."""
    f = faults_of([r[1:] for r in rows])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairwise(rows))
    cost, audit, lines = brute_repair([r[1:] for r in rows])
    return gaps, f.count("b"), f.count("d"), f.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def brute_damage(table):
    """conv_id -> rows after damage, in order."""
    out = {}
    for conv, turn, role, text in table:
        rows = out.setdefault(conv, [])
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        rows += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    for rows in out.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


COUNTED = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def told(rows):
    return {r.conv_id: tuple(r[c] for c in COUNTED) for r in rows}


def test_query_equals_a_plain_repair(spark, sf_dir):
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = told(conversations.op11_conversations(spark, sf_dir).collect())
    assert got == {c: brute_row(rows) for c, rows in brute_damage(table).items()}
    assert len({g[6] for g in got.values()}) > 5


def odd_table():
    rng = random.Random(5)
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", None, "Usher", "agent"]
    texts = ["Yes.", "No!", "open end", "", " \n", None, "Why? ", "é…", "What?\x0b", "Yes."]
    table = [(c, rng.choice([None, *range(n)]), rng.choice(roles), rng.choice(texts)) for c in range(60) for n in [rng.randint(1, 14)] for _ in range(n)]
    table += [(None, t, "user", "Nobody's.") for t in (1, None, 1)] + [(100, k, "user", "same.") for k in range(40)] + [(101, 3, "assistant", "same.")] * 40
    table += [(102, k, "au"[k % 2] + "x", "long " * 40_000 + f"{k}.") for k in range(3)] + [(103, k, ["user", "assistant"][k % 2], f"{k}.") for k in range(200)]
    return table


@pytest.mark.parametrize("segment", [4096, 3])
def test_odd_rows_whole_and_in_pieces(spark, tmp_path, segment, monkeypatch):
    monkeypatch.setattr(conversations.repair, "__defaults__", ((), segment))
    table = odd_table()
    df = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in table], "conv_id long, turn long, role string, text string, key string, uid long, act string, fate string")
    df.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = told(conversations.op11_conversations(spark, str(tmp_path)).collect())
    want = {c: brute_row(rows) for c, rows in brute_damage(table).items()}
    assert got.keys() == want.keys()
    assert [(c, got[c], want[c]) for c in want if got[c] != want[c]] == []


def test_repaired_rows_and_empty_table(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Well?"), (1, 3, "assistant", "Yes."), (2, 0, "assistant", "Me.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found, repaired = conversations.repair(df)
    assert {r.conv_id: (r.cost, r.audit) for r in found.collect()} == {1: (2, "KDKK"), 2: (2, "D")}
    lines = sorted((r.key, r.place, r.role, r.text, r.edit) for r in repaired.collect())
    assert lines == [("=1", 0, "system", "Be kind.", "K"), ("=1", 1, "user", "Well?", "K"), ("=1", 2, "assistant", "Yes.", "K")]
    found, repaired = conversations.repair(df.limit(0))
    assert found.count() == repaired.count() == 0


def test_auction_prices_are_least_costs():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 9)
        faces, faults = "".join(rng.choice("suax") for _ in range(n)), "".join(rng.choice("---tbd") for _ in range(n))
        for last, exits in ((True, (0, 3)), (False, (0,)), (False, (1,)), (False, (2,)), (False, (3,))):
            arcs = conversations.lattice(faces, faults, last)
            cost = [conversations.FAR] * len(arcs)
            for e in exits:
                cost[len(arcs) - 4 + e] = 0
            for _ in range(len(arcs)):
                for i in reversed(range(len(arcs))):
                    cost[i] = min([cost[i], *(c + cost[j] for c, j, _ in arcs[i] if cost[j] < conversations.FAR)])
            assert conversations.auction(arcs, exits)[:-1] == cost


# ---- divergence


def brute_audit(docs, least, top):
    terms = [(lang or "", source or "", [m.lower() if m.isascii() else "".join(c.lower() if c.isascii() else c for c in m) for m in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in docs]
    out = []
    for lang in {x[0] for x in terms}:
        has = Counter(t for la, _, ws in terms if la == lang for t in set(ws))
        kept = sorted(t for t, n in has.items() if n >= least)

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        counts = {s: Counter(t for la, s2, ws in terms if (la, s2) == (lang, s) for t in ws) for s in {x[1] for x in terms if x[0] == lang}}
        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s]
            best = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, rows, most in (("pair", pairs, len(pairs)), ("term", best, top)):
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(sorted(rows, key=lambda x: (-x[0], x[1].encode()))[:most])]
    return sorted(out)


def odd_docs():
    rng = random.Random(9)
    words = ["The", "the", "café", "Éa", "x1y", "don't", "日本", "zip", "😀b", "q"] + [f"w{chr(97 + k)}" for k in range(26)]
    docs = [(rng.choice(["en", "de", None, ""]), rng.choice([*"abc", None, ""]), " ".join(rng.choices(words, k=rng.randint(0, 40)))) for _ in range(150)]
    return docs + [("en", "hot", "zip " * 50_000), ("fr", "a", None), ("fr", "b", "seul"), ("fr", None, ""), ("en", "none", "123 ...")] + [("de", "rep", "the the")] * 5


@pytest.mark.parametrize("piece, block, held", [(512, 64, 400_000), (7, 2, 20)])
def test_audit_equals_plain_counts(spark, monkeypatch, piece, block, held):
    for name, value in (("PIECE", piece), ("BLOCK", block), ("HELD", held)):
        monkeypatch.setattr(divergence, name, value)
    docs = odd_docs()
    df = spark.createDataFrame([(*d, "t", 1, "v", 2) for d in docs], "lang string, source string, text string, term string, n long, band string, p long").repartition(3)
    got = sorted(map(tuple, divergence.audit(df, least=6, top=4).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == brute_audit(docs, 6, 4)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_shares_are_exact_for_huge_counts(spark):
    df = spark.createDataFrame([Row(n=30_000_000_000_000, total=90_000_000_000_007, v=12_345)])
    assert df.select(divergence.share("n", "total")).first()[0] == 1 + 10**9 * 30_000_000_000_005 // (90_000_000_000_007 + 5 * 12_345)
