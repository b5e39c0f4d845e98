"""Conversation structure repair: an auction for shortest paths over the lattice of edits, whose prices expose the tight arcs."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keyed, stage

#: Rows of a conversation that one task solves at a time; longer conversations are cut and their pieces composed.
SEGMENT = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLANKS = "\t\n\x0b\x0c\r "
FAR = 1 << 60
# States of what has been given so far: nothing, an opening system turn, a user turn last, an assistant turn last.
STATES, ACCEPTING = 4, (0, 3)
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_WANTED = (("u", 2), ("u", 2), ("a", 3), ("u", 2))
_LEGAL = {"su", "ua", "au"}


def damage(rows: DataFrame) -> DataFrame:
    """The contract's damage by crc32(``conv_id:turn``) modulo 20; a null counts as one space, but stays null in conv_id and turn.

    0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 gives it to the user.
    """
    told = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fate = F.crc32(F.concat(told[0], F.lit(":"), told[1])) % 20
    role = F.when(F.col("fate") == 4, F.lit("user")).otherwise(told[2])
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.translate(told[3], ".!?", "")).otherwise(told[3])
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, F.lit(2)).otherwise(F.lit(1))))
    return rows.withColumn("fate", fate).filter("fate <> 0").withColumns({"role": role, "text": text}).withColumn("time", times).drop("fate", "time")


def lattice(faces: str, faults: str, last: bool) -> list[list[tuple[int, int, str]]]:
    """Arcs (cost, node, edit) of every node 4 * row + state; edits: D, K, U and A (given to user, assistant), u and a (inserted).

    At the end of a piece nothing is inserted, as that node is the next piece's first; the end of a conversation allows it.
    """
    arcs: list[list[tuple[int, int, str]]] = []
    for i, (face, fault) in enumerate(zip(faces, faults, strict=True)):
        more = TRUNCATED if fault == "t" else 0
        for s in range(STATES):
            who, to = _WANTED[s]
            out = [(DELETE, 4 * i + 4 + s, "D"), (INSERT, 4 * i + to, who)]
            if fault not in "bd":
                then = _NEXT.get((s, face))
                if then is not None:
                    out.append((KEEP + more, 4 * i + 4 + then, "K"))
                if then != to:
                    out.append((REROLE + more, 4 * i + 4 + to, who.upper()))
            arcs.append(out)
    n = len(faces)
    return arcs + [[(INSERT, 4 * n + _WANTED[s][1], _WANTED[s][0])] if last else [] for s in range(STATES)]


def auction(arcs: list[list[tuple[int, int, str]]], exits: tuple[int, ...]) -> list[int]:
    """Prices of all nodes, with the end's at 0: the least cost from each node to one of the exits among the last states; FAR if there is none.

    Prices start at 0 and never exceed an arc's cost plus the price of its end. From an origin a path is extended along a
    tight arc; where none is tight, the last node's price rises to the least that its arcs offer and the path contracts
    by it. Origins are taken from the last row back and keep the prices of those before, so a path ends as soon as it
    meets a node that is known to be tight up to the end.
    """
    end = len(arcs)
    reach = 1 if exits == (0,) else 2 if exits == (1,) else STATES
    go = [[(c, j) for c, j, _ in out if j % 4 < reach] for out in arcs]
    for e in exits:
        go[end - 4 + e].append((0, end))
    price = [0] * end + [0]
    done = [False] * end + [True]
    for row in range(end - 4, -1, -4):
        for origin in range(row, row + reach):
            path = [origin]
            while not done[path[-1]]:
                i = path[-1]
                best, to = FAR, -1
                for c, j in go[i]:
                    if c + price[j] < best:
                        best, to = c + price[j], j
                if price[i] < best:
                    price[i] = best
                    if len(path) > 1:
                        path.pop()
                    elif best == FAR:
                        break
                else:
                    path.append(to)
            for i in path:
                done[i] = True
    for s in range(reach, STATES):
        for i in range(s, end, 4):
            price[i] = FAR
    return price


def trace(arcs: list[list[tuple[int, int, str]]], price: list[int], entry: int, exits: tuple[int, ...]) -> tuple[str, list[str]]:
    """Of the paths along tight arcs the one whose edits' initials (D, I, K, R) are the least, and the edits at each row: what is inserted before it, its own, and after the last row what is inserted there."""
    node, audit, at, acts = entry, [], "", []
    end = len(arcs)
    while True:
        tight = [("I" if x in "ua" else "R" if x in "UA" else x, j, x) for c, j, x in arcs[node] if price[j] < FAR and price[node] == c + price[j]]
        if not tight or node >= end - 4 and node - (end - 4) in exits and price[node] == 0:
            break
        letter, node, edit = min(tight)
        audit.append(letter)
        at += edit
        if letter != "I":
            acts.append(at)
            at = ""
    if at:
        acts[-1] += at
    return "".join(audit), acts


def _exits(exit_: int) -> tuple[int, ...]:
    return ACCEPTING if exit_ < 0 else (exit_,)


def spans(segments: DataFrame) -> DataFrame:
    """Costs of each piece from each first to each last state (FAR if impossible; the conversation's end counts as one), and the exits' order by their least edits."""

    def each(batches):
        for batch in batches:
            costs, orders = [], []
            for faces, faults, first, last in zip(*(batch.column(c).to_pylist() for c in ("faces", "faults", "first", "last")), strict=True):
                arcs = lattice(faces, faults, last)
                prices = [auction(arcs, _exits(e)) for e in ((-1,) if last else range(STATES))]
                entries = range(1 if first else STATES)
                costs.append([[p[s] for p in prices] for s in entries])
                edits = [[trace(arcs, p, s, _exits(e))[0] if p[s] < FAR else "~" for e, p in enumerate(prices)] if not last else [""] for s in entries]
                orders.append([[sorted(x).index(y) for y in x] for x in edits])
            kind = pa.list_(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("seg"), pa.array(costs, kind), pa.array(orders, kind)], ["key", "seg", "costs", "orders"])

    return segments.mapInArrow(each, "key string, seg long, costs array<array<long>>, orders array<array<long>>")


def routes(spans: DataFrame) -> DataFrame:
    """key, seg, entry, exit: through which states the cheapest repair, and of those the least, leads from piece to piece."""

    def each(batches):
        for batch in batches:
            out = []
            for key, pieces in zip(batch.column("key").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
                left: list[list[int]] = [[0]]
                for p in reversed(pieces):
                    left.append([min(c + v for c, v in zip(row, left[-1], strict=True)) for row in p["costs"]])
                left.reverse()
                entry = 0
                for k, p in enumerate(pieces):
                    row, ahead = p["costs"][entry], left[k + 1]
                    ends = [e for e, c in enumerate(row) if c + ahead[e] == left[k][entry]]
                    exit_ = min(ends, key=lambda e: p["orders"][entry][e])
                    out.append((key, p["seg"], entry, exit_ if k + 1 < len(pieces) else -1))
                    entry = exit_
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int32()))], ["key", "seg", "entry", "exit"])

    whole = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("seg", "costs", "orders"))).alias("pieces"))
    return whole.mapInArrow(each, "key string, seg long, entry int, exit int")


def edits(segments: DataFrame) -> DataFrame:
    """Each piece's cost, pairs of neighbours that may not follow each other, initials of its edits, and edits by row."""

    def each(batches):
        for batch in batches:
            out = []
            for faces, faults, before, last, entry, exit_ in zip(*(batch.column(c).to_pylist() for c in ("faces", "faults", "before", "last", "entry", "exit")), strict=True):
                arcs = lattice(faces, faults, last)
                price = auction(arcs, _exits(exit_))
                row = (before or "") + faces
                out.append((price[entry], sum(row[i : i + 2] not in _LEGAL for i in range(len(row) - 1)), *trace(arcs, price, entry, _exits(exit_))))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "seg", "uid")), *(pa.array([r[c] for r in out], t) for c, t in enumerate(kinds))], ["key", "seg", "uid", "cost", "illegal", "audit", "acts"])

    return segments.mapInArrow(each, "key string, seg long, uid long, cost long, illegal long, audit string, acts array<string>")


def applied(rows: DataFrame, acts: DataFrame) -> DataFrame:
    """key, place, role, text, edit (K, R, I) of the repaired conversations, in order within each partition; a row and its edits meet in a sort, none is held longer."""
    both = rows.select("key", "uid", "role", "text", F.lit(None).cast("string").alias("act")).unionByName(acts.select("key", "uid", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "act"))
    both = both.repartition("key").sortWithinPartitions("key", "uid", F.col("act").isNull())
    names = {"u": "user", "a": "assistant"}

    def each(batches):
        key, place, act = None, 0, ""
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]

            def put(*row, out=out):
                for column, x in zip(out, row, strict=True):
                    column.append(x)

            for k, role, text, found in zip(*(batch.column(c).to_pylist() for c in ("key", "role", "text", "act")), strict=True):
                if found is not None:
                    act = found
                    continue
                if k != key:
                    key, place = k, 0
                for x in act:
                    if x in names:
                        put(key, place, names[x], "", "I")
                    elif x != "D":
                        put(key, place, role if x == "K" else names[x.lower()], text, "K" if x == "K" else "R")
                    place += x != "D"
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if c == 1 else pa.string()) for c, x in enumerate(out)], ["key", "place", "role", "text", "edit"])

    return both.mapInArrow(each, "key string, place long, role string, text string, edit string")


def digests(repaired: DataFrame) -> DataFrame:
    """key and sha256 of the ``role:text`` lines of each conversation, read as a stream in the order in which applied() gives them."""

    def each(batches):
        key, digest = None, hashlib.sha256()
        for batch in batches:
            out = []
            for k, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "place", "role", "text")), strict=True):
                if k != key:
                    if key is not None:
                        out.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256()
                digest.update(("\n" * (place > 0) + f"{role}:{text}").encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.string()) for c in (0, 1)], ["key", "repaired_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["key", "repaired_sha256"])

    return repaired.mapInArrow(each, "key string, repaired_sha256 string")


def named(conv_id) -> F.Column:
    """A key that tells a null from every id."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def repair(rows: DataFrame, ties: tuple[str, ...] = (), segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Faults and cheapest edits of every conversation, and the repaired rows.

    The first table has a row for each conversation: conv_id, key, gaps, blank, duplicate, truncated, illegal, cost, audit; the
    second has key, place, role, text, edit (see applied()). Rows stand by turn, nulls first, equal turns by role and text
    in UTF-8 order. Each row's first fault counts; what must go or cost more, and the edits, are those of the contract.
    Null ids form one conversation; null roles and texts count as one space; roles other than system, user and assistant
    go by their first letter. Equal texts are told by SHA-256. Texts are read whole, of any length; repeated rows are
    duplicates after the first; an empty table gives empty results; further columns do not matter.

    One sort of the whole table numbers the rows, so a conversation of many rows is spread over tasks (``ties`` names
    columns that spread equal rows too) and solved in pieces of ``segment`` rows. Per conversation only the costs between
    pieces' ends meet, and the letters of its edits, which its row holds anyway; repaired texts pass as a sorted stream.
    """
    told = [F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")]
    sorted_ = rows.select(named(F.col("conv_id")).alias("key"), "conv_id", "turn", *told, *ties).orderBy("key", F.col("turn").asc_nulls_first(), "role", "text", *ties)
    placed = stage(sorted_.select("key", "conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("uid")), "talk-rows")

    trimmed = F.rtrim("text", F.lit(BLANKS))
    seen = placed.select("key", "turn", "uid", "role", F.sha2("text", 256).alias("digest"), (trimmed == "").alias("blank"), F.substring(trimmed, -1, 1).alias("mark"), F.substring("role", 1, 1).alias("face"))
    seen = stage(seen, "talk-seen")
    first = seen.groupBy("key", "role", "digest").agg(F.min("uid").alias("uid")).select("uid", F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), "b").when(F.col("new").isNull(), "d").when(~F.col("mark").isin(".", "!", "?"), "t").otherwise("-")
    face = F.when(F.col("face").isin("s", "u", "a"), F.col("face")).otherwise("x")
    faults = stage(seen.join(first, "uid", "left").select("key", "turn", "uid", face.alias("face"), fault.alias("fault")), "talk-faults")

    line = Window.partitionBy("key").orderBy("seg")
    letters = {c: F.array_join(F.col(f"rows.{c}"), "") for c in ("face", "fault")}
    pieces = faults.groupBy("key", F.floor(F.col("uid") / segment).alias("seg")).agg(F.sort_array(F.collect_list(F.struct("uid", "face", "fault"))).alias("rows"))
    pieces = pieces.select("key", "seg", F.col("rows")[0]["uid"].alias("uid"), letters["face"].alias("faces"), letters["fault"].alias("faults"))
    pieces = stage(pieces.select("*", F.lag(F.substring("faces", -1, 1)).over(line).alias("before"), F.lead("seg").over(line).isNull().alias("last")).withColumn("first", F.col("before").isNull()), "talk-pieces")
    ways = routes(spans(pieces.filter("NOT (first AND last)")))
    solved = pieces.join(ways, ["key", "seg"], "left").na.fill({"entry": 0, "exit": -1})
    solved = stage(edits(solved), "talk-edits")

    stats = faults.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *(F.count_if(F.col("fault") == f).alias(name) for f, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))))
    whole = solved.groupBy("key").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    acts = solved.select("key", "uid", F.posexplode("acts").alias("k", "act")).select("key", (F.col("uid") + F.col("k")).alias("uid"), "act")
    ids = placed.groupBy("key").agg(F.first("conv_id").alias("conv_id"))
    return ids.join(stats, "key").join(whole, "key"), applied(placed, acts)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for the whole ``conversations`` table, damaged as it says; conversations that lose all rows too."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = keyed(table, "talk-input").select(*(F.col(f"doc.{c}").alias(c) for c in ("conv_id", "turn", "role", "text")), "__file", "__row")
    found, repaired = repair(damage(rows), ("__file", "__row"))
    every = table.select("conv_id").distinct().withColumn("key", named(F.col("conv_id")))
    counted = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    out = every.join(found.drop("conv_id"), "key", "left").join(digests(repaired), "key", "left")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counted), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
