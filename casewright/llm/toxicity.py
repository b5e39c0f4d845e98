"""Toxicity: a grammar of composed transducers marks matches in clauses; labels give its lexicon and the matches' weights."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage

# Seed words of the classes that labels cannot name, in the corpus' four languages.
THREATS = "kill hurt destroy beat burn stab shoot töten umbringen schlagen sterben verletzen tuer frapper crever mourir matar golpear morir destruir".split()
TARGETS = "you your yours yourself he she they him her them du dich dir dein deine ihr euch tu toi te ton ta vous votre tú ti usted ustedes vosotros".split()
NEGATIONS = "not never no don't isn't nicht kein keine keinen nie niemals pas jamais aucun nunca jamás ningún tampoco".split()
REPORTS = "said says wrote called claimed quoted reported sagte sagt schrieb behauptete dit disait écrit appelé dijo dice escribió llamó".split()
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown".split()

TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.;!?\n]")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
STEMS = (4, 5, 6)


#: A symbol is a class and what is known of it: class + CLASSES * flags.
CLASSES = 7
AIMED, DENIED, TOLD = 1, 2, 4
SYMBOLS = CLASSES * 8


class Transducer:
    """A finite machine from symbols to symbols: step[state][symbol] = (next state, output). State 0 is the start."""

    def __init__(self, step: list[list[tuple[int, int]]]):
        self.step = step

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this machine outputs is what the other reads."""
        n = len(other.step)
        composed = []
        for row in self.step:
            for q in range(n):
                composed.append([(p * n + other.step[q][o][0], other.step[q][o][1]) for p, o in row])
        return Transducer(composed)

    def run(self, symbols: list[int]) -> list[int]:
        state, out, step = 0, [], self.step
        for s in symbols:
            state, o = step[state][s]
            out.append(o)
        return out


def _flagged(symbol: int, flag: int) -> int:
    """An insult or threat with the flag; any other symbol as it is."""
    kind, flags = symbol % CLASSES, symbol // CLASSES
    return kind + CLASSES * (flags | flag) if kind in (INSULT, THREAT) else symbol


def within(mark: int, reach: int, flag: int) -> Transducer:
    """Flags the insults and threats that stand at most ``reach`` symbols after ``mark`` in the same clause."""
    steps = []
    for left in range(reach + 1):
        row = []
        for s in range(SYMBOLS):
            kind = s % CLASSES
            row.append((reach, s) if kind == mark else (0, s) if kind == END else (max(0, left - 1), _flagged(s, flag) if left else s))
        steps.append(row)
    return Transducer(steps)


def since(mark: int, flag: int) -> Transducer:
    """Flags the insults and threats after ``mark`` in the same clause."""
    return Transducer([[(1, s) if s % CLASSES == mark else (0, s) if s % CLASSES == END else (seen, _flagged(s, flag) if seen else s) for s in range(SYMBOLS)] for seen in (0, 1)])


#: Negation, then reported speech, then a target before the match, each reading what the one before wrote.
GRAMMAR = within(NEGATION, 2, DENIED).then(within(REPORT, 5, TOLD)).then(within(TARGET, 4, AIMED))
#: Runs first, from the right: who is aimed at often follows ("kill you").
FROM_RIGHT = since(TARGET, AIMED)
MENACE_W = 1.0
#: The kinds of matches whose weights the calibration learns, by class and flags.
PLAIN, AT, NOT, SAID, BOTH, MENACE, SOFT_MENACE = range(7)
ARC = {INSULT + CLASSES * f: (BOTH if f & DENIED and f & TOLD else NOT if f & DENIED else SAID if f & TOLD else AT if f & AIMED else PLAIN) for f in range(8)}
# a threat counts only with whom it is aimed at
ARC |= {THREAT + CLASSES * f: SOFT_MENACE if f & (DENIED | TOLD) else MENACE for f in range(8) if f & AIMED}
FEATURES = 11


class Lexicon(dict):
    """token -> (symbol, weight), worked out on first sight; forgotten when it grows too large."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], most: int = 400_000):
        super().__init__()
        self.words, self.stems, self.most = words, stems, most
        self.fixed = {w: (k, MENACE_W) for k, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        self.fixed |= {w: (END, 0.0) for w in ".;!?\n"}

    def __missing__(self, token):
        if len(self) > self.most:
            self.clear()
        w = max([self.words.get(token, 0.0), *(self.stems.get(token[:k], 0.0) for k in STEMS if len(token) > k)])
        self[token] = found = (INSULT, w) if w > 0 else self.fixed.get(token)
        return found


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Of a whole text: what its matches of each kind weigh, and its clauses as best, number, density and whether there are any."""
    tokens = TOKEN.findall((text or "").lower())
    symbols = list(map(lexicon.__getitem__, tokens))
    if not any(s is not None and s[0] <= THREAT for s in symbols):
        return [0.0] * FEATURES
    kinds = [s[0] if s else OTHER for s in symbols]
    kinds = GRAMMAR.run(FROM_RIGHT.run(kinds[::-1])[::-1])
    arcs, clause, scores, words = [0.0] * 7, 0.0, [], 0
    for s, kind in zip(symbols, kinds, strict=True):
        words += kind != END
        arc = ARC.get(kind)
        if arc is not None:
            arcs[arc] += s[1]
            clause += s[1] if arc in (PLAIN, AT, MENACE) else 0
        elif kind == END and clause:
            scores.append(clause)
            clause = 0.0
    if clause:
        scores.append(clause)
    if not any(arcs):
        return [0.0] * FEATURES
    return [*map(math.log1p, arcs), max(scores, default=0.0), math.log1p(len(scores)), sum(scores) / math.sqrt(words + 1.0), 1.0]


#: Weights used where the labels do not hold both classes, the constant last; and what the fit leans to where they say little.
DEFAULT = np.array([0.8, 1.2, 0.1, 0.2, 0.1, 1.5, 0.3, 0.5, 0.5, 0.5, 0.0, -4.0])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression, the constant last; none but the constant is negative, and aiming a match never lowers it.

    So a text with a match never scores below one without. A match that is aimed at weighs what a plain one does and a
    part of its own. The ridge pulls towards DEFAULT, so kinds that the labels hardly show keep a weight. Newton steps over
    the weights that may move, cut off at 0 and halved until the likelihood rises.
    """

    def turned(v):
        v = v.copy()
        v[AT] -= v[PLAIN]
        return v

    z = np.column_stack((x, np.ones(len(x))))
    z[:, PLAIN] += z[:, AT]
    prior = turned(DEFAULT)
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-3
    floor = np.zeros(z.shape[1])
    floor[-1] = -np.inf

    def loss(w):
        m = z @ w
        return (np.logaddexp(0, m) - y * m).sum() + 0.5 * (penalty * (w - prior) ** 2).sum()

    w = np.maximum(prior, floor)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        down = z.T @ (p - y) + penalty * (w - prior)
        free = (w > floor) | (down < 0)
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        move = np.zeros(len(w))
        move[free] = -np.linalg.solve(h[np.ix_(free, free)], down[free])
        step, now = 1.0, loss(w)
        while step > 1e-8 and loss(np.maximum(w + step * move, floor)) > now:
            step /= 2
        new = np.maximum(w + step * move, floor)
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    w[AT] += w[PLAIN]
    return w


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _counts(rows: DataFrame) -> DataFrame:
    """feature, pos, neg: in how many toxic and other training texts a word (w:) or the beginning of one (s:) stands."""

    def each(batches):
        table: dict[str, list[int]] = {}

        def flush():
            if table:
                yield pa.RecordBatch.from_arrays([pa.array(list(table)), pa.array([v[0] for v in table.values()], pa.int64()), pa.array([v[1] for v in table.values()], pa.int64())], ["feature", "pos", "neg"])
                table.clear()

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                tokens = {t for t in TOKEN.findall((text.as_py() or "").lower()) if len(t) > 2}
                k = 0 if toxic else 1
                for f in [*("w:" + t for t in tokens), *{"s:" + t[:n] for t in tokens for n in STEMS if len(t) > n}]:
                    table.setdefault(f, [0, 0])[k] += 1
                if len(table) > 300_000:
                    yield from flush()
        yield from flush()

    return rows.select("text", "toxic").mapInArrow(each, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def learn(docs: DataFrame, labels: DataFrame, texts: int = 200_000, sample: int = 20_000, sure: float = 1.0) -> tuple[dict, dict, np.ndarray]:
    """Word weights, stem weights, logistic weights.

    Only labelled rows outside the held-out third count, one of each set of equal texts (the labelled one with the least
    doc_id); of more than ``texts`` of them about that many, by a hash. So their ids are few enough to be broadcast, and no
    text leaves its task. Half of them give the lexicon: all words and beginnings of words with a log-odds of toxicity
    whose lower bound is high. The other half gives the calibration: at most ``sample`` texts, the first by a hash.
    """
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    good = labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labelled = docs.filter("doc_id is not null").select("doc_id", hashed.alias("h")).join(good, "doc_id")
    ids = stage(labelled.groupBy("h").agg(F.min(F.struct("doc_id", "toxic")).alias("m")).select("m.doc_id", "m.toxic", "h"), "tox-ids")
    n = ids.count()
    if n > texts:
        ids = ids.filter(F.pmod(F.xxhash64("h"), F.lit(1_000_000)) < 1_000_000 * texts // n)
    rows = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", hashed.alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    # broadcast: about ``texts`` rows of three numbers at most, whatever the input
    rows = stage(rows.join(F.broadcast(ids), ["doc_id", "h"]).select("text", "toxic", "h"), "tox-rows")
    total = {bool(r["toxic"]): r["n"] for r in rows.filter("h % 2 = 0").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    seeds = {w: 4.0 for w in INSULTS}
    if not total.get(True) or not total.get(False):
        return seeds, {}, DEFAULT
    pos, neg = total[True], total[False]
    up, down = F.col("pos") + 0.5, F.col("neg") + 0.5
    odds = F.log(up / (pos + 1)) - F.log(down / (neg + 1))
    low = odds - sure * F.sqrt(1 / up + 1 / down)
    found = _counts(rows.filter("h % 2 = 0")).select("feature", odds.alias("odds"), low.alias("low")).filter("low > 1.8")
    # at most what ``texts`` texts hold
    found = found.collect()
    lexicon = {k: {r["feature"][2:]: min(6.0, r["odds"]) for r in found if r["feature"].startswith(k)} for k in ("w:", "s:")}
    word, stem = seeds | lexicon["w:"], lexicon["s:"]
    last = ids.filter("h % 2 <> 0").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    some = rows.filter("h % 2 <> 0").filter(F.col("h") <= F.lit(last))
    model = docs.sparkSession.sparkContext.broadcast((word, stem))

    def each(batches):
        lex = Lexicon(*model.value)
        for batch in batches:
            x = [features(t.as_py(), lex) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "toxic", "h"])

    got = some.select("text", F.col("toxic").cast("int"), "h").mapInArrow(each, "x array<double>, toxic int, h long").dropDuplicates(["h"]).collect()
    got.sort(key=lambda r: r["h"])
    y = np.array([r["toxic"] for r in got], float)
    if len(set(y.tolist())) < 2:
        return word, stem, DEFAULT
    return word, stem, fit_logistic(np.array([r["x"] for r in got]), y)


def probabilities(texts: pa.Array, lexicon: Lexicon, weights: np.ndarray) -> np.ndarray:
    """The score of each text."""
    x = np.array([features(t.as_py(), lexicon) for t in texts]).reshape(-1, FEATURES)
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **bounds) -> DataFrame:
    """Every document: doc_id, held_out, score, predicted.

    Scores read the text alone. Null and empty texts, and texts of any length without a match, get the calibrated score
    of a text without matches. Labels that are null, not 0 or 1, or without a document are left out; of labels that
    disagree the toxic one counts; without labels of both kinds the seed words and fixed weights score. Rows are scored
    each, whatever they repeat; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, **bounds))

    def each(batches):
        word, stem, w = model.value
        lex = Lexicon(word, stem)
        for batch in batches:
            p = probabilities(batch.column(2), lex, w)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(each, f"doc_id {kind}, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **bounds) -> DataFrame:
    """The rows whose score (see ``score``) is below the threshold, with all their columns; nothing is shuffled for it."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, **bounds))

    def each(batches):
        word, stem, w = model.value
        lex = Lexicon(word, stem)
        for batch in batches:
            yield batch.filter(pa.array(probabilities(batch.column(batch.schema.get_field_index("text")), lex, w) < threshold))

    return docs.mapInArrow(each, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for the whole ``documents`` table."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
