"""PII spans: fixed base patterns, and boosted trees over overlapping candidates that add spans (DataFrame functions only)."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage

# Each finds the same leftmost, non-overlapping matches as the plain pattern in the comment, without its backtracking:
# a match starts where a run starts or the previous match ended (\G), and loops never give back what they took.
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    # [0-9]([\x20-]?[0-9])+, only those of 14 to 19 digits
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])", ""),
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
# High-recall generators of further kinds; a mark that a text must hold, or a pattern.
MORE = {
    "address": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{1,63}+){1,4}+", "at"),
    "secret": (r"(?:(?:password|passwd|token|secret|api_?key)[ ]?[=:][ ]?\"?[A-Za-z0-9_/+.-]{6,128}+|(?<![A-Z0-9])AKIA[0-9A-Z]{12,20}+)", ""),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3}+)?", ""),
    "number": (r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,5}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,5}(?![0-9A-Za-z-])", ""),
}
KINDS = [*BASE, *MORE]
#: Words that stand where a secret would, in forms and examples.
DUMMY = r"(?i)example|changeme|required|your|here|none|null|test|dummy|sample|todo|xxx|optional|missing"
CONTEXT = {"pay": r"(?i)card|visa|pay|iban|bank", "call": r"(?i)tel|phone|call|fax|mobile", "write": r"(?i)mail|contact|write", "login": r"(?i)pass|token|secret|key|login", "net": r"(?i)\bip\b|host|server|address"}


def _hits(text, kind: str, pattern: str, mark: str) -> F.Column:
    """Matches in order, each with what stands before it; a last entry without match holds the rest of the text's length."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(24)).alias("before"), F.left(g, F.lit(1)).alias("first")))
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), gaps.alias("g"))
    has = text.contains(mark) if mark else text.rlike(pattern)
    both = F.transform(zipped, lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), z["m"].alias("m"), z["g"]["n"].alias("n"), z["g"]["before"].alias("before"), z["g"]["first"].alias("first")))
    return F.when(has, F.when(F.size(zipped) > 1, both))


def luhn(digits) -> F.Column:
    """Whether a string of digits passes Luhn's check."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.try_to_number(c, F.lit("9")).cast("int") * (i % 2 + 1))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def remainder97(iban) -> F.Column:
    """The remainder by 97 of an IBAN without blanks, its first four characters last and letters as 10 to 35; 1 if it is valid."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(4)))
    value = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(c >= "A", 100).otherwise(10) + value(c)) % 97))


def candidates(docs: DataFrame, uid=None) -> tuple[DataFrame, DataFrame]:
    """The documents (uid, doc_id) and every candidate: uid, kind, start, stop, base (a base span), features."""
    text = F.coalesce(F.col("text"), F.lit(""))
    arrays = [F.coalesce(_hits(text, k, *p), F.array()) for k, p in (BASE | MORE).items()]
    uid = F.monotonically_increasing_id() if uid is None else F.col(uid)
    scan = stage(docs.select(uid.alias("uid"), "doc_id", F.concat(*arrays).alias("hits")), "pii-scan")
    hits = scan.select("uid", F.inline("hits"))
    line = Window.partitionBy("uid", "kind").orderBy("i")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("size", F.coalesce(F.length("m"), F.lit(0))).withColumn("stop", F.sum(F.col("n") + F.col("size")).over(upto)).withColumn("next", F.lead("first").over(line))
    hits = hits.filter("m IS NOT NULL").withColumn("start", F.col("stop") - F.col("size"))
    m, digits = F.col("m"), F.regexp_replace("m", "[^0-9]", "")
    hits = hits.withColumn("digits", digits).withColumn("nd", F.length(digits))
    octets = F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.substring(F.regexp_replace(p, "^0+(?=.)", ""), 1, 4).try_cast("int"), F.lit(999)) <= 255)
    is_luhn = F.coalesce(F.when(F.col("nd").between(1, 19), luhn(F.col("digits"))), F.lit(False))
    hits = hits.withColumn("luhn", is_luhn)
    kind = F.col("kind")
    base = F.when(kind == "email", True).when(kind == "ip", octets).when(kind == "card", F.col("luhn")).when(kind == "phone", F.col("nd").between(10, 15)).otherwise(False)
    hits = hits.withColumn("base", F.coalesce(base, F.lit(False)))
    tail = F.regexp_extract(m, r"([A-Za-z0-9_/+.-]+)\"?$", 1)
    variety = F.size(F.array_distinct(F.split(tail, ""))).cast("double")
    checked = F.coalesce(F.when(kind == "iban", remainder97(F.regexp_replace(m, " ", "")) == 1), F.lit(False))
    marks = F.size(F.split(m, r"\(dot\)|\[dot\]")) - 1
    flags = [*[kind == k for k in KINDS], F.col("base"), F.col("luhn"), checked, m.rlike(DUMMY), tail.rlike("[0-9]") & tail.rlike("[A-Za-z]"), *[F.col("before").rlike(p) for p in CONTEXT.values()], F.coalesce(F.col("next"), F.lit("")).rlike("^[A-Za-z0-9]"), F.col("before").rlike("[A-Za-z0-9]$")]
    features = [F.length(m), F.col("nd"), F.col("nd") / F.greatest(F.length(m), F.lit(1)), variety, F.length(tail), F.length(F.regexp_replace(m, "[^A-Z]", "")), marks, *[f.cast("int") for f in flags]]
    hits = hits.select("uid", "kind", "start", "stop", "base", F.array(*[f.cast("double") for f in features]).alias("features"))
    return scan.select("uid", "doc_id"), stage(hits, "pii-candidates")


def _pick(salt: str, options: str) -> F.Column:
    words = options.split("|")
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))) + 1).cast("int"))


def _hex(salt: str, n: int) -> F.Column:
    return F.substring(F.sha2(F.concat_ws("-", "id", F.lit(salt)).cast("binary"), 256), 1, n)


def _digits(salt: str, n: int) -> F.Column:
    return F.substring(F.regexp_replace(F.sha2(F.concat_ws("/", "id", F.lit(salt)).cast("binary"), 512), "[a-f]", ""), 1, n)


def _iban(salt: str, n: int, shift: int = 0) -> F.Column:
    """An IBAN with its check digits, or with others (shift)."""
    land, number = _pick(salt, "DE|FR|ES|GB|IT|NL"), _digits(salt, n)
    check = (98 - remainder97(F.concat(land, F.lit("00"), number)) + shift) % 97
    return F.concat(land, F.lpad(check.cast("string"), 2, "0"), number)


def examples(spark: SparkSession, n: int, salt: str, held: bool) -> DataFrame:
    """Generated texts, each with one span of a kind: id, doc_id, text, kind, label (1: personal data or a secret, 0: a look-alike).

    A label is what the generator meant, not what a validator finds. For each kind and label the last of the forms below
    is left out unless ``held``, so that the thresholds are also set on forms that the trees have not seen.
    """
    word = "and|the|of|der|die|les|dans|que|para|was|with|report|order|number|item|total|page|note|und|el"
    w = lambda k: _pick(salt + k, word)
    d = lambda k, n: _digits(salt + k, n)
    h = lambda k, n: _hex(salt + k, n)
    j = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    four = lambda c: F.rtrim(F.regexp_replace(c, "(.{4})", "$1 "))
    name, host, tld = _pick(salt + "n", "anna|j.doe|k_lee|info|m.weber|luis.r|pierre|contact|me|li|maria-jose.garcia|office_berlin"), _pick(salt + "h", "mail|example|post|firma|uni-x|correo|host|ab|technik-service"), _pick(salt + "t", "com|org|de|fr|es|net")
    call, pay = _pick(salt + "c", "tel|phone:|call|mobile|fax"), _pick(salt + "y", "card|visa|pay with|card no")
    upper = lambda k, n: F.upper(F.translate(h(k, n), "0123456789", "ghijklmnop"))
    forms = {
        ("email", 1): [j(name, "@", host, ".", tld), j(w("1"), ".", d("1", 2), "@", host, d("2", 1), ".", host, ".", tld)],
        ("email", 0): [j(w("1"), "@", d("1", 1), ".", d("2", 2), ".", d("3", 1)), j("v@", d("1", 2), ".", d("2", 1))],
        ("ip", 1): [j("10.", (d("1", 2)), ".0.", d("2", 2)), j("host 192.168.1.", d("1", 2))],
        ("ip", 0): [j("4.19.3", d("1", 2), ".", d("2", 1)), j("version 20", d("1", 2), ".12.31.999"), j("9", d("1", 2), ".1.", d("2", 2), ".0")],
        ("card", 1): [j(pay, " 4", d("1", 15)), j(pay, " ", four(F.concat(F.lit("5"), d("2", 15)))), j("visa ", F.regexp_replace(four(F.concat(F.lit("4"), d("3", 15))), " ", "-"))],
        ("card", 0): [j(w("1"), " ", d("1", 16)), j("id ", d("2", 17)), j(w("1"), " ref ", four(d("3", 14)))],
        ("phone", 1): [j(call, " +47 22 1", d("1", 2), " ", d("2", 2)), j(w("1"), " +1 (", d("1", 3), ") 555-", d("2", 4), " 10.1", d("3", 1), ".4", d("4", 1), ".1", d("5", 2)), j(call, " +352 4", d("1", 2), "-", d("2", 3)), j("mobile +1 (", d("1", 3), ") 555-", d("2", 4), " ", d("3", 8))],
        ("phone", 0): [j("a +3 (", d("1", 1), ") ", d("2", 1)), j("up +1", d("1", 2), " - 2", d("2", 2)), j("+5.", d("1", 2), " - 3"), j(w("1"), " +", d("1", 19), " ", d("2", 6))],
        ("address", 1): [j(name, " (at) ", host, " (dot) ", tld), j(name, "[at]", host, ".", tld), j(name, " [at] ", host, " [dot] co [dot] uk")],
        ("address", 0): [j(w("1"), " (at) ", w("2"), ". ", F.initcap(w("3"))), j("look [at] ", w("2"), ". ", F.initcap(w("3"))), j("seen (at) page.", d("1", 2))],
        ("secret", 1): [j('token = "', h("1", 40), '"'), j("password: ", F.substring(F.base64(F.unhex(h("2", 40))), 1, 18)), j("AKIA", upper("3", 16)), j("api_key=", h("4", 8), "-", h("5", 4), "-", h("6", 12)), j("passwd=", F.initcap(w("1")), d("7", 4), F.initcap(w("2")))],
        ("secret", 0): [j("password: required"), j('token = "', _pick(salt + "x", "example|your_token|changeme|none-here|missing"), '"'), j("secret: ", w("1"), "_", w("2"), "-", w("3")), j("token: optional.", w("1")), j("api_key=your-key-here")],
        ("iban", 1): [four(_iban(salt + "1", 18)), _iban(salt + "2", 20), j("iban ", four(_iban(salt + "3", 22)))],
        ("iban", 0): [four(_iban(salt + "4", 18, 5)), _iban(salt + "5", 20, 7), j(upper("5", 2), d("6", 2), " ", upper("7", 4), " ", d("8", 4)), j("part ", _iban(salt + "9", 20, 11))],
        ("number", 1): [j(call, " (0", d("1", 2), ") ", d("2", 3), "-", d("3", 4)), j(call, " 0", d("1", 3), " ", d("2", 3), " ", d("3", 4)), j("fax 0", d("1", 3), ".", d("2", 3), ".", d("3", 4))],
        ("number", 0): [j(w("1"), " ", d("1", 2), ".", d("2", 3), ".", d("3", 3)), j(w("1"), " ", d("1", 2), "-", d("2", 3), "-", d("3", 4)), j("page ", d("1", 2), " ", d("2", 3), " ", d("3", 3))],
    }
    rows = spark.range(n).withColumn("kind", F.element_at(F.array(*map(F.lit, KINDS)), (F.col("id") % len(KINDS) + 1).cast("int"))).withColumn("label", F.floor(F.col("id") / len(KINDS)) % 2)
    text = None
    for (kind, label), every in forms.items():
        every = every if held else every[:-1]
        which = F.pmod(F.xxhash64("id", F.lit(salt + "form")), F.lit(len(every)))
        one = reduce(lambda c, k: c.when(which == k, every[k]), range(1, len(every)), F.when(which == 0, every[0]))
        here = (F.col("kind") == kind) & (F.col("label") == label)
        text = F.when(here, one) if text is None else text.when(here, one)
    around = [F.concat(w("a"), F.lit(" "), w("b"), F.lit(" ")), F.concat(F.lit(" "), w("c"))]
    return rows.select("id", F.col("id").alias("doc_id"), F.concat(around[0], text, around[1]).alias("text"), "kind", F.col("label").cast("double").alias("label"))


def labelled(spark: SparkSession, *sets: tuple[int, str, bool]) -> DataFrame:
    """part, kind, base, label, features of the candidates of generated texts; part k is examples(*sets[k])."""
    parts = [examples(spark, n, salt, held).withColumn("id", F.col("id") * len(sets) + k) for k, (n, salt, held) in enumerate(sets)]
    made = stage(reduce(DataFrame.unionByName, parts), "pii-made")
    found = candidates(made, "id")[1].join(made.select(F.col("id").alias("uid"), F.col("kind").alias("meant"), "label"), "uid")
    # digits of an account or card are no telephone number
    label = F.when(F.col("kind") == F.col("meant"), F.col("label")).when((F.col("kind") == "number") & F.col("meant").isin("iban", "card"), 0.0)
    return stage(found.select((F.col("uid") % len(sets)).alias("part"), "kind", "base", label.alias("label"), "features").filter("label is not null").coalesce(1), "pii-labelled")


def train(spark: SparkSession, made: int = 4_096, trees: int = 12, precision: float = 0.9):
    """The trees, and kind, limit: where scores begin of which that share of a kind's candidates is personal data.

    As the tables hold no labels of spans, the trees learn from ``made`` generated texts, and the limits come from as many
    others with forms that the trees have not seen. Neither depends on the corpus, so they are alike at every size.
    """
    both = labelled(spark, (made, "learn", False), (made, "held", True)).withColumn("x", array_to_vector("features"))
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=4, seed=7, stepSize=0.3).fit(both.filter("part = 0"))
    held = scored(model, both.filter("part = 1").drop("x")).groupBy("kind", "p").agg(F.sum("label").alias("yes"), F.count("*").alias("n"))
    above = Window.partitionBy("kind").orderBy(F.col("p").desc())
    # midway between the least score that may stay and the next one below
    held = held.withColumn("rate", F.sum("yes").over(above) / F.sum("n").over(above)).withColumn("middle", (F.col("p") + F.coalesce(F.lead("p").over(above), F.lit(0.0))) / 2)
    return model, stage(held.filter(F.col("rate") >= precision).groupBy("kind").agg(F.min_by("middle", "p").alias("limit")), "pii-limits")


def scored(model, found: DataFrame) -> DataFrame:
    """Candidates with their score p."""
    p = F.round(vector_to_array("probability")[1], 2)
    return model.transform(found.withColumn("x", array_to_vector("features"))).withColumn("p", p).drop("x", "features", "rawPrediction", "prediction", "probability")


def score(found: DataFrame, fitted=None, **model) -> DataFrame:
    """Candidates with the kept ones of the model (fitted: what train returned, else it is trained): column added."""
    trees, limits = fitted or train(found.sparkSession, **model)
    # one row for each kind, whatever the input
    every = scored(trees, found).join(F.broadcast(limits), "kind", "left")
    return every.withColumn("added", F.coalesce(~F.col("base") & (F.col("p") >= F.col("limit")), F.lit(False)))


def spans(docs: DataFrame, uid=None, **model) -> DataFrame:
    """Every document with its spans: uid, doc_id, found (array of rank, kind, start, stop, base; by start, then kind).

    An added span that lies within a base span adds nothing and goes. Null text counts as empty and, like any text
    without matches, has an empty array. Rows are judged one by one, so repeated rows repeat their result; texts are read
    whole; further columns do not matter; an empty table gives an empty result.
    """
    ids, every = candidates(docs, uid)
    kept = score(every, **model).filter("base or added")
    rank = reduce(lambda c, k: c.when(F.col("kind") == k, KINDS.index(k)), KINDS[1:], F.when(F.col("kind") == KINDS[0], 0))
    one = F.struct(F.col("start").alias("start"), rank.alias("rank"), F.col("stop").alias("stop"), "kind", "base")
    per = kept.groupBy("uid").agg(F.sort_array(F.collect_list(one)).alias("found"))
    within = lambda f: F.exists("found", lambda g: g["base"] & (g["start"] <= f["start"]) & (f["stop"] <= g["stop"]))
    per = per.withColumn("found", F.when(F.exists("found", lambda f: ~f["base"]), F.filter("found", lambda f: f["base"] | ~within(f))).otherwise(F.col("found")))
    return ids.join(per, "uid", "left").withColumn("found", F.coalesce("found", F.array().cast(per.schema["found"].dataType)))


def redact(docs: DataFrame, **model) -> DataFrame:
    """Documents with the spans: doc_id, text (each span replaced by [kind]), found. Overlapping spans merge into the first.

    Each row gets the spans of its own text, whatever its doc_id.
    """
    d = stage(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.coalesce("text", F.lit("")).alias("text")), "pii-rows")
    j = d.join(spans(d, "uid", **model).select("uid", "found"), "uid")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    fold = F.aggregate("found", start, lambda a, f: F.when(f["start"] >= a["at"], F.struct(
        F.concat(a["out"], F.substr(F.col("text"), (a["at"] + 1).cast("int"), (f["start"] - a["at"]).cast("int")), F.lit("["), f["kind"], F.lit("]")).alias("out"), f["stop"].alias("at"))
    ).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], f["stop"]).alias("at"))), lambda a: F.concat(a["out"], F.substr(F.col("text"), (a["at"] + 1).cast("int"))))
    return j.select("doc_id", fold.alias("text"), "found")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for the whole ``documents`` table."""
    s = spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("found", lambda f: f["base"])
    line = lambda a: F.array_join(F.transform(a, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["stop"].cast("string"))), ",")
    kinds = F.transform(base, lambda f: f["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return s.select("doc_id", *count, F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line("found").alias("spans"))
