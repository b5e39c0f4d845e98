"""Text functions on columns: citations, identifiers, statute units, labels, cleaning. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Case numbers, with or without their court; a longer form stands before the shorter one it holds.
CASE_NUMBER = "|".join([
    r"대법원\s*\d{4}[가-힣]+\d+",
    r"서울고(?:등)?법원\s*\d{4}[가-힣]+\d+",
    r"서울행정법원\s*\d{4}[가-힣]+\d+",
    r"\d{4}[가-힣]+\d+",
    r"조심\s*\d{4}[가-힣]+\d+",
    r"국심\s*\d{4}[가-힣]+\d+",
])
#: law, article, article sub, paragraph, item, item sub, sub-item
TARGET = r"^(.+?)\s+제(\d+)조(?:의(\d+))?(?:\s*제(\d+)항)?(?:\s*제(\d+)호(?:의(\d+))?)?(?:\s*([가-힣])목)?"
# Words that mark the end of a judgment, and of a question on cross-border taxation.
END_TRIGGERS = ["주문과 같이", "주문과 같 다", "판결한다", "판결한 ", "인용하기로", "기각하기로", "인용한 ", "기각한 ", "재판장 판사", "판사 "]
CROSS_BORDER = ["이전가격", "국제조세", "정상가격", "이전가", "BEPS", "필라", "pillar", "CFC", "과세가격", "국조법", "독립기업", "국외특수관계", "조세조약", "정상이자율", "정상임대료", "정상로열티", "비교가능", "정상가액", "국제거래", "조세피난처", "혼성불일치", "무형자산 이전", "세원잠식"]
# What users call a decision or tax, and what the collection of court decisions stores.
DECISIONS = {"국승": "국승", "국가승소": "국승", "납세자패소": "국승", "국패": "국패", "국가패소": "국패", "납세자승소": "국패", "일부국패": "일부국패", "일부승소": "일부국패", "각하": "각하", "기각": "기각"}
TAXES = {"법인세": "법인세", "법인": "법인세", "소득세": "종합소득세", "종합소득세": "종합소득세", "종합소득": "종합소득세", "양도소득세": "양도소득세", "양도": "양도소득세", "부가가치세": "부가가치세", "부가세": "부가가치세", "부가": "부가가치세", "상속세": "상속증여세", "증여세": "상속증여세", "상속증여": "상속증여세", "종합부동산세": "종합부동산세", "종부세": "종합부동산세", "국세징수": "국세징수", "징수": "국세징수", "국세기본": "국세기본", "국기법": "국세기본", "국제조세": "국제조세", "이전가격": "국제조세"}
#: One vocabulary of wins for every query: (collection, label).
WINS = {"court": ["국패", "일부국패", "일부국승"], "tribunal": ["취소", "경정", "인용"]}
# Laws whose changes touch others; preferred transfer-pricing methods by transaction.
CROSS_LAW = {"조세특례제한법": ["법인세법", "소득세법", "부가가치세법", "국세기본법"], "상속세 및 증여세법": ["국세기본법", "소득세법"], "관세법": ["부가가치세법", "국세기본법"], "종합부동산세법": ["국세기본법", "소득세법"], "개별소비세법": ["부가가치세법", "국세기본법"], "자본시장과 금융투자업에 관한 법률": ["소득세법", "법인세법"]}
METHODS = {"유형자산 매각": ["CUP", "TNMM"], "무형자산 양도": ["CUP", "PSM"], "무형자산 라이선스": ["CUP", "PSM"], "용역 제공": ["COST+", "TNMM"], "금전 대여": ["CUP"], "금전 차입": ["CUP"], "원자재·완제품 매매": ["CUP", "RPM"], "기타": ["TNMM"]}
LARGE_TRANSACTION = 5_000_000_000


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def lookup(c: Column, table: dict[str, str]) -> Column:
    """The table's value for a key; the trimmed key itself where it has none."""
    m = F.create_map(*[F.lit(x) for x in chain(*table.items())])
    return F.coalesce(m[F.trim(c)], F.trim(c))


def lookup_list(c: Column, table: dict[str, list[str]]) -> Column:
    """The table's list for a key; null where it has none."""
    return reduce(lambda w, kv: w.when(c == kv[0], F.array(*map(F.lit, kv[1]))), table.items(), F.when(F.lit(False), F.array(F.lit(""))))


def any_of(c: Column, words: list[str]) -> Column:
    """Whether any of the words stands in the text, whatever the case; false for null."""
    text = F.lower(F.coalesce(c, F.lit("")))
    return reduce(lambda a, b: a | b, [text.contains(w.lower()) for w in words])


def ends_judgment(c: Column) -> Column:
    """Whether a sentence holds words that end a judgment, as they are written; false for null."""
    text = F.coalesce(c, F.lit(""))
    return reduce(lambda a, b: a | b, [text.contains(w) for w in END_TRIGGERS])


def preferred_methods(kind: Column) -> Column:
    """Transfer-pricing methods for a kind of transaction, the first to be tried first; those for other kinds where it is none of the known ones."""
    return F.coalesce(lookup_list(kind, METHODS), F.array(*map(F.lit, METHODS["기타"])))


def large_transaction(amount: Column) -> Column:
    """Whether an amount (in won) is so large that an advance agreement is considered."""
    return amount >= LARGE_TRANSACTION


def is_win(collection: str, label: Column) -> Column:
    """Whether a label, exactly, is a win in its collection."""
    return label.isin(WINS[collection])


def canonical_id(c: Column) -> Column:
    """An identifier without blanks and hyphens, for comparison."""
    return F.regexp_replace(c, r"[\s-]", "")


def cited(c: Column) -> Column:
    """Case numbers in a text, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CASE_NUMBER), F.lit(0)))


def valid_ids(df: DataFrame, columns: list[str]) -> DataFrame:
    """id: canonical identifiers from any of several columns, each once."""
    ids = df.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("id")).filter(F.coalesce(F.trim("id"), F.lit("")) != "")
    return ids.select(canonical_id(F.col("id")).alias("id")).distinct()


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, with c evaluated once for a row, however often f names it; written out, the optimiser would repeat it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def pieces(c: Column) -> Column:
    """What stands between citations and the citations themselves, in turn: found by one search unless the text holds the mark itself."""
    mark = "\u0001"
    cut = F.split(F.regexp_replace(c, CASE_NUMBER, f"{mark}$0{mark}"), mark, -1)
    zipped = F.arrays_zip(F.split(c, CASE_NUMBER, -1).alias("g"), F.regexp_extract_all(c, F.lit(CASE_NUMBER), F.lit(0)).alias("h"))
    return F.when(c.contains(mark), F.flatten(F.transform(zipped, lambda z: F.filter(F.array(z["g"], z["h"]), lambda t: t.isNotNull())))).otherwise(cut)


def guard(texts: DataFrame, key: str, text: str, valid: DataFrame, tag: str = "unverified") -> DataFrame:
    """Texts with every citation that is not valid marked **[tag: id]**, and the list of those: key, text, unverified.

    One pass from left to right over the text's pieces, so a marked citation is never marked again, and one that is part
    of a longer one is not touched in it. Texts are searched and shuffled once; only citations are checked, by a join, not
    by a list on the driver.
    """
    cut = texts.select(key, pieces(F.coalesce(text, F.lit(""))).alias("_p")).repartition(key)
    found = cut.select(key, F.explode(F.array_distinct(F.filter("_p", lambda _, i: i % 2 == 1))).alias("_c"))
    bad = found.join(valid, canonical_id(F.col("_c")) == valid["id"], "left_anti").groupBy(key).agg(F.array_sort(F.collect_set("_c")).alias("_bad"))
    d = cut.join(bad, key, "left").withColumn("_bad", F.coalesce("_bad", F.array().cast("array<string>")))
    told = lambda x, i: F.when((i % 2 == 1) & F.array_contains("_bad", x), F.concat(F.lit(f"**[{tag}: "), x, F.lit("]**"))).otherwise(x)
    return d.select(key, F.array_join(F.transform("_p", told), "").alias(text), F.array_join("_bad", "|").alias("unverified"))


def article_id(main: Column, sub: Column) -> Column:
    return F.concat_ws("_", F.lit("ART"), main, blank_to_null(sub))


def parse_target(c: Column) -> Column:
    """law, article_id, paragraph, item, item_sub, sub_item of a citation; null where it is none. One search for all parts."""

    def fields(parts: Column) -> Column:
        part = lambda i: blank_to_null(F.get(parts, F.lit(i - 1)))
        named = F.struct(part(1).alias("law"), article_id(part(2), part(3)).alias("article_id"), part(4).alias("paragraph"), part(5).alias("item"), part(6).alias("item_sub"), part(7).alias("sub_item"))
        return F.when(F.size(parts) == 7, named)

    return once(F.split(F.regexp_replace(F.trim(c), TARGET + r"(?s).*$", "\u0001".join(f"${i}" for i in range(1, 8))), "\u0001"), fields)


def internal_target(c: Column, citing_law: Column) -> Column:
    """The law that a reference within a law means ("this law", "the same law's decree", a bare article); null otherwise."""
    base = F.regexp_replace(citing_law, r"\s*시행(?:령|규칙)$", "")
    t = F.regexp_replace(F.trim(c), r"^해당\s*", "")
    law = t.rlike(r"^(?:이\s*법|같은\s*법|동법|본법)(?!\s*시행)")
    decree = t.rlike(r"^(?:이\s*영|같은\s*[령영]|동령|본령|(?:(?:같은|이)\s*(?:법\s*)?)?시행령)")
    rule = t.rlike(r"^(?:이\s*규칙|같은\s*규칙|(?:(?:같은|이)\s*(?:법\s*)?)?시행규칙)")
    return F.when(decree, F.concat(base, F.lit(" 시행령"))).when(rule, F.concat(base, F.lit(" 시행규칙"))).when(law, base).when(t.rlike(r"^제\s*\d+"), citing_law)


def article_input(c: Column) -> Column:
    """65, 65조, 65의2, 65 의 2 as 65 or 65_2; empty where there is no number."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"[조\s]", "")
    parts = F.transform(F.split(s, "의", 2), lambda p: F.regexp_replace(F.regexp_replace(p, r"[^0-9]", ""), r"^0+(?=\d)", ""))
    return F.when(F.exists(parts, lambda p: p == ""), "").otherwise(F.array_join(parts, "_"))


def article_matches(ids: Column, wanted: Column) -> Column:
    """The article itself or, unless the input names a sub-number, also its sub-articles."""
    return (ids == wanted) | (~F.regexp_replace(wanted, "^ART_", "").contains("_") & ids.startswith(F.concat(wanted, F.lit("_"))))


def natural_order(ids: Column) -> list[Column]:
    """Order of ART_n and ART_n_m by numbers; what is none of these comes last."""
    n = F.regexp_extract(ids, r"^ART_(\d+)(?:_(\d+))?$", 1).try_cast("int")
    m = F.regexp_extract(ids, r"^ART_(\d+)_(\d+)$", 2).try_cast("int")
    return [n.asc_nulls_last(), F.coalesce(m, F.lit(0)), ids]


def unit_no(c: Column, unit: str) -> Column:
    """34_3 of an article's or section's 34-of-3 heading; null without."""
    p = rf"제(\d+){unit}(?:의(\d+))?"
    return F.when(c.rlike(p), F.concat_ws("_", F.regexp_extract(c, p, 1), blank_to_null(F.regexp_extract(c, p, 2))))


def unit_kind(c: Column) -> Column:
    """chapter, section, subdivision or article by the heading; null for other lines."""
    return F.when(c.rlike(r"^제\d+장"), "chapter").when(c.rlike(r"^제\d+절"), "section").when(c.rlike(r"^제\d+관"), "subdivision").when(c.rlike(r"^제\d+조"), "article")


def source_type(kind: Column, name: Column) -> Column:
    """LAW, DECREE, RULE or UNKNOWN: by the kind of law and, where that says nothing, by the end of the name."""
    k, n = F.trim(F.coalesce(kind, F.lit(""))), F.trim(F.coalesce(name, F.lit("")))
    by_kind = F.when(k == "법률", "LAW").when(k == "대통령령", "DECREE").when(k.endswith("부령") | (k == "총리령"), "RULE")
    return F.coalesce(by_kind, F.when(n.endswith("시행규칙"), "RULE").when(n.endswith("시행령"), "DECREE").when(n.endswith("법"), "LAW"), F.lit("UNKNOWN"))


def law_kind(name: Column) -> Column:
    return F.when(name.contains("시행규칙"), "rule").when(name.contains("시행령"), "decree").otherwise("law")


def base_law(name: Column) -> Column:
    return F.regexp_replace(name, r"\s*(?:시행규칙|시행령)$", "")


def law_name(target: Column) -> Column:
    """The law a citation names, without a particle at its end; null for references within a law and names under 2 letters."""
    t = F.trim(target)
    name = F.regexp_replace(F.trim(F.regexp_extract(t, r"^(.+?)\s*제\s*\d+", 1)), r"(?:에\s*따른|의|및)$", "")
    return F.when(~t.rlike(r"^제\s*\d+") & (F.length(F.trim(name)) >= 2), F.trim(name))


def law_in_question(question: Column, names: list[str]) -> Column:
    """The longest known law name in a question, with or without its blanks; null without any."""
    ordered = sorted(names, key=lambda n: (-len(n), n))
    return reduce(lambda w, n: w.when(question.contains(n) | question.contains(n.replace(" ", "")), n), ordered, F.when(F.lit(False), ""))


def strip_enumerator(c: Column) -> Column:
    """Without a leading circled digit, or number with a delimiter; years and amounts stay, and so does markup."""
    plain = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s*(?:[①-⑳]\s*|\d+\s*[.)](?!\d)\s*)", ""))
    return F.when(F.coalesce(c, F.lit("")).rlike("<.*>"), F.trim(c)).otherwise(plain)


def norm_title(c: Column) -> Column:
    """Blanks collapsed, and a remark in angle brackets at the end removed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\s+", " "), r"\s*<[^>]*>\s*$", ""))


def chapter_key(c: Column) -> Column:
    return F.regexp_replace(blank_to_null(F.regexp_extract(c, r"(제\s*\d+\s*장)", 1)), r"\s+", "")


def stable_id(c: Column, n: int = 12) -> Column:
    """The first hex digits of the SHA-256 of a text whose blanks are collapsed."""
    return F.substring(F.sha2(F.trim(F.regexp_replace(c, r"\s+", " ")), 256), 1, n)


def pair_id(a: Column, b: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))), 256), 1, n)


def safe_name(c: Column, default: str) -> Column:
    """Without characters that paths do not take; a default where nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\\/:*?\"<>|\s,()（）]", ""), F.lit("")), F.lit(default))


def case_id_of(c: Column) -> Column:
    """A case number of two or four year digits that stands apart from other digits and letters; null without."""
    return F.nullif(F.regexp_extract(c, r"(?<![0-9가-힣])((?:\d{4}|\d{2})[가-힣]{1,3}\d+)(?![0-9가-힣])", 1), F.lit(""))


def file_parts(stem: Column, admin: list[str] = ("두", "구합", "누"), criminal: list[str] = ("도", "고합", "노")) -> Column:
    """court, case_no, year and case_type of a file's COURT_NUMBER name."""
    parts = F.split(stem, "_", 2)
    no = F.coalesce(F.try_element_at(parts, F.lit(2)), stem)
    has = lambda codes: reduce(lambda a, b: a | b, [no.contains(x) for x in codes])
    return F.struct(parts[0].alias("court"), no.alias("case_no"), F.regexp_extract(no, r"(\d{4})", 1).alias("year"), F.when(has(admin), "ADMIN").when(has(criminal), "CRIMINAL").otherwise("UNKNOWN").alias("case_type"))


def annex_parts(c: Column) -> Column:
    """base and part of an annex identifier; the part is 0 where it has none."""
    p = r"^(ANNEX_\d+)(?:_(\d+))?$"
    return F.struct(F.coalesce(blank_to_null(F.regexp_extract(c, p, 1)), c).alias("base"), F.coalesce(F.regexp_extract(c, p, 2).try_cast("int"), F.lit(0)).alias("part"))


def strip_html(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "), r"\s+", " "))


def field(c: Column, label: str) -> Column:
    """What stands after [label] up to the next bracket or five blanks; empty without the label."""
    return F.trim(F.regexp_extract(c, rf"\[{label}\]\s*(.+?)(?=\s*\[|\s{{5,}}|$)", 1))


def ids_in_links(c: Column, name: str) -> Column:
    """The numbers of name=123 in a text, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"{name}=(\d+)"), F.lit(1)))


def tagged_text(parts: dict[str, Column], limit: int | None = None) -> Column:
    """[tag] text on a line for every part that is not blank, cut to a length."""
    text = F.concat_ws("\n", *[F.when(blank_to_null(c).isNotNull(), F.concat(F.lit(f"[{t}] "), F.trim(c))) for t, c in parts.items()])
    return F.substring(text, 1, limit) if limit else text


def first_nonblank(parts: dict[str, Column]) -> tuple[Column, Column]:
    """The first part that is not blank, and its name."""
    text = F.coalesce(*[blank_to_null(c) for c in parts.values()])
    name = reduce(lambda w, kv: w.when(blank_to_null(kv[1]).isNotNull(), kv[0]), parts.items(), F.when(F.lit(False), ""))
    return text, name


def speaker(kind: Column, role: Column) -> Column:
    """Who speaks: by the paragraph's kind first, then by the sentence's role."""
    return (F.when(kind == "argument_plaintiff", "plaintiff").when(kind == "argument_defendant", "defendant").when(kind.isin("reasoning_core", "legal_basis", "statute"), "court")
            .when(role == "argument_plaintiff", "plaintiff").when(role == "argument_defendant", "defendant").when(role.isin("court_reasoning", "conclusion"), "court"))


def block_kind(kind: Column, role: Column) -> Column:
    return (F.when(kind.isin("meta", "fact"), "fact").when(kind.isin("argument_plaintiff", "argument_defendant"), kind).when(kind.isin("legal_basis", "statute"), "legal_basis")
            .when(kind == "reasoning_core", "reasoning").when(role == "conclusion", "outcome").otherwise("other"))


def repaired_json(c: Column) -> Column:
    """A model's answer as JSON text: fences and line comments removed, cut from the first bracket to the last; empty objects dropped."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)```(?:json)?", "")
    s = F.regexp_replace(s, r"(?m)(^|[\s,{\[])//[^\n]*$", "$1")
    s = F.regexp_extract(s, r"(?s)([\[{].*[\]}])", 1)
    s = F.regexp_replace(F.regexp_replace(s, r"\{\s*\}\s*,|,\s*\{\s*\}(?=\s*[\],])", ""), r",\s*([\]}])", "$1")
    return F.nullif(s, F.lit(""))


def has_access(level: Column, until: Column, as_of: str) -> Column:
    """Whether a subscriber's access holds on a day; an open end never ends."""
    return (level == "SUBSCRIBER") & (until.isNull() | (until >= F.lit(as_of).cast("date")))


#: Parts of a narrative in the order in which its text names them (fixed values).
NARRATIVE = ("fact_summary", "legal_context", "court_reasoning", "conclusion", "plaintiff_arguments", "defendant_arguments")


def narrative_text(part: Callable[[str], Column], most: int = 4000) -> Column:
    """[name] text, a line for each part of a narrative that is not empty; ``part``: name -> column."""
    lines = [F.when(F.coalesce(part(n), F.lit("")) != "", F.concat(F.lit(f"[{n}] "), part(n))) for n in NARRATIVE]
    return F.substring(F.concat_ws("\n", *lines), 1, most)


def issue_logic_text(outline: Column, issues: Column, chains: Column, most: int = 4000) -> Column:
    """The outline, the first three issues and the first three arguments (issue: premise) as labelled lines; arguments without an issue are left out."""
    head = F.when(F.coalesce(outline, F.lit("")) != "", F.concat(F.lit("[개요] "), F.substring(outline, 1, 500)))
    told = F.transform(F.slice(F.coalesce(issues, F.array().cast("array<string>")), 1, 3), lambda i: F.concat(F.lit("[쟁점] "), F.substring(F.coalesce(i, F.lit("")), 1, 300)))
    line = lambda c: F.when(F.coalesce(c["issue"], F.lit("")) != "", F.concat(F.lit("[논거] "), F.substring(c["issue"], 1, 200), F.lit(": "), F.substring(F.coalesce(c["premise"], F.lit("")), 1, 200)))
    argued = F.array_compact(F.transform(F.slice(F.coalesce(chains, F.filter(F.array(F.struct(F.lit("").alias("issue"), F.lit("").alias("premise"))), lambda _: F.lit(False))), 1, 3), line))
    return F.substring(F.array_join(F.concat(F.array_compact(F.array(head)), told, argued), "\n"), 1, most)


def raw_text(paragraphs: Column, most: int = 4000) -> Column:
    """The first twenty paragraphs, 200 characters of each that is not blank."""
    cut = F.transform(F.slice(paragraphs, 1, 20), lambda p: F.substring(F.trim(F.coalesce(p, F.lit(""))), 1, 200))
    return F.substring(F.array_join(F.filter(cut, lambda p: p != ""), "\n"), 1, most)


def chain_text(*parts: Column) -> Column:
    """The parts of an argument that are not empty, one under the other."""
    return F.concat_ws("\n", *[F.when(p != "", p) for p in parts])
