"""Documents of mixed shape as VARIANT: one or many, text or node, lists in lists to any depth (column expressions)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_LISTS, _NODE = "array<variant>", "map<string,variant>"


def once(v: Column, f: Callable[[Column], Column]) -> Column:
    """f(v) with v worked out once, however often f names it: Spark shares no common parts within lambdas."""
    return F.get(F.transform(F.array(v), f), F.lit(0))


def field(v: Column, *names: str) -> Column:
    """The node's field, or a field below it; null where there is none or v is no node."""
    return F.try_variant_get(v, "$" + "".join(f"['{n}']" for n in names), "variant")


def is_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", _LISTS).isNotNull()


def is_node(v: Column) -> Column:
    # a struct without fields: none of the node's are copied
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def is_text(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def scalar(v: Column) -> Column:
    """A text, number or truth value as text; null for null, lists and nodes."""
    # lists and nodes become JSON, so only what looks like it needs a second look
    told = lambda u, t: F.when(F.substring(t, 1, 1).isin("[", "{") & (is_list(u) | is_node(u)), F.lit(None)).otherwise(t)
    return once(v, lambda u: once(F.try_variant_get(u, "$", "string"), lambda t: told(u, t)))


def many(v: Column) -> Column:
    """Array of variants: a list's elements, anything else as the only one, nothing for null."""
    none = F.array().cast(_LISTS)
    return once(v, lambda u: F.when(u.isNull() | F.is_variant_null(u), none).otherwise(F.coalesce(F.try_variant_get(u, "$", _LISTS), F.array(u))))


def nodes(v: Column) -> Column:
    """The nodes among one or many."""
    return F.filter(many(v), is_node)


def depth(v: Column) -> Column:
    """How deep lists and nodes are nested: 0 for a scalar, 1 for a list of scalars."""
    # brackets outside of text: escapes go first, then what stands between quotation marks
    bare = F.regexp_replace(F.regexp_replace(F.to_json(v), r"\\.", ""), '"[^"]*"', "")
    steps = F.transform(F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), ""), lambda b: F.when(b.isin("[", "{"), 1).when(b.isin("]", "}"), -1).otherwise(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    fold = lambda s, d: F.struct((s["now"] + d).alias("now"), F.greatest(s["most"], s["now"] + d).alias("most"))
    return F.coalesce(F.aggregate(steps, start, fold)["most"], F.lit(0))


def flat(v: Column) -> Column:
    """Array of what lists in lists hold, in order, to any depth; nodes stay whole.

    Each level unwraps the lists that are left, as often as the value is deep, so the plan does not grow with the depth.
    The depth is only looked for where a list holds lists.
    """
    unwrap = lambda a, _: F.flatten(F.transform(a, many))
    deep = lambda u, first: F.aggregate(F.sequence(F.lit(0), depth(u)), first, unwrap)
    return once(v, lambda u: once(many(u), lambda first: F.when(F.exists(first, is_list), deep(u, first)).otherwise(first)))


def texts(v: Column) -> Column:
    """The scalars of flat() as texts; nodes and nulls are left out."""
    every = lambda u: F.filter(F.transform(flat(u), scalar), lambda t: t.isNotNull())
    return once(v, lambda u: once(scalar(u), lambda t: F.when(t.isNotNull(), F.array(t)).otherwise(every(u))))


def block_texts(v: Column) -> Column:
    """The texts of a list of texts and nodes, one under the other; of a node its own text fields count, in the order of their names."""
    of_node = lambda b: F.transform(F.filter(F.map_values(F.try_variant_get(b, "$", _NODE)), is_text), scalar)
    parts = F.flatten(F.transform(many(v), lambda b: F.when(is_node(b), of_node(b)).otherwise(texts(b))))
    return F.trim(F.array_join(parts, "\n"))


def unwrapped(v: Column, names: tuple[str, ...] = ("root", "items", "citations", "records")) -> Column:
    """Array of the entries of an answer that should be a list: a list itself; of a node the list under the first of the names that holds one, or its only field if that is a list; else the node alone. Empty nodes are left out."""
    named = F.coalesce(*[F.when(is_list(field(v, n)), field(v, n)) for n in names])
    only = F.get(F.map_values(F.try_variant_get(v, "$", _NODE)), F.lit(0))
    lone = F.when((F.size(F.map_keys(F.try_variant_get(v, "$", _NODE))) == 1) & is_list(only), only)
    return F.filter(many(F.when(is_node(v), F.coalesce(named, lone, v)).otherwise(v)), lambda e: F.to_json(e) != "{}")
