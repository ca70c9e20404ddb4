"""Predicate trees as data, compiled to one Column each.

A tree is {"all_of": [...]}, {"any_of": [...]}, {"none_of": [...]} or a leaf
{"field": f, "op": o, "value": v}. A leaf is never null: a missing field fails every operator
but `ne` and `not_in`, which hold for it.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = {
    "eq": lambda c, v: c == F.lit(v),
    "ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "lt": lambda c, v: c < F.lit(v),
    "lte": lambda c, v: c <= F.lit(v),
    "gt": lambda c, v: c > F.lit(v),
    "gte": lambda c, v: c >= F.lit(v),
    "in": lambda c, v: c.isin(list(v)),
    "not_in": lambda c, v: F.coalesce(~c.isin(list(v)), F.lit(True)),
    "contains": lambda c, v: F.contains(c.cast("string"), F.lit(str(v))),
}
BRANCHES = ("all_of", "any_of", "none_of")


class RuleError(ValueError):
    pass


def validated(node: dict, fields: Collection[str]) -> dict:
    """The node, or RuleError for an unknown field or operator, an empty list or a missing key."""
    if not isinstance(node, dict):
        raise RuleError("a predicate must be a mapping")
    branch = [b for b in BRANCHES if b in node]
    if branch:
        if len(node) != 1 or not isinstance(node[branch[0]], list) or not node[branch[0]]:
            raise RuleError(f"{branch[0]} takes a list that is not empty, and nothing beside it")
        for child in node[branch[0]]:
            validated(child, fields)
        return node
    if missing := {"field", "op", "value"} - node.keys():
        raise RuleError(f"a leaf lacks {sorted(missing)}")
    if node["op"] not in OPERATORS:
        raise RuleError(f"unknown operator {node['op']}")
    if node["field"] not in fields:
        raise RuleError(f"unknown field {node['field']}")
    return node


def leaf_holds(leaf: dict) -> Column:
    return F.coalesce(OPERATORS[leaf["op"]](F.col(leaf["field"]), leaf["value"]), F.lit(False))


def compiled(node: dict) -> Column:
    for branch in BRANCHES:
        if branch in node:
            parts = [compiled(child) for child in node[branch]]
            either = reduce(lambda a, b: a | b, parts)
            return reduce(lambda a, b: a & b, parts) if branch == "all_of" else either if branch == "any_of" else ~either
    return leaf_holds(node)


def leaves(node: dict) -> list[dict]:
    for branch in BRANCHES:
        if branch in node:
            return [leaf for child in node[branch] for leaf in leaves(child)]
    return [node]


def triggering_values(node: dict) -> Column:
    """map<field, value as string> of the leaves that hold; a later leaf of a field wins."""
    last = {}
    for leaf in leaves(node):
        last.setdefault(leaf["field"], []).append(leaf)
    entries = [F.struct(F.lit(f).alias("key"), F.col(f).cast("string").alias("value"), reduce(lambda a, b: a | b, map(leaf_holds, group)).alias("held")) for f, group in last.items()]
    held = F.filter(F.array(*entries), lambda e: e["held"])
    return F.map_from_entries(F.transform(held, lambda e: F.struct(e["key"], e["value"])))
