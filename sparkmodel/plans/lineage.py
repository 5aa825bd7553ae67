"""Column lineage from Catalyst's analyzed plan: which columns of which relations each output column comes from."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame

ATTRIBUTE = "org.apache.spark.sql.catalyst.expressions.AttributeReference"
ALIAS = "org.apache.spark.sql.catalyst.expressions.Alias"


def expressions(value: Any) -> list[list[dict[str, Any]]]:
    """The expression trees (lists of nodes, root first) anywhere inside a field of a plan node."""
    if isinstance(value, list):
        if value and isinstance(value[0], dict) and "class" in value[0] and "num-children" in value[0]:
            return [value]
        return [e for v in value for e in expressions(v)]
    return []


def identity(node: Mapping[str, Any]) -> int:
    return node["exprId"]["id"]


def column_lineage(df: DataFrame, relations: Mapping[str, DataFrame] | None = None) -> dict[str, dict[str, set[str]]]:
    """{output column: {relation: columns}}.

    Relations are recognised by the attributes of the given frames (as used to build df); attributes of none of them
    are listed under ''. Of a union the first side is followed. Columns that a filter or join condition alone uses are not counted.
    """
    origin: dict[int, tuple[str, str]] = {}
    for name, relation in (relations or {}).items():
        for attribute in output(relation):
            origin[identity(attribute)] = (name, attribute["name"])
    made: dict[int, set[int]] = {}
    names: dict[int, str] = {}
    for node in json.loads(df._jdf.queryExecution().analyzed().toJSON()):
        for tree in (e for k, v in node.items() if k != "class" for e in expressions(v)):
            root = tree[0]
            for part in tree:
                if part["class"] == ATTRIBUTE:
                    names[identity(part)] = part["name"]
            if root["class"] == ALIAS:
                made.setdefault(identity(root), set()).update(identity(p) for p in tree[1:] if p["class"] == ATTRIBUTE)

    def sources(key: int, seen: frozenset[int]) -> set[tuple[str, str]]:
        if key in origin:
            return {origin[key]}
        if key in seen:
            return set()
        if key not in made:
            return {("", names.get(key, str(key)))}
        return set().union(*(sources(k, seen | {key}) for k in made[key]))

    found: dict[str, dict[str, set[str]]] = {}
    for attribute in output(df):
        by: dict[str, set[str]] = {}
        for relation, column in sources(identity(attribute), frozenset()):
            by.setdefault(relation, set()).add(column)
        found[attribute["name"]] = by
    return found


def output(df: DataFrame) -> list[dict[str, Any]]:
    attributes = df._jdf.queryExecution().analyzed().output()
    return [json.loads(attributes.apply(i).toJSON())[0] for i in range(attributes.size())]


def inherited_descriptions(lineage: Mapping[str, Mapping[str, set[str]]], described: Mapping[str, Mapping[str, str]]) -> dict[str, str]:
    """A column's description, where it comes from exactly one described column."""
    out = {}
    for column, by in lineage.items():
        parents = [(r, c) for r, columns in by.items() for c in columns]
        if len(parents) == 1 and parents[0][1] in described.get(parents[0][0], {}):
            out[column] = described[parents[0][0]][parents[0][1]]
    return out
