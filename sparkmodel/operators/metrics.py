"""A semantic layer: metrics over tables, references that join them, and queries at any grain.

A metric is an aggregate over one table's columns or a formula over other metrics. A query names metrics and group
columns; for each table that metrics measure, the tables that hold the group columns are found along references, joined
to it, and the metrics aggregated at the grain. The results meet in a full join on the grain.
"""

from __future__ import annotations

import operator
import re
from collections import deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The form of a query in SQL, and of what it selects.
SEMANTIC = re.compile(r"select (?P<items>.+?) from __semantic\.__table(?: where (?P<where>.+?))?(?: group by (?P<group>.+?))?(?: order by (?P<order>.+?))?(?: limit (?P<limit>\d+))?", re.IGNORECASE)
ITEM = re.compile(r"(?:metric\((?P<metric>\w+)\)|(?P<column>\w+))(?: (?:as )?(?P<alias>\w+))?", re.IGNORECASE)
#: References that one path may follow.
MAX_STEPS = 3


@dataclass(frozen=True)
class Reference:
    """A column by which rows of a table are known elsewhere; unique if it identifies a row of its own table."""

    table: str
    name: str
    column: str
    unique: bool = False


@dataclass(frozen=True)
class Metric:
    """Either an aggregate of a table or a formula over other metrics; `needs` names columns of other tables it refers to."""

    name: str
    table: str | None = None
    aggregate: Callable[[], Column] | None = None
    formula: Callable[[dict[str, Column]], Column] | None = None
    inputs: Sequence[str] = ()
    needs: Sequence[str] = ()

    def __post_init__(self) -> None:
        if (self.aggregate is None) == (self.formula is None) or (self.aggregate is not None) != (self.table is not None):
            raise ValueError(f"{self.name}: an aggregate needs a table, a formula needs metrics")


#: Functions whose first argument is what a metric measures.
AGGREGATES = ("sum", "count", "avg", "mean", "min", "max", "stddev", "stddev_samp", "stddev_pop", "variance", "var_samp", "var_pop", "median", "any_value", "approx_count_distinct")


def tables_of(spark: SparkSession, text: str) -> tuple[str, dict[str, list[str]]]:
    """(the table that an aggregate in SQL measures, columns by table): columns are written table.column.

    The measured table is that of the first column that an aggregate takes, directly, within arithmetic, or as a result
    of CASE or IF; a column of a condition measures nothing.
    """
    measured: list[str] = []
    columns: dict[str, list[str]] = {}

    def walk(node: Any, measures: bool) -> None:
        kind = node.getClass().getSimpleName()
        children = [node.children().apply(i) for i in range(node.children().size())]
        if kind == "UnresolvedAttribute":
            parts = [node.nameParts().apply(i) for i in range(node.nameParts().size())]
            if len(parts) > 1:
                columns.setdefault(".".join(parts[:-1]), []).append(parts[-1])
                if measures:
                    measured.append(".".join(parts[:-1]))
            return
        name = node.nameParts().last().lower() if kind == "UnresolvedFunction" else ""
        for i, child in enumerate(children):
            if kind == "CaseWhen":
                # conditions and results take turns, the last may be the result of ELSE
                result = i % 2 == 1 or i == len(children) - 1 and len(children) % 2 == 1
                walk(child, measures and result)
            elif name == "if":
                walk(child, measures and i > 0)
            elif name:
                walk(child, i == 0 and name in AGGREGATES)
            else:
                walk(child, measures and kind in ("Add", "Subtract", "Multiply", "Divide", "UnaryMinus", "Cast", "Remainder"))

    walk(spark._jsparkSession.sessionState().sqlParser().parseExpression(text), False)
    if not measured:
        raise ValueError(f"no table is measured by {text}")
    return measured[0], columns


def metric_from_sql(spark: SparkSession, name: str, text: str) -> Metric:
    """A metric written as an aggregate in SQL: the table that it measures, and what else it refers to, follow from it."""
    table, columns = tables_of(spark, text)
    plain = text
    for t in sorted(columns, key=len, reverse=True):
        plain = re.sub(rf"\b{re.escape(t)}\.(?=\w)", "", plain)
    return Metric(name, table, lambda: F.expr(plain), needs=[c for t, own in columns.items() if t != table for c in own])


@dataclass
class SemanticModel:
    tables: dict[str, DataFrame]
    references: list[Reference] = field(default_factory=list)
    metrics: dict[str, Metric] = field(default_factory=dict)

    def add(self, *metrics: Metric) -> SemanticModel:
        self.metrics |= {m.name: m for m in metrics}
        return self

    def leaves(self, names: Sequence[str]) -> list[Metric]:
        """The aggregates that these metrics come down to, each once."""
        found: dict[str, Metric] = {}

        def visit(name: str, above: tuple[str, ...]) -> None:
            if name in above:
                raise ValueError("metrics form a cycle: " + " -> ".join([*above, name]))
            metric = self.metrics[name]
            if metric.formula is None:
                found[name] = metric
            for other in metric.inputs:
                visit(other, (*above, name))

        for n in names:
            visit(n, ())
        return list(found.values())

    def path(self, start: str, column: str) -> list[tuple[Reference, Reference]]:
        """The shortest chain of references from a table to one that has the column; no step may multiply rows."""
        todo = deque([(start, [], {start})])
        while todo:
            table, steps, seen = todo.popleft()
            if column in self.tables[table].columns:
                return steps
            if len(steps) == MAX_STEPS:
                continue
            for own in (r for r in self.references if r.table == table):
                for other in (r for r in self.references if r.name == own.name and r.unique and r.table not in seen):
                    todo.append((other.table, [*steps, (own, other)], seen | {other.table}))
        raise ValueError(f"{column} cannot be reached from {start}")

    def sql(self, text: str) -> DataFrame:
        """A query in SQL: SELECT columns and METRIC(name) [AS alias] FROM __semantic.__table [WHERE ...] [GROUP BY ...].

        What is selected besides metrics is the grain; GROUP BY, if given, must name it. ORDER BY and LIMIT apply to the
        result.
        """
        m = SEMANTIC.fullmatch(" ".join(text.split()).rstrip(" ;"))
        if m is None:
            raise ValueError("a semantic query reads SELECT ... FROM __semantic.__table [WHERE ...] [GROUP BY ...] [ORDER BY ...] [LIMIT n]")
        metrics, grain, out = [], [], []
        for item in re.split(r",(?![^(]*\))", m["items"]):
            one = ITEM.fullmatch(item.strip())
            if one is None:
                raise ValueError(f"{item.strip()} is neither a column nor METRIC(name)")
            (metrics if one["metric"] else grain).append(name := one["metric"] or one["column"])
            out.append((name, one["alias"] or name))
        if m["group"] is not None and {g.strip() for g in m["group"].split(",")} not in ({*grain}, {str(i + 1) for i, (n, _) in enumerate(out) if n in grain}):
            raise ValueError("GROUP BY does not name the selected columns")
        rows = self.query(metrics, grain, m["where"]).select(*[F.col(n).alias(a) for n, a in out])
        for term in m["order"].split(",") if m["order"] else ():
            words = term.split()
            if len(words) > 2 or words[-1].lower() not in (words[0].lower(), "asc", "desc"):
                raise ValueError(f"cannot order by {term.strip()}")
        if m["order"]:
            rows = rows.orderBy(*[F.col(t.split()[0]).desc() if t.lower().endswith(" desc") else F.col(t.split()[0]) for t in map(str.strip, m["order"].split(","))])
        return rows.limit(int(m["limit"])) if m["limit"] else rows

    def tables_with(self, column: str, start: str) -> list[str]:
        """Tables joinable from `start` that own the column."""
        out = []
        for t in self.tables:
            if column in self.tables[t].columns:
                try:
                    if t == start or self.path(start, column):
                        out.append(t)
                except ValueError:
                    continue
        return out

    def aggregated(self, table: str, metrics: Sequence[Metric], group_by: Sequence[str], where: str | None) -> DataFrame:
        """One row per grain of one measured table."""
        rows, joined = self.tables[table], {table}
        for column in dict.fromkeys([*group_by, *(c for m in metrics for c in m.needs)]):
            for own, other in self.path(table, column):
                if other.table in joined:
                    continue
                right = self.tables[other.table]
                keep = [c for c in right.columns if c not in rows.columns]
                right = right.select(F.col(other.column).alias("__ref"), *keep)
                rows = rows.join(right, rows[own.column] == right["__ref"], "left").drop("__ref")
                joined.add(other.table)
        if where:
            rows = rows.where(where)
        return rows.groupBy(*group_by).agg(*[m.aggregate().alias(m.name) for m in metrics])

    def query(self, metrics: Sequence[str], group_by: Sequence[str], where: str | None = None, match_nulls: bool = False) -> DataFrame:
        """The metrics at a grain. `where` filters the first measured table's rows.

        Grains of several tables meet by '=' and come from whichever side has them; with match_nulls null grains meet too.
        """
        by_table: dict[str, list[Metric]] = {}
        for leaf in self.leaves(metrics):
            by_table.setdefault(leaf.table, []).append(leaf)
        out: DataFrame | None = None
        for i, (table, own) in enumerate(by_table.items()):
            part = self.aggregated(table, own, group_by, where if i == 0 else None)
            if out is None:
                out = part
                continue
            right = part.select(*[F.col(c).alias(f"__r_{c}") for c in group_by], *[m.name for m in own])
            same = [(out[c].eqNullSafe(right[f"__r_{c}"]) if match_nulls else out[c] == right[f"__r_{c}"]) for c in group_by]
            both = out.join(right, reduce(operator.and_, same, F.lit(True)), "full_outer")
            kept = [c for c in out.columns if c not in group_by]
            out = both.select(*[F.coalesce(F.col(c), F.col(f"__r_{c}")).alias(c) for c in group_by], *kept, *[m.name for m in own])
        values: dict[str, Column] = {}

        def value(name: str) -> Column:
            if name not in values:
                metric = self.metrics[name]
                values[name] = F.col(name) if metric.formula is None else metric.formula({m: value(m) for m in metric.inputs})
            return values[name]

        return out.select(*group_by, *[value(m).alias(m) for m in metrics])
