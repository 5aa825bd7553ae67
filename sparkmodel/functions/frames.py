"""DataFrame builders: projections, unions, pivots, deduplication, date series and optional clauses."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmodel.functions.columns import ColumnLike, any_of, as_column


def star(df: DataFrame, exclude: Iterable[str] = (), prefix: str = "", suffix: str = "", types: dict[str, str] | None = None) -> DataFrame:
    """All columns but some (names compare without case), renamed by prefix and suffix, cast where types are given."""
    out = {c.lower() for c in exclude}
    kept = [c for c in df.columns if c.lower() not in out]
    return df.select([(df[f"`{c}`"].cast(types[c]) if types and c in types else df[f"`{c}`"]).alias(f"{prefix}{c}{suffix}") for c in kept])


def union_common(*frames: DataFrame, how: str = "all", condition: bool = True) -> DataFrame:
    """Rows of all frames over the columns that all have under one name and type, in the first one's order.

    If the condition is false only the first frame is taken. how is 'all' or 'distinct'.
    """
    first, *others = frames if condition else frames[:1]
    shared = [f.name for f in first.schema.fields if all(any(g.name == f.name and g.dataType == f.dataType for g in o.schema.fields) for o in others)]
    if not shared:
        raise ValueError("the frames share no column")
    out = first.select(shared)
    for other in others:
        out = out.unionByName(other.select(shared))
    return out.distinct() if how.lower() == "distinct" else out


AGGREGATES: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg}


def pivot_columns(column: ColumnLike, values: Sequence[Any], aggregate: str = "sum", then: Any = 1, otherwise: Any = 0, prefix: str = "", suffix: str = "") -> list[Column]:
    """One conditional aggregate for each value, named by it: use in a single agg(), so that the rows are read once."""
    use = AGGREGATES[aggregate]
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [use(F.when(as_column(column) == v, lit(then)).otherwise(lit(otherwise))).alias(f"{prefix}{v}{suffix}") for v in values]


def order_term(term: ColumnLike) -> Column:
    """'name [asc|desc] [nulls first|last]' as a sort order."""
    if isinstance(term, Column):
        return term
    words = term.split()
    rest = [w.lower() for w in words[1:]]
    column, down = F.col(words[0]), "desc" in rest
    if "nulls" in rest:
        first = rest[rest.index("nulls") + 1] == "first"
        return {(True, True): column.desc_nulls_first, (True, False): column.desc_nulls_last, (False, True): column.asc_nulls_first, (False, False): column.asc_nulls_last}[down, first]()
    return column.desc() if down else column.asc()


def deduplicate(df: DataFrame, by: Sequence[ColumnLike], order: Sequence[ColumnLike]) -> DataFrame:
    """Of the rows with equal `by` the first in `order`."""
    rank = "__rank"
    while rank in df.columns:
        rank += "_"
    window = Window.partitionBy(*[as_column(c) for c in by]).orderBy(*[order_term(o) for o in order])
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) == 1).drop(rank)


STEPS = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTH", "year": "INTERVAL 1 YEAR"}


def date_spine(spark: SparkSession, part: str, start: date | str, end: date | str) -> DataFrame:
    """Dates from start to end, both inside, in steps of a part, as date_<part>."""
    start, end = (d if isinstance(d, date) else date.fromisoformat(d) for d in (start, end))
    if part not in STEPS:
        raise ValueError(f"unknown date part {part}")
    if start > end:
        raise ValueError("the start lies after the end")
    days = F.sequence(F.lit(start), F.lit(end), F.expr(STEPS[part]))
    return spark.range(1).select(F.explode(days).alias(f"date_{part}"))


def clause(df: DataFrame, condition: bool, apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """apply(df) if the condition holds while the plan is built, else df: optional joins, filters, orders or limits."""
    return apply(df) if condition else df


def keys_in(df: DataFrame, columns: Sequence[str], keys: DataFrame, negate: bool = False) -> DataFrame:
    """Rows whose tuple of columns is (or is not) among the keys: a semi or anti join."""
    return df.join(keys.select(*columns).distinct(), list(columns), "left_anti" if negate else "left_semi")


def keyset_page(df: DataFrame, columns: Sequence[str], after: Sequence[Any] | None, size: int) -> DataFrame:
    """The next `size` rows in order of the columns after a tuple of values: a page that needs no offset."""
    if after is not None:
        terms = []
        for i, c in enumerate(columns):
            term = F.col(c) > F.lit(after[i])
            for j in range(i):
                term = (F.col(columns[j]) == F.lit(after[j])) & term
            terms.append(term)
        df = df.where(any_of(*terms))
    return df.orderBy(*columns).limit(size)


def align(df: DataFrame, target: Any) -> DataFrame:
    """df with the columns of a schema, in its order and types; columns that df lacks are null, others are dropped."""
    have = set(df.columns)
    return df.select([(F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in target.fields])
