"""Write operators as pure functions: each gives the next state of a table from its present state and new rows.

Sinks (sparkmodel.plans.storage) persist the result by writing a new directory and switching to it, so a table can be
read while its next state is computed and a failed write leaves the present state alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmodel.functions.columns import ColumnLike, any_of, as_column
from sparkmodel.functions.frames import align


def replaced(target: DataFrame | None, source: DataFrame) -> DataFrame:
    """Full refresh: the source, in the target's columns and types if there is a target."""
    return source if target is None else align(source, target.schema)


def appended(target: DataFrame, source: DataFrame) -> DataFrame:
    return target.unionByName(align(source, target.schema))


def overwritten_range(target: DataFrame, source: DataFrame, time_column: str, start: Any, end: Any) -> DataFrame:
    """Rows of the range (both ends inside) come from the source alone; source rows outside of it are ignored.

    The range is cleared even where the source has no rows for it. Rows without a time stay.
    """
    inside = F.col(time_column).between(start, end)
    kept = target.where(~inside | F.col(time_column).isNull())
    return kept.unionByName(align(source.where(inside), target.schema))


def overwritten_partitions(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partitions that the source has rows for come from the source alone; null is a partition of its own."""
    source = align(source, target.schema)
    fresh = source.select([F.col(k).alias(f"__key_{k}") for k in keys]).distinct()
    same = [target[k].eqNullSafe(fresh[f"__key_{k}"]) for k in keys]
    return target.join(fresh, same, "left_anti").unionByName(source)


@dataclass(frozen=True)
class When:
    """A clause for matched rows: update some columns, or delete, if the condition (on source.* and target.*) holds."""

    update: dict[str, str] | None = None
    delete: bool = False
    condition: str | None = None


def first_per_key(source: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """One row per key: the first in `order`, or in the order of all columns."""
    by = list(order) or [F.col(f"`{c}`") for c in source.columns]
    window = Window.partitionBy(*keys).orderBy(*by)
    return source.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")


def merged(target: DataFrame, source: DataFrame, keys: Sequence[str], when: Sequence[When] = (), merge_filter: str | None = None, order: Sequence[Column] = ()) -> DataFrame:
    """Rows with a known key are updated, others inserted: one full outer join.

    Clauses are tried in turn and the first whose condition holds decides; a row that none takes stays. Without clauses
    all columns are updated. merge_filter is part of the match: a source row whose key is known but for which it does
    not hold counts as new and is inserted beside the present row. Keys compare by '=', so null keys never match.
    Clauses and filter name columns as source.x and target.x. Of source rows with equal keys the first is used.
    """
    columns = target.columns
    source = first_per_key(align(source, target.schema), keys, order)
    t = target.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("target"), *[F.col(f"`{k}`").alias(f"__t_{k}") for k in keys])
    s = source.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("source"), *[F.col(f"`{k}`").alias(f"__s_{k}") for k in keys])
    on = [F.col(f"__t_{k}") == F.col(f"__s_{k}") for k in keys]
    if merge_filter is not None:
        on.append(F.expr(merge_filter))
    rows = t.join(s, on, "full_outer")
    matched = F.col("target").isNotNull() & F.col("source").isNotNull()
    clauses = list(when) or [When(update={c: f"source.`{c}`" for c in columns})]
    choice, drop = F.lit(None).cast("int"), []
    for i, clause in reversed(list(enumerate(clauses))):
        holds = F.lit(True) if clause.condition is None else F.coalesce(F.expr(clause.condition), F.lit(False))
        choice = F.when(holds, F.lit(i)).otherwise(choice)
        drop += [i] if clause.delete else []
    rows = rows.withColumn("__clause", F.when(matched, choice))
    if drop:
        rows = rows.where(F.coalesce(~F.col("__clause").isin(drop), F.lit(True)))
    out = []
    for c in columns:
        value = F.when(F.col("target").isNull(), F.col(f"source.`{c}`")).otherwise(F.col(f"target.`{c}`"))
        for i, clause in enumerate(clauses):
            if clause.update and c in clause.update:
                value = F.when(F.col("__clause") == i, F.expr(clause.update[c])).otherwise(value)
        out.append(value.cast(target.schema[c].dataType).alias(c))
    return rows.select(*out)


def merged_if_changed(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """merged(), but a matched row is only taken over if some column differs, nulls being equal to each other."""
    rest = [c for c in target.columns if c not in keys]
    differs = " OR ".join(f"NOT (source.`{c}` <=> target.`{c}`)" for c in rest) or "false"
    return merged(target, source, keys, [When(update={c: f"source.`{c}`" for c in rest}, condition=differs)], order=order)


def logically_merged(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Merge without clauses: rows with one of the source's keys are removed, then one row for each key is added."""
    source = first_per_key(align(source, target.schema), keys, order)
    return target.join(source.select(*keys), list(keys), "left_anti").unionByName(source)


EPOCH = datetime(1970, 1, 1)


@dataclass(frozen=True)
class History:
    """How a table keeps the versions of its rows (slowly changing dimension of type 2).

    Versions change by time if `updated_at` is given without `columns`, else by comparing `columns` ('*': all others).
    invalidate_hard_deletes closes rows whose key the source no longer has; left open, historized() does so and a model
    does not. updated_at_as_valid_from starts a new key at
    its updated_at, execution_time_as_valid_from a first load at the execution time; otherwise these start at the epoch.
    """

    keys: Sequence[ColumnLike]
    updated_at: str | None = None
    columns: Sequence[str] | str | None = None
    valid_from: str = "valid_from"
    valid_to: str = "valid_to"
    time_type: T.DataType = field(default_factory=T.TimestampNTZType)
    invalidate_hard_deletes: bool | None = None
    updated_at_as_valid_from: bool = False
    execution_time_as_valid_from: bool = False

    def __post_init__(self) -> None:
        if not self.keys:
            raise ValueError("a history needs keys")
        if self.columns is None and self.updated_at is None:
            raise ValueError("a history needs updated_at or columns")
        if self.columns is not None and (self.updated_at is not None or self.updated_at_as_valid_from):
            raise ValueError("columns exclude updated_at and updated_at_as_valid_from")
        if self.columns is None and self.execution_time_as_valid_from:
            raise ValueError("execution_time_as_valid_from needs columns")

    def schema(self, source: T.StructType) -> T.StructType:
        return T.StructType([*source.fields, T.StructField(self.valid_from, self.time_type), T.StructField(self.valid_to, self.time_type)])


def historized(target: DataFrame | None, source: DataFrame, history: History, execution_time: datetime, first_load: bool = False, keep_closed: bool = True, mark: str | None = None) -> DataFrame:
    """The next state of a table of versions.

    Closed versions stay as they are. Open ones meet the source's rows in one full outer join: where the row changed the
    open version is closed and a new one opened, keys that are new open a version, keys that are gone are closed if so
    asked. Columns that are null in an open version take the source's value. On a first load the table's rows are ignored.
    Without keep_closed those that were closed before are left out; `mark` names a further column that tells whether a
    row is not as it was.
    """
    own = [c for c in (target or source).columns if c not in (history.valid_from, history.valid_to)]
    time, now = history.time_type, F.lit(execution_time).cast(history.time_type)
    by_time = history.columns is None
    if by_time and history.updated_at not in own:
        raise ValueError(f"no column {history.updated_at}")
    first = target is None or first_load
    if first:
        target = source.sparkSession.createDataFrame([], history.schema(source.select(own).schema))
    key_names = [f"__key_{i}" for i in range(len(history.keys))]
    keys = [as_column(k).alias(n) for k, n in zip(history.keys, key_names, strict=True)]
    rows = source.select(*[F.col(f"`{c}`") for c in own], *keys)
    if by_time:
        rows = rows.withColumn(history.updated_at, F.col(history.updated_at).cast(time))
    latest_first = [F.col(history.updated_at).desc_nulls_last()] if by_time else []
    rows = first_per_key(rows, key_names, [*latest_first, *[F.col(f"`{c}`") for c in own]])
    if first:
        # nothing to join: every row opens a version
        start = (F.col(f"`{history.updated_at}`") if history.updated_at_as_valid_from else F.lit(EPOCH)) if by_time else F.lit(EPOCH) if first_load and not history.execution_time_as_valid_from else now
        return rows.select(*[F.col(f"`{c}`").cast(target.schema[c].dataType).alias(c) for c in own], start.cast(time).alias(history.valid_from), F.lit(None).cast(time).alias(history.valid_to), *([F.lit(True).alias(mark)] if mark else []))
    rows = rows.select(F.struct(*[F.col(f"`{c}`").cast(target.schema[c].dataType).alias(c) for c in own]).alias("s"), *key_names)
    closed, live = target.where(F.col(history.valid_to).isNotNull()), target.where(F.col(history.valid_to).isNull())
    opened = live.select(F.struct(*[F.col(f"`{c}`") for c in target.columns]).alias("t"), *[k.alias(f"__t{n}") for k, n in zip(map(as_column, history.keys), key_names, strict=True)])
    same = [F.col(f"__t{n}") == F.col(n) for n in key_names]
    joined = opened.join(rows, same, "full_outer")
    gone = F.col("s").isNull()
    present = F.col("t").isNotNull() & F.col("s").isNotNull()
    if by_time:
        since = F.col(f"s.`{history.updated_at}`")
        changed = present & F.coalesce(since > F.col(f"t.`{history.updated_at}`").cast(time), F.lit(False))
        closes_at = since
        # a key that was closed before starts where its last version ended, if that is later
        ended = closed.groupBy(*[k.alias(f"__e{n}") for k, n in zip(map(as_column, history.keys), key_names, strict=True)]).agg(F.max(history.valid_to).alias("ended"))
        joined = joined.join(ended, [F.col(f"__e{n}") == F.col(n) for n in key_names], "left")
        fresh = since if history.updated_at_as_valid_from else F.lit(EPOCH).cast(time)
        starts = F.when(F.col("ended").isNotNull(), F.when(F.col("ended") > since, F.col("ended")).otherwise(since)).otherwise(fresh)
    else:
        since = closes_at = now
        checked = [c for c in own if c not in [k for k in history.keys if isinstance(k, str)]] if history.columns == "*" else list(history.columns)
        changed = present & any_of(*[~F.col(f"s.`{c}`").eqNullSafe(F.col(f"t.`{c}`")) for c in checked])
        starts = now
    joined = joined.withColumns({"__changed": changed, "__starts": starts.cast(time), "__closes": closes_at.cast(time)})
    ends = F.when(F.col("__changed"), F.col("__closes"))
    if history.invalidate_hard_deletes is not False:
        ends = ends.when(gone, now)
    is_new = F.col("t").isNull()
    filled = any_of(*[F.col(f"t.`{c}`").isNull() & F.col(f"s.`{c}`").isNotNull() for c in own])
    standing = joined.select(
        *[F.coalesce(F.col(f"t.`{c}`"), F.col(f"s.`{c}`")).alias(c) for c in own],
        F.when(is_new, F.col("__starts")).otherwise(F.col(f"t.`{history.valid_from}`")).alias(history.valid_from),
        F.when(~is_new, ends).cast(time).alias(history.valid_to),
        *([(is_new | ends.isNotNull() | F.coalesce(filled, F.lit(False))).alias(mark)] if mark else []),
    )
    new = joined.where("__changed").select(*[F.col(f"s.`{c}`").alias(c) for c in own], F.col("__closes").alias(history.valid_from), F.lit(None).cast(time).alias(history.valid_to), *([F.lit(True).alias(mark)] if mark else []))
    after = standing.unionByName(new)
    if not keep_closed:
        return after
    return closed.select(*target.columns, *([F.lit(False).alias(mark)] if mark else [])).unionByName(after)


#: User materializations by name: insert(target, source, **arguments) gives the next state.
MATERIALIZATIONS: dict[str, Callable[..., DataFrame]] = {}


def materialization(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a function as a user-defined way to write a model."""

    def register(insert: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        MATERIALIZATIONS[name] = insert
        return insert

    return register
