"""Schema evolution: what must change to get from one schema to another, whether that loses data, and the rewrite."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Policy(Enum):
    ERROR = "error"
    WARN = "warn"
    ALLOW = "allow"
    IGNORE = "ignore"


class EvolutionError(Exception):
    pass


@dataclass(frozen=True)
class Change:
    """One step: kind is add, drop or alter; path leads into structs, an element of an array being 'element'."""

    kind: str
    path: tuple[str, ...]
    before: T.DataType | None = None
    after: T.DataType | None = None

    @property
    def destructive(self) -> bool:
        return self.kind == "drop"

    @property
    def additive(self) -> bool:
        return self.kind == "add"


#: Types that each type's values fit into without loss.
WIDER = {
    T.ByteType: (T.ShortType, T.IntegerType, T.LongType),
    T.ShortType: (T.IntegerType, T.LongType),
    T.IntegerType: (T.LongType, T.DoubleType),
    T.FloatType: (T.DoubleType,),
    T.DateType: (T.TimestampType, T.TimestampNTZType),
}


def compatible(before: T.DataType, after: T.DataType) -> bool:
    """Whether values keep their meaning: the same type, a wider one, or more digits."""
    if isinstance(before, T.DecimalType) and isinstance(after, T.DecimalType):
        return after.scale >= before.scale and after.precision - after.scale >= before.precision - before.scale
    return before == after or isinstance(after, WIDER.get(type(before), ()))


def changes(before: T.StructType, after: T.StructType, path: tuple[str, ...] = ()) -> list[Change]:
    """Steps in the order drop, add, alter. A type that is not compatible is dropped and added anew."""
    left, right = ({f.name: f.dataType for f in s.fields} for s in (before, after))
    drops = [Change("drop", (*path, n), t) for n, t in left.items() if n not in right]
    adds = [Change("add", (*path, n), None, t) for n, t in right.items() if n not in left]
    alters: list[Change] = []
    for name in (n for n in left if n in right):
        for change in type_changes(left[name], right[name], (*path, name)):
            {"drop": drops, "add": adds}.get(change.kind, alters).append(change)
    return drops + adds + alters


def type_changes(before: T.DataType, after: T.DataType, path: tuple[str, ...]) -> Iterator[Change]:
    if before == after:
        return
    if isinstance(before, T.StructType) and isinstance(after, T.StructType):
        yield from changes(before, after, path)
    elif isinstance(before, T.ArrayType) and isinstance(after, T.ArrayType):
        yield from type_changes(before.elementType, after.elementType, (*path, "element"))
    elif compatible(before, after):
        yield Change("alter", path, before, after)
    else:
        yield Change("drop", path, before)
        yield Change("add", path, None, after)


def enforce(steps: list[Change], destructive: Policy = Policy.ERROR, additive: Policy = Policy.ALLOW) -> list[Change]:
    """The steps that the policies let through; ERROR raises, IGNORE leaves steps out."""
    out = steps
    for sort, policy in (("destructive", destructive), ("additive", additive)):
        own = [s for s in steps if getattr(s, sort)]
        if not own:
            continue
        text = f"{sort} changes of " + ", ".join(".".join(s.path) for s in own)
        if policy is Policy.ERROR:
            raise EvolutionError(text)
        if policy is Policy.WARN:
            warnings.warn(text, stacklevel=2)
        if policy is Policy.IGNORE:
            out = [s for s in out if s not in own]
    return out


def applied(before: T.StructType, steps: list[Change]) -> T.StructType:
    """The schema after the steps."""
    fields = {f.name: f.dataType for f in before.fields}
    for step in (s for s in steps if len(s.path) == 1):
        if step.kind == "drop":
            fields.pop(step.path[0])
        else:
            fields[step.path[0]] = step.after
    for name in {s.path[0] for s in steps if len(s.path) > 1}:
        inner = [Change(s.kind, s.path[1:], s.before, s.after) for s in steps if len(s.path) > 1 and s.path[0] == name]
        kind = fields[name]
        if isinstance(kind, T.ArrayType):
            fields[name] = T.ArrayType(applied(kind.elementType, [Change(s.kind, s.path[1:], s.before, s.after) for s in inner]) if isinstance(kind.elementType, T.StructType) and inner[0].path[0] == "element" and len(inner[0].path) > 1 else inner[-1].after, kind.containsNull)
        else:
            fields[name] = applied(kind, inner)
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def converted(value: Column, before: T.DataType, after: T.DataType) -> Column:
    if before == after:
        return value
    if isinstance(before, T.StructType) and isinstance(after, T.StructType):
        have = {f.name: f.dataType for f in before.fields}
        parts = [(converted(value[f.name], have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in after.fields]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(before, T.ArrayType) and isinstance(after, T.ArrayType):
        return F.transform(value, lambda x: converted(x, before.elementType, after.elementType))
    return value.cast(after) if compatible(before, after) else F.lit(None).cast(after)


def evolved(df: DataFrame, after: T.StructType) -> DataFrame:
    """The rows in another schema: new columns and replaced ones are null, nested ones are rebuilt."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return df.select([(converted(F.col(f"`{f.name}`"), have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in after.fields])
