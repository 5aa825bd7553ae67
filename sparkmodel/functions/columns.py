"""Column builders: keys, null-safe arithmetic, distances, canonical text, and helpers over lists of columns."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterable
from typing import Any, TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

A = TypeVar("A")
ColumnLike = Column | str
#: Text that stands for a null part of a surrogate key. Keys only agree with another engine's if the text does.
NULL_PART = "_surrogate_key_null_"


def as_column(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def each(items: Iterable[A] | A, make: Callable[[A], Any]) -> list[Any]:
    """make(item) of every item, without those for which it gives None; a single item is a list of one."""
    found = items if isinstance(items, (list, tuple, set, range)) else [items]
    return [x for x in map(make, found) if x is not None]


def fold(items: Iterable[A], combine: Callable[[A, A], A]) -> A:
    """Combine items from left to right."""
    return functools.reduce(combine, items)


def keep(items: Iterable[A], wanted: Callable[[A], bool]) -> list[A]:
    return [x for x in items if wanted(x)]


def choose(condition: bool, yes: A, no: A | None = None) -> A | None:
    """A decision taken while the plan is built, so that the branch not taken leaves no trace in it."""
    return yes if condition else no


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of those given; without any it is true."""
    given = [c for c in conditions if c is not None]
    return fold(given, operator.and_) if given else F.lit(True)


def any_of(*conditions: Column | None) -> Column:
    """Disjunction of those given; without any it is true as well."""
    given = [c for c in conditions if c is not None]
    return fold(given, operator.or_) if given else F.lit(True)


def surrogate_key(*parts: ColumnLike, algorithm: str = "md5", null_part: str = NULL_PART) -> Column:
    """Hex digest of the parts as text, joined by '|', with null parts spelled out."""
    text = F.concat_ws("|", *[F.coalesce(as_column(p).cast("string"), F.lit(null_part)) for p in parts])
    if algorithm.lower() == "md5":
        return F.md5(text)
    if algorithm.lower() == "sha256":
        return F.sha2(text, 256)
    raise ValueError(f"unknown hash {algorithm}")


def combined(parts: tuple[ColumnLike, ...], how: Callable[[Column, Column], Column]) -> Column:
    columns = [as_column(p) for p in parts]
    none = all_of(*[c.isNull() for c in columns])
    return F.when(~none, fold([F.coalesce(c, F.lit(0)) for c in columns], how))


def safe_add(*parts: ColumnLike) -> Column:
    """Sum with nulls as 0; null only if every part is."""
    return combined(parts, operator.add)


def safe_sub(*parts: ColumnLike) -> Column:
    """First part minus the others with nulls as 0; null only if every part is."""
    return combined(parts, operator.sub)


def safe_div(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """Quotient, or null where the denominator is 0."""
    return as_column(numerator) / F.nullif(as_column(denominator), F.lit(0))


#: Mean diameter of the earth in miles, and kilometres in a mile, as the results fix them.
EARTH_MILES = 7922
KILOMETRES = {"mi": 1.0, "km": 1.60934}


def haversine(lat1: ColumnLike, lon1: ColumnLike, lat2: ColumnLike, lon2: ColumnLike, unit: str = "mi") -> Column:
    """Great-circle distance of two points given in degrees."""
    if unit not in KILOMETRES:
        raise ValueError("unit must be 'mi' or 'km'")
    a, b, c, d = map(as_column, (lat1, lon1, lat2, lon2))

    def half_chord(x: Column, y: Column) -> Column:
        return F.pow(F.sin(F.radians((y - x) / 2)), 2)

    inner = half_chord(a, c) + F.cos(F.radians(a)) * F.cos(F.radians(c)) * half_chord(b, d)
    return EARTH_MILES * F.asin(F.sqrt(inner)) * KILOMETRES[unit]


def canonical_text(c: ColumnLike, kind: T.DataType, decimals: int = 3) -> Column:
    """One spelling for each value, whatever the engine that holds it; null stays null.

    Booleans are 1 and 0, whole numbers plain digits, fractional ones have `decimals` places, times have microseconds
    in UTC, and nested values are JSON.
    """
    column = as_column(c)
    if isinstance(kind, T.BooleanType):
        return column.cast("int").cast("string")
    if isinstance(kind, T.IntegralType) or isinstance(kind, T.DecimalType) and kind.scale == 0:
        return column.cast("string")
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return column.cast(f"decimal(38,{decimals})").cast("string")
    if isinstance(kind, T.DateType):
        return F.date_format(column, "yyyy-MM-dd")
    if isinstance(kind, T.TimestampType):
        return F.date_format(F.to_utc_timestamp(column, F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(kind, T.TimestampNTZType):
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    return column.cast("string")


def row_key_text(df: DataFrame, columns: list[str]) -> Column:
    """The canonical texts of several columns, nulls empty, joined by commas."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return F.concat_ws(",", *[F.coalesce(canonical_text(df[c], kinds[c]), F.lit("")) for c in columns])


def chopped(c: ColumnLike, digits: int) -> Column:
    """A timestamp's text with so many digits of the second (0 to 6), the rest cut off and not rounded."""
    text = F.date_format(as_column(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.substring(text, 1, 20 + digits if digits else 19)
