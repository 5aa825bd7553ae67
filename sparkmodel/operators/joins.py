"""Joins on order: the last earlier row, and points in ranges, without comparing every pair of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    """left with the values of the last row of right that has the same keys and is not later; null without one.

    Both sides are put into one order per key, in which the last row of right is carried forward: one shuffle and sort.
    Of rows of right at one time the one with the largest values counts. Rows with null keys or times find nothing.
    """
    names = [f"__{v}" for v in values]
    mine = left.select(F.struct("*").alias("__row"), *[F.col(f"`{k}`").alias(f"__k_{k}") for k in keys], F.col(f"`{time}`").alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(struct_type(right, values)).alias("__v"))
    theirs = right.where(F.col(f"`{time}`").isNotNull()).select(F.lit(None).cast(mine.schema["__row"].dataType).alias("__row"), *[F.col(f"`{k}`").alias(f"__k_{k}") for k in keys], F.col(f"`{time}`").alias("__t"), F.lit(0).alias("__side"), F.struct(*[F.col(f"`{v}`").alias(v) for v in values]).alias("__v"))
    order = Window.partitionBy(*[f"__k_{k}" for k in keys]).orderBy("__t", "__side", "__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = mine.unionByName(theirs).withColumn("__found", F.last("__v", ignorenulls=True).over(order)).where("__side = 1")
    known: Column = F.col("__t").isNotNull()
    for k in keys:
        known = known & F.col(f"__k_{k}").isNotNull()
    return rows.select("__row.*", *[F.when(known, F.col(f"__found.`{v}`")).alias(n) for v, n in zip(values, names, strict=True)]).withColumnsRenamed(dict(zip(names, values, strict=True)))


def struct_type(df: DataFrame, values: Sequence[str]) -> str:
    return df.select(F.struct(*[F.col(f"`{v}`").alias(v) for v in values]).alias("v")).schema["v"].dataType.simpleString()


def in_range(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: int, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of a point and a range [low, high) around it, numbers all, with equal keys.

    Every range is filed under the cells of `width` that it touches, a point under its own: an equi-join, in which a
    point meets the ranges of one cell. A width near that of the usual range suits.
    """
    cell = lambda c: F.floor(F.col(f"`{c}`") / width)
    filed = ranges.where(F.col(f"`{low}`") < F.col(f"`{high}`")).withColumn("__cell", F.explode(F.sequence(cell(low), F.floor((F.col(f"`{high}`") - 1) / width))))
    on = points.withColumn("__cell", cell(point)).join(filed, ["__cell", *keys])
    return on.where((F.col(f"`{point}`") >= F.col(f"`{low}`")) & (F.col(f"`{point}`") < F.col(f"`{high}`"))).drop("__cell")
