"""Interval algebra on DataFrames, for ledgers too large for the driver. Intervals are half-open: [start, end)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Touching or overlapping intervals of a key joined to one."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce(F.col(start) > F.max(end).over(before), F.lit(True)).cast("int")
    marked = df.withColumn("__opens", opens).withColumn("__island", F.sum("__opens").over(upto))
    return marked.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def grid(df: DataFrame, start: str, end: str, step: str, name: str = "start") -> DataFrame:
    """The starts of all steps of a row's range (end excluded), one row each."""
    last = F.col(end) - F.expr(f"INTERVAL {step}")
    return df.select("*", F.explode(F.when(F.col(start) <= last, F.sequence(F.col(start), last, F.expr(f"INTERVAL {step}"))).otherwise(F.array())).alias(f"__{name}")).drop(start, end).withColumnRenamed(f"__{name}", name)


def missing(wanted: DataFrame, loaded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Steps of the grid that have not been loaded."""
    return wanted.join(loaded.select(*keys).distinct(), list(keys), "left_anti")


def missing_with_lookback(wanted: DataFrame, loaded: DataFrame, time: str, steps: int) -> DataFrame:
    """Steps not loaded, and the `steps` ones before each of these, which late data may have changed."""
    gone = missing(wanted, loaded, [time])
    moved = gone.select(F.explode(F.sequence(F.date_sub(F.col(time), steps), F.col(time), F.expr("INTERVAL 1 DAY"))).alias(time)).distinct()
    return wanted.join(moved, [time], "left_semi")


def subtracted(left: DataFrame, right: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """What of the left intervals the right ones do not cover; an interval may be split.

    Both sides' ends are sorted into one series of events per key, and running counts tell where only the left is open:
    no pairs of intervals are formed.
    """
    def events(df: DataFrame, side: int) -> DataFrame:
        parts = F.array(F.struct(F.col(start).alias("at"), F.lit(1 - side).alias("left"), F.lit(side).alias("right")), F.struct(F.col(end).alias("at"), F.lit(side - 1).alias("left"), F.lit(-side).alias("right")))
        return df.select(*keys, F.explode(parts).alias("e")).select(*keys, "e.*")

    every = events(left, 0).unionByName(events(right, 1)).groupBy(*keys, "at").agg(F.sum("left").alias("left"), F.sum("right").alias("right"))
    upto = Window.partitionBy(*keys).orderBy("at")
    pieces = every.select(*keys, F.col("at").alias(start), F.lead("at").over(upto).alias(end), F.sum("left").over(upto).alias("l"), F.sum("right").over(upto).alias("r"))
    return islands(pieces.where(f"l > 0 AND r = 0 AND `{end}` IS NOT NULL").select(*keys, start, end), keys, start, end)
