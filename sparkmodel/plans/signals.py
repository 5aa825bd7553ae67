"""Signals: functions that decide which intervals of a model are ready to be loaded."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

from sparkmodel.plans.intervals import Interval

Signal = Callable[[list[Interval]], bool | list[Interval]]


def newer_than(spark: SparkSession, paths: Iterable[str], millis: int) -> bool:
    """Whether a file below one of the paths was changed after a time."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for text in paths:
        path = jvm.org.apache.hadoop.fs.Path(text)
        files = path.getFileSystem(conf).listFiles(path, True)
        while files.hasNext():
            if files.next().getModificationTime() > millis:
                return True
    return False


def fresh(spark: SparkSession, paths: Iterable[str], last_load: Callable[[], int]) -> Signal:
    """Ready only if an input changed since the last load (epoch millis)."""
    listed = list(paths)
    return lambda intervals: newer_than(spark, listed, last_load())


def until(limit: Callable[[], int]) -> Signal:
    """Ready as far as the source is complete: intervals that end by a time."""
    return lambda intervals: [i for i in intervals if i[1] <= limit()]
