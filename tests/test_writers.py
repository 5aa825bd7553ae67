"""Goldens of the write operators."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkmodel.operators import writers as W


def rows(df, *columns):
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=str)


def day(text):
    return datetime.fromisoformat(text)


def test_time_range_clears_the_range_even_without_rows(spark):
    target = spark.createDataFrame([(1, "2022-01-01"), (2, "2022-01-02"), (3, "2022-01-03"), (9, None)], "id int, ds string")
    source = spark.createDataFrame([(10, "2022-01-03"), (4, "2022-01-04"), (7, "2022-01-09")], "id int, ds string")
    out = W.overwritten_range(target, source, "ds", "2022-01-02", "2022-01-04")
    assert rows(out) == rows(spark.createDataFrame([(1, "2022-01-01"), (9, None), (10, "2022-01-03"), (4, "2022-01-04")], "id int, ds string"))


def test_partitions_in_the_source_are_replaced_nulls_too(spark):
    target = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "key string, v int")
    source = spark.createDataFrame([("a", 2), (None, 5)], "key string, v int")
    assert rows(W.overwritten_partitions(target, source, ["key"])) == rows(spark.createDataFrame([("b", 1), ("a", 2), (None, 5)], "key string, v int"))


def test_merge_updates_and_inserts(spark):
    target = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "id int, v string")
    source = spark.createDataFrame([(2, "y"), (4, "y"), (5, "y"), (None, "z")], "id int, v string")
    assert rows(W.merged(target, source, ["id"])) == rows(spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "y"), (5, "y"), (None, "z")], "id int, v string"))


def test_merge_clauses_first_match_wins_and_delete(spark):
    target = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id int, v int")
    source = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id int, v int")
    clauses = [W.When(delete=True, condition="target.v = 1"), W.When(update={"v": "source.v + target.v"}, condition="source.v < 30")]
    assert rows(W.merged(target, source, ["id"], clauses)) == [(2, 22), (3, 3)]


def test_merge_of_repeated_keys_uses_the_given_order(spark):
    target = spark.createDataFrame([(1, 1)], "id int, v int")
    source = spark.createDataFrame([(1, 5), (1, 7), (2, 1), (2, 9)], "id int, v int")
    assert rows(W.merged(target, source, ["id"], order=[F.desc("v")])) == [(1, 7), (2, 9)]
    assert rows(W.logically_merged(target, source, ["id"], [F.desc("v")])) == [(1, 7), (2, 9)]


def test_history_by_time(spark):
    kind = W.History(keys=["id"], updated_at="updated_at")
    first = spark.createDataFrame([(1, "a", day("2022-01-01")), (2, "b", day("2022-01-02")), (3, "c", day("2022-01-03"))], "id int, name string, updated_at timestamp_ntz")
    second = spark.createDataFrame([(1, "x", day("2022-01-04")), (3, "c", day("2022-01-03")), (4, "d", day("2022-01-04"))], "id int, name string, updated_at timestamp_ntz")
    one = W.historized(None, first, kind, day("2023-01-01"), first_load=True)
    two = W.historized(one, second, kind, day("2023-01-05"))
    epoch = day("1970-01-01")
    assert rows(two, "id", "name", "valid_from", "valid_to") == sorted(
        [(1, "a", epoch, day("2022-01-04")), (1, "x", day("2022-01-04"), None), (2, "b", epoch, day("2023-01-05")), (3, "c", epoch, None), (4, "d", epoch, None)], key=str
    )


def test_history_by_column(spark):
    kind = W.History(keys=["id"], columns=["name", "status"])
    first = spark.createDataFrame([(1, "a", "active"), (2, "b", "inactive"), (3, "c", "active"), (4, "d", "active")], "id int, name string, status string")
    second = spark.createDataFrame([(1, "x", "active"), (3, "c", "active"), (4, "d", "inactive"), (5, "e", "inactive")], "id int, name string, status string")
    now, epoch = day("2023-01-05"), day("1970-01-01")
    out = W.historized(W.historized(None, first, kind, day("2023-01-01"), True), second, kind, now)
    assert rows(out) == sorted(
        [(1, "a", "active", epoch, now), (1, "x", "active", now, None), (2, "b", "inactive", epoch, now), (3, "c", "active", epoch, None), (4, "d", "active", epoch, now), (4, "d", "inactive", now, None), (5, "e", "inactive", now, None)], key=str
    )


def test_history_takes_the_sources_value_for_nulls(spark):
    kind = W.History(keys=["id"], columns=["status"])
    target = spark.createDataFrame([(1, None, "s", day("1970-01-01"), None)], "id int, name string, status string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    source = spark.createDataFrame([(1, "new", "s")], "id int, name string, status string")
    assert rows(W.historized(target, source, kind, day("2023-01-01")), "id", "name", "valid_to") == [(1, "new", None)]


@pytest.mark.parametrize("bad", [dict(keys=[]), dict(keys=["id"]), dict(keys=["id"], columns="*", updated_at="u"), dict(keys=["id"], updated_at="u", execution_time_as_valid_from=True)])
def test_history_refuses_wrong_arguments(bad):
    with pytest.raises(ValueError):
        W.History(**bad)
