"""Audits whose plans are made for skew and size: against plain versions of themselves."""

import random

import pytest
from pyspark.sql import functions as F

from sparkmodel.operators import audits as A
from sparkmodel.operators.audits import Audit


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("name, patterns, kept", [
    ("match_regex_pattern_list", [r"^\d.*", ".*!$"], {"xy", ""}), ("not_match_regex_pattern_list", [r"^\d.*", ".*!$"], {"1x", "x!", "2!"}),
    ("match_like_pattern_list", ["jim%", "pam%"], {"1x", "x!", "2!", "xy", ""}), ("not_match_like_pattern_list", ["1%", "x%"], {"1x", "x!", "xy"}),
])
def test_pattern_lists(spark, name, patterns, kept):
    """A row violates a match audit if it matches none of the patterns, and its opposite if it matches one; nulls pass."""
    df = frame(spark, [(x,) for x in ("1x", "x!", "2!", "xy", "", None)], "a string")
    assert {r["a"] for r in Audit(name, {"column": "a", "patterns": patterns}).violations(df).collect()} == kept
    assert A.failures(df, [Audit(name, {"column": "a", "patterns": patterns})])[0].count == len(kept)



@pytest.mark.parametrize("kind", ["int", "string", "timestamp_ntz", "decimal(8,1)"])
@pytest.mark.parametrize("step", [-1, 1])
def test_neighbours_over_many_ranges(spark, kind, step):
    """The previous and next row of an order over the whole table, whatever the type, with nulls and few rows a range."""
    rng = random.Random(step)
    numbers = sorted(rng.sample(range(2000), 300))
    df = frame(spark, [(n,) for n in numbers] + [(None,)], "n int")
    make = {"int": F.col("n"), "string": F.lpad(F.col("n").cast("string"), 5, "0"), "timestamp_ntz": F.timestamp_seconds(F.col("n") * 1000).cast("timestamp_ntz"), "decimal(8,1)": F.col("n").cast("decimal(8,1)")}[kind]
    df = df.select("n", make.cast(kind).alias("v"))
    got = {r["n"]: r["near"] for r in A.with_neighbour(df, ["v"], "n", "near", step, per_range=20).collect()}
    ordered = [None, *numbers]
    expected = dict(zip(ordered[1:], ordered[:-1], strict=True)) | {None: None} if step < 0 else dict(zip(ordered[:-1], ordered[1:], strict=True)) | {ordered[-1]: None}
    assert got == expected
    assert len(A.cut_points(df, ["v"], 20)) > 8


def test_repeats_of_a_value_need_no_window_over_it(spark):
    df = frame(spark, [("hot",)] * 500 + [("cold",), (None,), (None,)], "k string")
    found = Audit("unique_values", {"columns": ["k"]}).violations(df)
    assert sorted(r["rank_k"] for r in found.collect()) == sorted([*range(2, 501), 2])
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert A.failures(df, [Audit("unique_values", {"columns": ["k"]})])[0].count == 500
    assert A.failures(df, [Audit("unique_values", {"columns": ["k"], "condition": F.col("k") == "cold"})])[0].count == 0


def test_ranks_of_several_columns_belong_to_one_row(spark):
    rows = [(i % 3, i, "x") for i in range(50)] + [(9, 7, "x")]
    found = A.unique_values(frame(spark, rows, "a int, b int, c string"), ["a", "b"]).collect()
    assert len(found) == 51 - 3 - 1 + sum(r["rank_a"] == 1 for r in found)
    assert sorted(r["rank_a"] for r in found if r["rank_a"] > 1) == sorted([*range(2, 18), *range(2, 18), *range(2, 17)])
    assert [r["rank_b"] for r in found if r["rank_b"] > 1] == [2]


def test_sequences_and_ranges_with_repeats(spark):
    df = frame(spark, [(x,) for x in (1, 2, 2, 2, 3, 5, None)], "v int")
    assert sorted(map(tuple, A.sequential_values(df, "v").collect())) == [(2, 2), (2, 2), (5, 3)]
    ranges = frame(spark, [(0, 5), (5, 9), (5, 9), (9, 9), (9, 9), (20, 10)], "a int, b int")
    got = sorted((r["lower_bound"], r["upper_bound"], r["next_lower_bound"]) for r in A.mutually_exclusive_ranges(ranges, "a", "b").collect())
    assert got == [(5, 9, 5)] + [(20, 10, None)] or sorted(map(str, got)) == sorted(map(str, [(5, 9, 5), (20, 10, None)]))


def test_copies_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(A, "COPIES", 7)
    rows = A.repeated(frame(spark, [("a", 20), ("b", 1), ("c", 2)], "k string, n bigint"), "n", 2).collect()
    assert sorted((r["k"], r["__copy"]) for r in rows) == [("a", i) for i in range(2, 21)] + [("c", 2)]


def test_large_whole_numbers_have_a_text(spark):
    from pyspark.sql import types as T

    from sparkmodel.functions.columns import canonical_text
    from sparkmodel.operators.table_diff import RowDiff

    df = spark.sql("SELECT CAST('99999999999999999999' AS DECIMAL(38,0)) AS k, 1 AS j, 1 AS v")
    assert df.select(canonical_text("k", T.DecimalType(38, 0))).first()[0] == "99999999999999999999"
    assert RowDiff(df, df, ["k", "j"]).summary().first()["full_match_count"] == 1


def test_row_diff_reads_the_join_once(spark):
    left, right = (spark.range(100).selectExpr("id", f"id % {m} AS v") for m in (7, 5))
    from sparkmodel.operators.table_diff import RowDiff

    diff = RowDiff(left, right.where("id % 10 <> 0"), ["id"])
    for df in (diff.samples(3), diff.summary(), diff.column_stats()):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join FullOuter") + plan.count("Join Inner") + plan.count("Join LeftOuter") == 1 and "Expand" not in plan
    assert [(r["side"], r["key"]) for r in diff.samples(2).orderBy("side", F.col("key").cast("int")).collect()] == [("common", "5"), ("common", "6"), ("source_only", "0"), ("source_only", "10")]
