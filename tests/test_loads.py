"""Loads that rewrite what they change, state that two processes share, categories of changes, kinds of models."""

import threading
from datetime import date, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmodel.operators.writers import History, When
from sparkmodel.plans.buckets import history_load, merge_load
from sparkmodel.plans.contexts import Context, Ledger
from sparkmodel.plans.models import Kind, Model, coerced_argument, macro, with_changes
from sparkmodel.plans.plan_changes import only_adds_columns
from sparkmodel.plans.storage import Conflict, Files, TableStore


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_merge_of_one_key_leaves_all_other_parts_alone(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}")
    merge_load(store, "t", spark.range(200).selectExpr("id AS k", "id % 7 AS v"), ["k"])
    before = store.parts("t")
    files = {p: sorted(x.name for x in (tmp_path / "t" / p).iterdir()) for p in before.values()}
    assert len(before) == 16
    one = spark.createDataFrame([(5, 99)], "k int, v int")
    merge_load(store, "t", one, ["k"])
    after = store.parts("t")
    assert len([k for k in before if after[k] != before[k]]) == 1 and set(after) == set(before)
    assert all(sorted(x.name for x in (tmp_path / "t" / p).iterdir()) == names for p, names in files.items())
    expected = sorted([(k, k % 7) for k in range(200) if k != 5] + [(5, 99)], key=str)
    assert rows(store.read("t")) == expected
    merge_load(store, "t", one, ["k"])
    assert rows(store.read("t")) == expected
    merge_load(store, "t", spark.createDataFrame([(5, 0), (6, 0)], "k int, v int"), ["k"], [When(delete=True)])
    assert rows(store.read("t")) == sorted([(k, k % 7) for k in range(200) if k not in (5, 6)], key=str)


def test_a_table_of_one_part_is_dealt_into_buckets_once(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}")
    store.write("t", spark.range(50).selectExpr("id AS k", "'old' AS v"))
    merge_load(store, "t", spark.createDataFrame([(1, "new"), (None, "n")], "k bigint, v string"), ["k"], buckets=4)
    assert len(store.parts("t")) == 4 and store.manifest("t")["buckets"] == 4
    assert store.read("t").where("v = 'new'").count() == 1 and store.read("t").count() == 51
    merge_load(store, "t", spark.createDataFrame([(None, "m")], "k bigint, v string"), ["k"])
    assert store.read("t").where("k IS NULL").count() == 2


@pytest.mark.parametrize("hard", [False, True])
def test_a_history_rewrites_changed_open_versions_and_no_closed_ones(spark, tmp_path, hard):
    from sparkmodel.operators.writers import historized

    store, kind = TableStore(spark, f"file://{tmp_path}"), History(keys=["id"], updated_at="at", invalidate_hard_deletes=hard)
    first = spark.range(300).selectExpr("id", "'a' AS v", "TIMESTAMP_NTZ '2024-01-01' AS at")
    history_load(store, "h", first, kind, datetime(2024, 1, 2))
    before = store.parts("h")
    assert all(p.startswith("open|") for p in before)
    second = first.where("id <> 7").withColumns({"v": F.when(F.col("id") == 3, "b").otherwise("a"), "at": F.when(F.col("id") == 3, F.lit(datetime(2024, 2, 1)).cast("timestamp_ntz")).otherwise(F.col("at"))})
    source = second if hard else second.where("id = 3")
    history_load(store, "h", source, kind, datetime(2024, 2, 2))
    after = store.parts("h")
    changed = [p for p in before if after.get(p) != before[p]]
    closed = {p: d for p, d in after.items() if p.startswith("closed|")}
    assert len(changed) == len(closed) == (2 if hard else 1)
    whole = historized(historized(None, first, kind, datetime(2024, 1, 2), True), source, kind, datetime(2024, 2, 2))
    assert rows(store.read("h").select(whole.columns)) == rows(whole)
    third = source.withColumns({"v": F.lit("c"), "at": F.lit(datetime(2024, 3, 1)).cast("timestamp_ntz")}).where("id = 3")
    history_load(store, "h", third, History(keys=["id"], updated_at="at", invalidate_hard_deletes=False), datetime(2024, 3, 2))
    assert {p: d for p, d in store.parts("h").items() if p in closed} == closed
    assert store.read("h").where("id = 3").count() == 3
    unchanged = store.parts("h")
    history_load(store, "h", third, History(keys=["id"], updated_at="at", invalidate_hard_deletes=False), datetime(2024, 3, 3))
    assert store.parts("h") == unchanged


def test_a_key_that_comes_back_starts_where_it_ended(spark, tmp_path):
    store, kind = TableStore(spark, f"file://{tmp_path}"), History(keys=["id"], updated_at="at")
    row = lambda *d: spark.createDataFrame([(1, datetime(*d))] if d else [], "id int, at timestamp_ntz")
    for at, source in ((datetime(2024, 1, 2), row(2024, 1, 1)), (datetime(2024, 2, 1), row()), (datetime(2024, 3, 1), row(2024, 1, 1))):
        history_load(store, "h", source, kind, at)
    assert [(r["valid_from"], r["valid_to"]) for r in store.read("h").orderBy("valid_from").collect()] == [(datetime(1970, 1, 1), datetime(2024, 2, 1)), (datetime(2024, 2, 1), None)]


def test_models_by_key_and_histories_use_buckets(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").createOrReplaceTempView("versions")
    keyed = Model("keyed", "SELECT * FROM versions", kind=Kind.UNIQUE_KEY, keys=["id"], depends_on=[], start="2024-05-01", buckets=3)
    kept = Model("kept", "SELECT * FROM versions", kind=Kind.HISTORY, history=History(keys=["id"], columns=["v"]), depends_on=[], start="2024-05-01", batch_size=1)
    ctx = Context(spark, f"file://{tmp_path}", [keyed, kept])
    ctx.apply(ctx.plan(now="2024-05-02"))
    spark.createDataFrame([(1, "c")], "id int, v string").createOrReplaceTempView("versions")
    ctx.run(now="2024-05-03")
    assert rows(ctx.table("keyed")) == [(1, "c"), (2, "b")]
    # a model leaves versions of keys that are gone open unless it says otherwise
    assert [(r["id"], r["v"], r["valid_to"] is None) for r in ctx.table("kept").orderBy("id", "valid_from").collect()] == [(1, "a", False), (1, "c", True), (2, "b", True)]


def test_two_writers_do_not_lose_each_others_changes(spark, tmp_path):
    one, two = (TableStore(spark, f"file://{tmp_path}/t") for _ in range(2))
    one.write("t", spark.range(3))
    basis = two.manifest("t")
    one.write("t", spark.range(5))
    with pytest.raises(Conflict):
        two.publish("t", basis, {}, T.StructType.fromDDL("id bigint"))
    parts = lambda store, n: store.replace_parts("p", spark.createDataFrame([(f"k{n}", n)], "k string, v int"), F.col("k"))
    parts(one, 0)
    threads = [threading.Thread(target=parts, args=(s, i)) for i, s in enumerate((one, two, one, two), 1)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert rows(one.read("p")) == [(f"k{i}", i) for i in range(5)]
    ledgers = [Ledger(Files(spark, f"file://{tmp_path}/state")) for _ in range(2)]
    book = lambda i: ledgers[i % 2].change_intervals(f"t{i % 3}", lambda have, i=i: [*have, (i, i + 1)])
    threads = [threading.Thread(target=book, args=(i,)) for i in range(30)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert sorted(x for n in range(3) for x in ledgers[0].intervals(f"t{n}")) == [(i, i + 1) for i in range(30)]


def test_a_part_of_a_hot_value_is_cut_by_size(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}")
    hot = spark.range(2000).selectExpr("CASE WHEN id % 3 = 0 THEN 'cold' ELSE 'hot' END AS k", "id")
    store.replace_parts("t", hot, F.col("k"))
    assert sorted(store.parts("t")) == ["cold", "hot"] and store.read("t").where("k = 'hot'").count() == 1333
    plan = hot.withColumn("p", F.col("k")).hint("rebalance", F.col("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in plan


BASE = "SELECT k, sum(v) AS total FROM {t} WHERE v > 0 GROUP BY k"


@pytest.mark.parametrize("after, adds", [
    (BASE, True), (BASE.replace(" AS total", " AS total, max(v) AS top"), True), (BASE.replace("k, sum", "k, k + 1 AS next, sum"), True), (BASE.replace("sum(", "max("), False),
    (BASE.replace("v > 0", "v > 1"), False), (BASE.replace("SELECT k, ", "SELECT "), False), ("SELECT total, k FROM (" + BASE + ")", False), ("SELECT * FROM (" + BASE + ") ORDER BY 1 LIMIT 3", False),
    ("SELECT x.k, x.total, 1 AS one FROM (" + BASE + ") x", True), ("SELECT k, total, explode(array(1, 2)) AS e FROM (" + BASE + ")", False), ("SELECT DISTINCT k, total FROM (" + BASE + ")", False),
    (BASE + " UNION ALL " + BASE, False), (BASE.replace("FROM {t}", "FROM {t} JOIN {t} u USING (k, v)"), False),
])
def test_what_only_adds_columns(spark, after, adds):
    t = spark.createDataFrame([(1, 2)], "k int, v int")
    one, other = (spark.sql(q, t=t) for q in (BASE, after))
    assert only_adds_columns(one, other) == adds


def test_a_change_below_a_projection_or_past_many_columns_is_seen(spark):
    t = spark.createDataFrame([(1, 2)], "k int, v int")
    below = "SELECT k, total * 2 AS twice FROM (SELECT k, {f}(v) AS total FROM {{t}} GROUP BY k)"
    assert not only_adds_columns(spark.sql(below.format(f="sum"), t=t), spark.sql(below.format(f="max").replace("AS twice", "AS twice, 1 AS one"), t=t))
    wide = "SELECT " + ", ".join(f"v + {i} AS c{i}" for i in range(40)) + " FROM {t}"
    assert only_adds_columns(spark.sql(wide, t=t), spark.sql(wide.replace("v + 39 AS c39", "v + 39 AS c39, 7 AS more"), t=t))
    assert not only_adds_columns(spark.sql(wide, t=t), spark.sql(wide.replace("v + 39", "v - 39"), t=t))


def test_an_added_column_is_no_breaking_change(spark, tmp_path):
    spark.createDataFrame([(1, 2), (1, 3)], "k int, v int").createOrReplaceTempView("added_to")
    base = Model("m", "SELECT k, sum(v) AS total FROM added_to GROUP BY k", depends_on=[], start="2024-05-01")
    ctx = Context(spark, f"file://{tmp_path}", [base, Model("child", "SELECT max(total) AS top FROM {m}", start="2024-05-01")])
    ctx.apply(ctx.plan(now="2024-05-02"))
    change = lambda q: {c.name: c.category.value for c in (ctx.add(with_changes(base, query=q)), ctx.plan(now="2024-05-02"))[1].changes}
    assert change(base.query.replace(" AS total", " AS total, count(*) AS n")) == {"m": "non_breaking", "child": "indirect_non_breaking"}
    assert change(base.query.replace("sum(", "max(")) == {"m": "breaking", "child": "indirect_breaking"}
    assert change(base.query.replace(" AS total", " AS total, explode(array(1)) AS e")) == {"m": "breaking", "child": "indirect_breaking"}


def test_functions_give_frames_pandas_or_batches(spark, tmp_path):
    def batches(ctx):
        yield pd.DataFrame({"a": [1], "b": ["x"]})
        yield None
        yield ctx.spark.createDataFrame([(2, "y")], "a bigint, b string")

    def nothing(ctx):
        yield pd.DataFrame({"a": []})

    ctx = Context(spark, f"file://{tmp_path}", [Model("many", batches), Model("none", nothing, columns=T.StructType.fromDDL("a int")), Model("refused", nothing)])
    assert rows(ctx.evaluate("many")) == [(1, "x"), (2, "y")] and ctx.evaluate("none").count() == 0
    with pytest.raises(ValueError, match="declares no columns"):
        ctx.evaluate("refused")


def test_arguments_of_macros_are_coerced():
    @macro()
    def made(a: int, b: list[str], c: bool = False, *rest: float, d: str | None = None, e: tuple[int, str] = (0, "")):
        return a, b, c, rest, d, e

    assert made("3", "x", "yes", "1.5", 2, d=None, e=["4", 5]) == (3, ["x"], True, (1.5, 2.0), None, (4, "5"))
    for kind, value in ((int, "x"), (bool, "maybe"), (tuple[int, int], [1]), (date, "x")):
        with pytest.raises((TypeError, ValueError)):
            coerced_argument(value, kind)


def test_previews_of_forward_only_changes_have_tables_of_their_own(spark, tmp_path):
    base = Model("m", "SELECT 1 AS one", start="2024-05-01")
    ctx = Context(spark, f"file://{tmp_path}", [base, Model("child", "SELECT * FROM {m}", start="2024-05-01")])
    ctx.apply(ctx.plan(now="2024-05-02"))
    ctx.apply(ctx.plan("dev", now="2024-05-02"))
    ctx.add(with_changes(base, query="SELECT 2 AS one", forward_only=True))
    plan = ctx.plan("dev", now="2024-05-02")
    assert plan.deployable == {"m": False, "child": False}
    ctx.apply(plan)
    assert ctx.table("child", "dev").first()[0] == 2 and ctx.table("child").first()[0] == 1


def test_a_frozen_clock_and_common_table_expressions(spark, tmp_path):
    m = Model("m", "WITH a AS (SELECT x, current_date() AS d FROM {t}), b AS (SELECT x + 1 AS y, d FROM a) SELECT y, d FROM b", start="2024-05-01")
    ctx = Context(spark, f"file://{tmp_path}", [m])
    case = {"model": "m", "inputs": {"t": ([(1,)], "x int")}, "expected": ([(2, date(2024, 2, 29))], "y int, d date"), "ctes": {"a": ([(1, date(2024, 2, 29))], "x int, d date"), "b": ([(3, None)], "y int, d date")}, "execution": "2024-02-29"}
    assert {n: d.count() for n, d in ctx.run_tests({"c": case}).items()} == {"c": 0, "c/a": 0, "c/b": 2}


def test_rows_with_nan_and_nested_values_are_compared(spark):
    from sparkmodel.operators.table_diff import multiset_diff

    nan = spark.createDataFrame([(float("nan"), [1, None], (1, "x"), None)], "d double, a array<int>, s struct<p: int, q: string>, n int")
    assert multiset_diff(nan, nan).count() == 0
    assert multiset_diff(nan, nan.withColumn("a", F.array(F.lit(1), F.lit(2)))).count() == 2
    maps = spark.createDataFrame([({"a": 1, "b": 2},)], "m map<string, int>")
    assert multiset_diff(maps, spark.createDataFrame([({"b": 2, "a": 1},)], "m map<string, int>")).count() == 0


def test_joins_on_order(spark):
    from sparkmodel.operators.joins import as_of, in_range

    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c"), (None, 9, "d"), (1, None, "e")], "k int, t int, n string")
    right = spark.createDataFrame([(1, 5, 50), (1, 3, 30), (2, 10, 100), (None, 1, 7), (1, None, 8)], "k int, t int, v int")
    assert rows(as_of(left, right, ["k"], "t", ["v"]).select("n", "v")) == [("a", 50), ("b", None), ("c", None), ("d", None), ("e", None)]
    points, ranges = spark.range(40).selectExpr("id AS p"), spark.createDataFrame([(3, 17, "x"), (17, 17, "none"), (30, 33, "y"), (-9, 2, "z")], "lo bigint, hi bigint, n string")
    expected = sorted((p, n) for p in range(40) for lo, hi, n in ((3, 17, "x"), (30, 33, "y"), (-9, 2, "z")) if lo <= p < hi)
    for width in (1, 4, 100):
        assert sorted(map(tuple, in_range(points, ranges, "p", "lo", "hi", width).select("p", "n").collect())) == expected


def test_state_of_an_old_form_is_brought_up_to_date(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Ledger, "MIGRATIONS", {1: lambda s: {**s, "environments": {f"new_{k}": v for k, v in s["environments"].items()}}})
    ledger = Ledger(Files(spark, f"file://{tmp_path}"))
    ledger.load({"environments": {"prod": {}}})
    assert list(ledger.get("environments", {})) == ["new_prod"] and ledger.dump()["form"] == 2
    ledger.load(ledger.dump())
    assert list(ledger.get("environments", {})) == ["new_prod"]

