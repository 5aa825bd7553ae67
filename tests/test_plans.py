"""Times, schedules, intervals, graphs, selection, schema changes, and a project from plan to run."""

from datetime import UTC, date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from sparkmodel.operators.audits import Audit
from sparkmodel.plans import evolution as E
from sparkmodel.plans import intervals as iv
from sparkmodel.plans import times as t
from sparkmodel.plans.contexts import Context
from sparkmodel.plans.graphs import CycleError, Graph, Selector, run_graph
from sparkmodel.plans.models import Category, Kind, Model, with_changes
from sparkmodel.plans.storage import TableStore

NOW = datetime(2024, 5, 15, 12, 30, tzinfo=UTC)


def at(*parts):
    return datetime(*parts, tzinfo=UTC)


@pytest.mark.parametrize("value, expected", [
    (20240101, at(2024, 1, 1)), (1704067200000, at(2024, 1, 1)), ("2024-01-01", at(2024, 1, 1)), ("2024-01-01 10:00:00", at(2024, 1, 1, 10)), (date(2024, 1, 1), at(2024, 1, 1)),
    ("yesterday", at(2024, 5, 14)), ("1 week ago", at(2024, 5, 8)), ("2 hours ago", at(2024, 5, 15, 10, 30)), ("1 month ago", at(2024, 4, 15)),
])
def test_to_datetime(value, expected):
    assert t.to_datetime(value, NOW) == expected


def test_ends():
    assert t.exclusive_end("2024-01-01") == at(2024, 1, 2) and t.exclusive_end("2024-01-01 05:00:00") == at(2024, 1, 1, 5)
    assert t.inclusive_end("2024-01-01") == at(2024, 1, 1, 23, 59, 59, 999999)
    v = t.variables("2024-01-01", "2024-01-02", NOW)
    assert v["start_ds"] == "2024-01-01" and v["end_ds"] == "2024-01-02" and v["execution_hour"] == 12
    assert "start_ds" not in t.variables(None, None, NOW)


@pytest.mark.parametrize("cron, after, before, unit", [
    ("@daily", at(2024, 5, 16), at(2024, 5, 15), t.IntervalUnit.DAY), ("*/5 * * * *", at(2024, 5, 15, 12, 35), at(2024, 5, 15, 12, 25), t.IntervalUnit.FIVE_MINUTE), ("0 0 * * mon", at(2024, 5, 20), at(2024, 5, 13), t.IntervalUnit.DAY),
    ("30 6 1 * *", at(2024, 6, 1, 6, 30), at(2024, 5, 1, 6, 30), t.IntervalUnit.MONTH), ("0 9-17/4 * * 1-5", at(2024, 5, 15, 13), at(2024, 5, 15, 9), t.IntervalUnit.HOUR),
])
def test_cron(cron, after, before, unit):
    c = t.Cron(cron)
    assert c.next(NOW) == after and c.previous(NOW) == before and c.unit() is unit
    assert c.floor(after) == after


spans = st.lists(st.tuples(st.integers(0, 50), st.integers(1, 10)).map(lambda x: (x[0], x[0] + x[1])), max_size=12)


@settings(max_examples=60, deadline=None)
@given(spans, st.tuples(st.integers(0, 50), st.integers(1, 20)))
def test_interval_algebra(intervals, gone):
    gone = (gone[0], gone[0] + gone[1])
    once = iv.merged(intervals)
    cover = lambda xs: {p for a, b in xs for p in range(a, b)}
    assert iv.merged(once) == once and cover(once) == cover(intervals)
    assert cover(iv.removed(once, gone)) == cover(once) - cover([gone])
    assert cover(iv.merged([*iv.removed(once, gone), gone])) == cover(once) | cover([gone])


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 19)))
def test_missing_and_loaded_make_the_grid(loaded):
    day, start = 86_400_000, t.millis("2024-01-01")
    have = [(start + d * day, start + (d + 1) * day) for d in loaded]
    gone = iv.missing(have, start, start + 20 * day, t.IntervalUnit.DAY)
    assert iv.merged([*gone, *have]) == [(start, start + 20 * day)] and not set(gone) & set(have)


def test_lookback_batches_and_difference():
    day, start = 86_400_000, t.millis("2024-01-01")
    grid = [(start + d * day, start + (d + 1) * day) for d in range(6)]
    assert iv.missing(grid[:5], start, start + 6 * day, t.IntervalUnit.DAY, lookback=2) == grid[3:]
    assert iv.batches(grid[:3] + grid[4:], 2) == [(grid[0][0], grid[1][1]), grid[2], (grid[4][0], grid[5][1])]
    assert iv.difference(grid, grid[2:4]) == grid[:2] + grid[4:] and iv.difference(grid, grid[2:4], uninterrupted=True) == grid[:2]
    assert iv.ready(grid[:3], lambda run: run[:1]) == grid[:1] and iv.ready(grid[:3], lambda run: False) == []
    assert iv.bounds("2024-01-01", "2024-01-03", t.IntervalUnit.DAY) == (start, start + 3 * day)
    assert iv.bounds("2024-01-01 01:00:00", "2024-01-03 05:00:00", t.IntervalUnit.DAY, outward=False) == (start + day, start + 2 * day)


def test_graph():
    g = Graph({"c": {"b"}, "b": {"a"}, "d": {"a"}})
    assert g.order() == ["a", "b", "d", "c"] and g.upstream("c") == {"a", "b"} and g.downstream("a") == {"b", "c", "d"}
    assert g.roots == {"a"} and g.leaves == {"c", "d"} and g.reversed().roots == {"c", "d"} and set(g.lineage("b").parents) == {"a", "b", "c"}
    with pytest.raises(CycleError, match="x -> y -> x"):
        Graph({"x": {"y"}, "y": {"x"}}).order()


def test_failures_skip_descendants():
    def act(n):
        if n == "b":
            raise ValueError("no")

    failed, skipped = run_graph(Graph({"b": {"a"}, "c": {"b"}, "d": {"a"}}), act, 2)
    assert set(failed) == {"b"} and skipped == {"c"}


@pytest.mark.parametrize("text, expected", [
    ("b", {"b"}), ("+b", {"a", "b"}), ("b+", {"b", "c"}), ("+b+", {"a", "b", "c"}), ("tag:x", {"a", "d"}), ("tag:x & ^a", {"d"}), ("(a | d) & ^tag:y", {"a"}), ("*", {"a", "b", "c", "d"}), ("resource_type:seed+", {"a", "b", "c", "d"}),
])
def test_selector(text, expected):
    s = Selector(Graph({"c": {"b"}, "b": {"a"}, "d": {"a"}}), {"a": ["x"], "d": ["x", "y"]}, {"a": "seed"})
    assert s.select(text) == expected
    for bad in ("(a", "a b", "& a", "a )"):
        with pytest.raises(ValueError):
            s.select(bad)


def test_schema_changes(spark):
    before = T.StructType.fromDDL("id int, gone string, kind string, price decimal(10,2), nested struct<a: int, b: string>, many array<struct<x: int>>")
    after = T.StructType.fromDDL("id bigint, kind int, price decimal(12,2), nested struct<a: int, c: date>, many array<struct<x: int, y: int>>, fresh date")
    steps = E.changes(before, after)
    assert [(s.kind, s.path) for s in steps] == [("drop", ("gone",)), ("drop", ("kind",)), ("drop", ("nested", "b")), ("add", ("fresh",)), ("add", ("kind",)), ("add", ("nested", "c")), ("add", ("many", "element", "y")), ("alter", ("id",)), ("alter", ("price",))]
    with pytest.raises(E.EvolutionError):
        E.enforce(steps)
    assert E.enforce(steps, E.Policy.IGNORE) == [s for s in steps if not s.destructive]
    df = spark.createDataFrame([(1, "g", "k", None, (1, "b"), [(5,)])], before)
    assert E.evolved(df, after).first().asDict(True) == {"id": 1, "kind": None, "price": None, "nested": {"a": 1, "c": None}, "many": [{"x": 5, "y": None}], "fresh": None}
    assert {f.name for f in E.applied(before, steps).fields} == {"id", "kind", "price", "nested", "many", "fresh"}


def test_store(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}")
    store.write("t", spark.range(3))
    store.write("t", store.read("t").where("id > 0"))
    with pytest.raises(ZeroDivisionError):
        store.write("t", spark.range(9), check=lambda _: 1 / 0)
    assert store.read("t").count() == 2
    store.clone("t", "u")
    assert store.delete_where("u", "id = 1").count() == 1 and store.truncate("u").count() == 0
    assert store.evolve("t", T.StructType.fromDDL("id bigint, note string")) and store.read("t").columns == ["id", "note"]
    assert len(store.vacuum("t", keep_previous=False)) == 1 and store.drop("u") and not store.exists("u")


def project(spark, root):
    events = spark.createDataFrame([(d, v) for d in range(1, 6) for v in (1, 2)], "d int, v int").selectExpr("make_date(2024, 5, d) AS day", "v")
    events.createOrReplaceTempView("raw_events")
    daily = Model("daily", "SELECT day, sum(v) AS total FROM raw_events WHERE day BETWEEN :start_date AND :end_date GROUP BY day", kind=Kind.TIME_RANGE, time_column="day", start="2024-05-01", batch_size=2, depends_on=[], audits=[Audit("not_null", {"columns": ["day"]})], grain=["day"], tags=["x"])
    total = Model("total", "SELECT sum(total) AS total FROM {daily}", start="2024-05-01", grain=["total"])
    return Context(spark, f"file://{root}", [daily, total])


def test_project_plan_apply_run(spark, tmp_path):
    ctx = project(spark, tmp_path)
    plan = ctx.plan(now="2024-05-04 01:00:00")
    assert {c.name: c.category for c in plan.changes} == {"daily": Category.BREAKING, "total": Category.BREAKING} and len(plan.missing["daily"]) == 3
    outcomes = ctx.apply(plan)
    assert all(o.passed for o in outcomes["daily"]) and ctx.table("daily").count() == 3 and ctx.table("total").first()[0] == 9
    assert ctx.plan(now="2024-05-04 02:00:00").empty and ctx.run(now="2024-05-04 03:00:00") == {}
    ctx.run(now="2024-05-06 00:00:00")
    assert ctx.table("daily").count() == 5 and ctx.table("total").first()[0] == 15
    assert ctx.evaluate("daily", "2024-05-02", "2024-05-02").collect()[0]["total"] == 3


def test_change_goes_to_a_new_table_and_diff(spark, tmp_path):
    ctx = project(spark, tmp_path)
    ctx.apply(ctx.plan(now="2024-05-04"))
    ctx.add(with_changes(ctx.models["daily"], query="SELECT day, sum(v) + 1 AS total FROM raw_events WHERE day BETWEEN :start_date AND :end_date GROUP BY day"))
    plan = ctx.plan("dev", now="2024-05-04")
    ctx.apply(plan)
    assert ctx.table("total", "dev").first()[0] == 12 and ctx.table("total").first()[0] == 9
    summary = ctx.table_diff("prod", "dev", ["daily"])["daily"].summary().first()
    assert summary["join_count"] == 3 and summary["full_match_count"] == 0
    changes = {c.name: c.category for c in ctx.plan("prod", now="2024-05-04").changes}
    assert changes == {"daily": Category.BREAKING, "total": Category.INDIRECT_BREAKING}
    assert ctx.environments() == ["dev", "prod"]
    ctx.invalidate_environment("dev")
    assert len(ctx.janitor()) == 2 and ctx.environments() == ["prod"]


def test_restatement_loads_again(spark, tmp_path):
    ctx = project(spark, tmp_path)
    ctx.apply(ctx.plan(now="2024-05-04"))
    spark.sql("SELECT day, v * 10 AS v FROM raw_events").createOrReplaceTempView("raw_events_new")
    spark.table("raw_events_new").createOrReplaceTempView("raw_events2")
    plan = ctx.plan(restate=["daily"], start="2024-05-02", end="2024-05-02", now="2024-05-04")
    assert len(plan.missing["daily"]) == 1 and "restate" in " ".join(plan.explain())
    ctx.apply(plan)
    assert ctx.table("daily").count() == 3


def test_failing_audit_keeps_the_table(spark, tmp_path):
    ctx = project(spark, tmp_path)
    ctx.apply(ctx.plan(now="2024-05-04"))
    ctx.add(with_changes(ctx.models["daily"], audits=[Audit("accepted_range", {"column": "total", "max_v": 0})]))
    with pytest.raises(RuntimeError, match="accepted_range"):
        ctx.run(now="2024-05-06")
    assert ctx.table("daily").count() == 3
    assert ctx.audit()["daily"][0].count == 3


def test_model_test_and_lint(spark, tmp_path):
    ctx = project(spark, tmp_path)
    case = {"model": "total", "inputs": {"daily": ([(1,), (2,)], "total int")}, "expected": ([(3,)], "total bigint")}
    assert ctx.test(case).count() == 0
    assert ctx.test({**case, "expected": ([(4,)], "total bigint")}).count() == 2
    assert "no_missing_owner" in ctx.lint()["daily"] and "no_missing_audits" in ctx.lint()["total"]


def test_stream_counts_and_merge(spark, tmp_path):
    from pyspark.sql import functions as F

    from sparkmodel.streaming.loads import merge_stream, windowed

    rows = spark.createDataFrame([(1, datetime(2024, 1, 1, 5)), (1, datetime(2024, 1, 1, 6)), (2, datetime(2024, 1, 2, 5))], "id int, ts timestamp")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    counts = windowed(stream, "ts", "1 day", "1 hour", [], [F.count("*").alias("n")])
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["window_start"].day, r["n"]) for r in spark.table("counts").collect()} == {(1, 2), (2, 1)}
    store = TableStore(spark, f"file://{tmp_path}/tables")
    merge_stream(stream, store, "latest", ["id"], f"{tmp_path}/ck", ["ts"]).awaitTermination()
    assert {(r["id"], r["ts"].hour) for r in store.read("latest").collect()} == {(1, 6), (2, 5)}


def test_lineage(spark, tmp_path):
    from sparkmodel.plans.lineage import column_lineage, inherited_descriptions

    a, b = spark.createDataFrame([(1, 2)], "k int, x int"), spark.createDataFrame([(1, 3)], "k2 int, y int")
    out = a.join(b, a.k == b.k2).groupBy("k").sum("x", "y").selectExpr("k AS key", "`sum(x)` + `sum(y)` AS both", "1 AS one")
    found = column_lineage(out, {"a": a, "b": b})
    assert found == {"key": {"a": {"k"}}, "both": {"a": {"x"}, "b": {"y"}}, "one": {}}
    assert inherited_descriptions(found, {"a": {"k": "the key", "x": "an x"}}) == {"key": "the key"}
    ctx = project(spark, tmp_path)
    ctx.apply(ctx.plan(now="2024-05-04"))
    assert ctx.lineage("total") == {"total": {"daily": {"total"}}}


def test_scheduled_restatement_state_and_gaps(spark, tmp_path):
    ctx = project(spark, tmp_path / "one")
    ctx.apply(ctx.plan(now="2024-05-04"))
    ctx.add(with_changes(ctx.models["daily"], restate_cron="@weekly", restate_intervals=2))
    table = ctx.ledger.environment("prod")["tables"]["daily"]
    assert ctx.restate_on_schedule({"daily": table}, NOW) == ["daily"] and len(ctx.missing_of("daily", table, at(2024, 5, 4))) == 2
    assert ctx.restate_on_schedule({"daily": table}, NOW) == []
    other = project(spark, tmp_path / "two")
    other.ledger.load(ctx.ledger.dump())
    assert other.environments() == ["prod"]
    assert iv.gaps([(0, 10)], [(2, 4), (8, 20)]) == [(0, 2), (4, 8)]
    ctx.add(with_changes(ctx.models["total"], query="SELECT sum(total) + 0 AS total FROM {daily}"))
    assert ctx.gaps(ctx.plan(now="2024-05-04")) == {}


def test_generated_test_passes(spark, tmp_path):
    ctx = project(spark, tmp_path)
    ctx.apply(ctx.plan(now="2024-05-04"))
    assert ctx.test(ctx.create_test("total")).count() == 0


def test_signals(spark, tmp_path):
    from sparkmodel.plans.signals import fresh, until

    (tmp_path / "f").write_text("x")
    assert fresh(spark, [f"file://{tmp_path}"], lambda: 0)([(0, 1)]) and not fresh(spark, [f"file://{tmp_path}"], lambda: 1 << 60)([(0, 1)])
    assert iv.ready([(0, 1), (1, 2)], until(lambda: 1)) == [(0, 1)]


def test_command_line(spark, tmp_path, capsys):
    from sparkmodel.__main__ import main

    file = tmp_path / "project.py"
    file.write_text("from sparkmodel.plans.models import Model\nmodels = [Model('m', 'SELECT 1 AS one', start='2024-05-01')]\n")
    for command in (["plan", "--now", "2024-05-03"], ["apply", "--now", "2024-05-03"], ["dag"], ["lint"], ["environments"], ["fetch", "SELECT one FROM m"], ["info"]):
        assert main([str(file), *command]) == 0
    assert "load m" in (said := capsys.readouterr().out) and "prod" in said and "1 models" in said
    (tmp_path / "cases.yaml").write_text("one: {model: m, output: [{one: 1}]}\nbad: {model: m, output: [{one: 2}]}\n")
    assert main([str(file), "test", str(tmp_path / "cases.yaml")]) == 1 and "2 cases, 1 differ" in capsys.readouterr().out
    assert main([str(file), "create-test", "m"]) == 0
    (tmp_path / "made.yaml").write_text(capsys.readouterr().out)
    state = str(tmp_path / "state.json")
    for command in (["test", str(tmp_path / "made.yaml")], ["state-export", state], ["diff"], ["table-name", "m"], ["state-import", state], ["migrate"], ["rollback"], ["clean"], ["destroy"]):
        assert main([str(file), *command]) == 0
    assert "1 cases, 0 differ" in (said := capsys.readouterr().out) and "m__" in said
    assert main([str(file), "environments"]) == 0 and capsys.readouterr().out.strip() == ""
    new = tmp_path / "new.py"
    for command in (["init"], ["apply", "--now", "2024-05-03"], ["fetch", "SELECT * FROM daily"]):
        assert main([str(new), "--root", f"file://{tmp_path}/other", *command]) == 0
    assert "2024-05-02" in capsys.readouterr().out


def test_a_load_touches_only_its_own_parts(spark, tmp_path):
    ctx = project(spark, tmp_path)
    ctx.apply(ctx.plan(now="2024-05-04"))
    name = ctx.ledger.environment("prod")["tables"]["daily"]
    before = ctx.store.parts(name)
    assert sorted(before) == ["2024-05-01", "2024-05-02", "2024-05-03"]
    ctx.run(now="2024-05-05")
    after = ctx.store.parts(name)
    assert {k: after[k] for k in before} == before and set(after) - set(before) == {"2024-05-04"}
    spark.sql("SELECT * FROM raw_events WHERE day <> date'2024-05-02'").write.saveAsTable("fewer_events")
    ctx.add(with_changes(ctx.models["daily"], query=ctx.models["daily"].query.replace("raw_events", "fewer_events")))
    ctx.load_span(ctx.models["daily"], {"daily": name}, (t.millis("2024-05-02"), t.millis("2024-05-03")), NOW)
    assert "2024-05-02" not in ctx.store.parts(name) and ctx.store.read(name).count() == 3
    spark.sql("DROP TABLE fewer_events")


def test_partitions_appends_and_new_columns(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b/=", 2), (None, 3)], "k string, v int").createOrReplaceTempView("keyed")
    by_key = Model("by_key", "SELECT k, v FROM keyed", kind=Kind.PARTITION, partition_by=["k"], start="2024-05-01", depends_on=[])
    added = Model("added", "SELECT v FROM keyed", kind=Kind.UNMANAGED, start="2024-05-01", batch_size=1, depends_on=[])
    ctx = Context(spark, f"file://{tmp_path}", [by_key, added])
    ctx.apply(ctx.plan(now="2024-05-02"))
    spark.createDataFrame([("b/=", 9, "n")], "k string, v int, note string").createOrReplaceTempView("keyed")
    ctx.add(with_changes(by_key, query="SELECT k, v, note FROM keyed"))
    tables = ctx.ledger.environment("prod")["tables"]
    ctx.load_span(ctx.models["by_key"], tables, (t.millis("2024-05-02"), t.millis("2024-05-03")), NOW)
    assert {tuple(r) for r in ctx.store.read(tables["by_key"]).collect()} == {("a", 1, None), ("b/=", 9, "n"), (None, 3, None)}
    ctx.run(now="2024-05-04")
    assert ctx.table("added").count() == 3 + 2


def test_text_time_columns_have_a_part_for_each_value(spark, tmp_path):
    spark.createDataFrame([("20240501", 1), ("20240502", 2)], "ds string, v int").createOrReplaceTempView("texts")
    m = Model("texts", "SELECT * FROM texts WHERE ds BETWEEN :start_ds AND :end_ds OR true", kind=Kind.TIME_RANGE, time_column="ds", time_format="%Y%m%d", start="2024-05-01", depends_on=[])
    ctx = Context(spark, f"file://{tmp_path}", [m])
    ctx.apply(ctx.plan(now="2024-05-02"))
    assert ctx.table("texts").count() == 1
    ctx.run(now="2024-05-03")
    assert sorted(r["ds"] for r in ctx.table("texts").collect()) == ["20240501", "20240502"]


def test_cases_from_yaml(spark, tmp_path):
    from sparkmodel.plans.cases import load_cases

    ctx = project(spark, tmp_path)
    text = """
adds_up:
  model: total
  inputs: {daily: {rows: [{total: 1}, {total: 2}], columns: {total: int}}}
  output: [{total: 3}]
fails:
  model: total
  inputs: {daily: [{total: 1}]}
  output: {rows: [{total: 7}]}
"""
    cases = load_cases(text, ctx.models)
    assert ctx.test(cases["adds_up"]).count() == 0 and ctx.test(cases["fails"]).count() == 2
    with pytest.raises(ValueError, match="output"):
        load_cases("x: {model: total}", ctx.models)


def test_blueprints_statements_and_rules(spark, tmp_path):
    from sparkmodel.plans.models import blueprints

    pattern = Model("m_@{Name}", "SELECT @{value} AS v", start="2024-05-01", before=["CREATE OR REPLACE TEMP VIEW seen AS SELECT 1 AS one"], tags=["@{name}"])
    made = blueprints(pattern, [{"name": "a"}, {"name": "b", "value": 2}], {"VALUE": 1})
    assert [(m.name, m.query, list(m.tags)) for m in made] == [("m_a", "SELECT 1 AS v", ["a"]), ("m_b", "SELECT 2 AS v", ["b"])]
    with pytest.raises(KeyError):
        blueprints(pattern, [{}])
    ctx = Context(spark, f"file://{tmp_path}", made, after_all=["CREATE OR REPLACE TEMP VIEW finished AS SELECT 2 AS two"])
    ctx.apply(ctx.plan(now="2024-05-02"))
    assert ctx.table("m_b").first()[0] == 2 and spark.table("seen").first()[0] == 1 and spark.table("finished").first()[0] == 2
    assert "short_name" in ctx.lint({"short_name": lambda m: len(m.name) < 9})["m_a"]
