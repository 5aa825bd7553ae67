"""Queries over what surrounds the operators: joins and aggregates of model bodies, projects from plan to load, intervals,
schedules, schema changes, lineage, selection. Twins are SQL over the same tables, or values written down by hand."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmodel.functions import columns as C
from sparkmodel.functions import frames as R
from sparkmodel.operators import joins as J
from sparkmodel.operators import writers as W
from sparkmodel.operators.audits import Audit, failures
from sparkmodel.operators.metrics import SemanticModel, metric_from_sql
from sparkmodel.plans import evolution as E
from sparkmodel.plans import intervals as iv
from sparkmodel.plans import times as t
from sparkmodel.plans.buckets import history_load, merge_load
from sparkmodel.plans.cases import frozen_times, load_cases
from sparkmodel.plans.contexts import Context, RunContext, migrated
from sparkmodel.plans.graphs import Graph, Selector, run_graph
from sparkmodel.plans.lineage import column_lineage, inherited_descriptions
from sparkmodel.plans.models import Kind, Model, blueprints, macro, resolve_template, with_changes
from sparkmodel.plans.naming import Convention, Target, physical_name, view_name
from sparkmodel.plans.signals import fresh, until
from sparkmodel.plans.storage import TableStore
from sparkmodel.queries import BY_COLUMN, BY_TIME, C1, NOW1, NOW2, NOW3, ORDER_ROWS, QUERIES, SECOND, SQL, T2, THIRD, column_step, order_rows, query, semantic, snapshots, statuses, time_step
from sparkmodel.session import scratch_folder
from sparkmodel.sources import tables as S
from sparkmodel.streaming.loads import merge_stream, windowed

NOW = datetime(2024, 5, 15, 12, 30, tzinfo=UTC)
DAY = 86_400_000


def values(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return S.typed_values(spark, rows, schema)


def days(*pairs: tuple[int, int]) -> list[iv.Interval]:
    """Intervals from day to day of January 2024 (1-based, end excluded)."""
    start = t.millis("2024-01-01")
    return [(start + (a - 1) * DAY, start + (b - 1) * DAY) for a, b in pairs]


def day_rows(spark: SparkSession, found: dict[str, list[iv.Interval]]) -> DataFrame:
    """(case, start, end) of intervals."""
    stamp = lambda ms: t.from_millis(ms).replace(tzinfo=None)
    return values(spark, "case string, start timestamp_ntz, end timestamp_ntz", [(c, stamp(a), stamp(b)) for c, i in found.items() for a, b in i])


def january(*rows: tuple[str, int, int]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{c}', TIMESTAMP '2024-01-01' + to_days({a - 1}), TIMESTAMP '2024-01-01' + to_days({b - 1}))" for c, a, b in rows) + ') v("case", "start", "end")'


def store_of(spark: SparkSession) -> TableStore:
    return TableStore(spark, scratch_folder(spark, "tables"))


# joins and aggregates of model bodies


@query("""SELECT a.n_nationkey AS one, b.n_nationkey AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def theta_join(spark: SparkSession, nation: DataFrame) -> DataFrame:
    """Pairs of nations of a region, each once: an equi-join with an inequality beside it."""
    a = nation.select(F.col("n_nationkey").alias("one"), F.col("n_regionkey").alias("r1"))
    b = nation.select(F.col("n_nationkey").alias("other"), F.col("n_regionkey").alias("r2"))
    return a.join(b, (F.col("r1") == F.col("r2")) & (F.col("one") < F.col("other"))).select("one", "other")


@query("""SELECT n.n_nationkey, c.c_custkey, c.c_acctbal FROM nation n, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n.n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) c""")
def lateral_join(spark: SparkSession, nation: DataFrame, customer: DataFrame) -> DataFrame:
    """The two richest customers of each nation: a lateral subquery goes to the engine as it is."""
    return spark.sql("SELECT n.n_nationkey, c.c_custkey, c.c_acctbal FROM {nation} n, LATERAL (SELECT c_custkey, c_acctbal FROM {customer} WHERE c_nationkey = n.n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) c", nation=nation, customer=customer)


@query("""SELECT e.event_id, e.user_id, e.event_type AS kind, p.last_value FROM (SELECT * FROM events WHERE event_id % 3 <> 0) e
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS last_value FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def as_of_join(spark: SparkSession, events: DataFrame) -> DataFrame:
    """For each event the last earlier one of another sort by the same user."""
    left = events.where("event_id % 3 <> 0").select("event_id", "user_id", "ts", F.col("event_type").alias("kind"))
    right = events.where("event_id % 3 = 0").select("user_id", "ts", F.col("event_id").alias("last_value"))
    return J.as_of(left, right, ["user_id"], "ts", ["last_value"]).drop("ts")


@query("""SELECT p_partkey, r.lo FROM part JOIN (SELECT s_suppkey * 40 AS lo, s_suppkey * 40 + 25 + s_nationkey AS hi FROM supplier) r ON p_partkey >= r.lo AND p_partkey < r.hi""")
def range_join(spark: SparkSession, part: DataFrame, supplier: DataFrame) -> DataFrame:
    """Parts whose key lies in a supplier's range."""
    ranges = supplier.select((F.col("s_suppkey") * 40).alias("lo"), (F.col("s_suppkey") * 40 + 25 + F.col("s_nationkey")).alias("hi"))
    return J.in_range(part.select("p_partkey"), ranges, "p_partkey", "lo", "hi", 32).select("p_partkey", "lo")


@query("""SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS in_left, b.k IS NOT NULL AS in_right FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a
FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k AND a.n > b.n * 10""")
def condition_diff_join(spark: SparkSession, customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """A full join on an equality and a further condition."""
    a = customer.groupBy(F.col("c_nationkey").alias("ka")).agg(F.count(F.lit(1)).alias("na"))
    b = supplier.groupBy(F.col("s_nationkey").alias("kb")).agg(F.count(F.lit(1)).alias("nb"))
    both = a.join(b, (F.col("ka") == F.col("kb")) & (F.col("na") > F.col("nb") * 10), "full_outer")
    return both.select(F.coalesce("ka", "kb").alias("k"), F.col("ka").isNotNull().alias("in_left"), F.col("kb").isNotNull().alias("in_right"))


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(DISTINCT o_custkey) FILTER (WHERE o_totalprice > 100000) AS n_large FROM orders GROUP BY 1""")
def filtered_aggregates(spark: SparkSession, orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_f"), F.countDistinct(F.when(F.col("o_totalprice") > 100000, F.col("o_custkey"))).alias("n_large"))


@query("""SELECT n_regionkey, string_agg(DISTINCT substr(n_name, 1, 1), ',' ORDER BY substr(n_name, 1, 1) DESC) AS letters FROM nation GROUP BY 1""")
def ordered_array_aggregate(spark: SparkSession, nation: DataFrame) -> DataFrame:
    """The distinct first letters of a region's nations, last first."""
    letters = F.sort_array(F.collect_set(F.substring("n_name", 1, 1)), asc=False)
    return nation.groupBy("n_regionkey").agg(F.array_join(letters, ",").alias("letters"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def cube_counts(spark: SparkSession, orders: DataFrame) -> DataFrame:
    return orders.cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def rollup_counts(spark: SparkSession, orders: DataFrame) -> DataFrame:
    return orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")
def grouping_sets_counts(spark: SparkSession, orders: DataFrame) -> DataFrame:
    return orders.groupingSets([[F.col("o_orderstatus")], [F.col("o_orderpriority")], []], "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, first_value(k IGNORE NULLS) OVER w AS first_known, first_value(k) OVER w AS first_of_all FROM (SELECT o_orderkey, o_custkey, nullif(o_orderkey % 3, 0) AS k FROM orders)
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def first_value_nulls(spark: SparkSession, orders: DataFrame) -> DataFrame:
    rows = orders.select("o_orderkey", "o_custkey", F.nullif(F.col("o_orderkey") % 3, F.lit(0)).alias("k"))
    whole = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select("o_orderkey", F.first("k", ignorenulls=True).over(whole).alias("first_known"), F.first("k").over(whole).alias("first_of_all"))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def intersect_distinct(spark: SparkSession, customer: DataFrame, supplier: DataFrame) -> DataFrame:
    return customer.where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")).intersect(supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(spark: SparkSession, customer: DataFrame, supplier: DataFrame) -> DataFrame:
    return customer.where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")).intersectAll(supplier.select(F.col("s_nationkey").alias("k")))


@query("""SELECT o_orderkey, substr(strftime(o_orderdate + to_microseconds(123456 + o_orderkey % 1000), '%Y-%m-%d %H:%M:%S.%f'), 1, 23) AS millis,
  strftime(o_orderdate + to_microseconds(123456), '%Y-%m-%d %H:%M:%S') AS seconds FROM orders""")
def timestamp_precision(spark: SparkSession, orders: DataFrame) -> DataFrame:
    """Timestamps as texts of three digits and of none: cut off, not rounded."""
    at = lambda more: F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + more)
    return orders.select("o_orderkey", C.chopped(at(123456 + F.col("o_orderkey") % 1000), 3).alias("millis"), C.chopped(at(F.lit(123456)), 0).alias("seconds"))


@query("""SELECT n_regionkey, CAST(to_json(list(n_nationkey ORDER BY n_nationkey)) AS VARCHAR) AS keys, CAST(to_json({'n': count(*), 'first': min(n_name)}) AS VARCHAR) AS facts, list_contains(list(n_nationkey), 3) AS has_three FROM nation GROUP BY 1""")
def json_and_arrays(spark: SparkSession, nation: DataFrame) -> DataFrame:
    keys = F.sort_array(F.collect_list("n_nationkey"))
    facts = F.struct(F.count(F.lit(1)).alias("n"), F.min("n_name").alias("first"))
    return nation.groupBy("n_regionkey").agg(F.to_json(keys).alias("keys"), F.to_json(facts).alias("facts"), F.array_contains(F.collect_list("n_nationkey"), 3).alias("has_three"))


@query("""SELECT * FROM (VALUES ('{"a":1,"b":["x",null]}', '{"k":1.5}', '[{"p":1},{"p":2}]')) v(struct, map, list)""")
def nested_literals(spark: SparkSession) -> DataFrame:
    """Literals of structs, maps and lists of structs, as JSON."""
    rows = values(spark, "struct struct<a: int, b: array<string>>, map map<string, double>, list array<struct<p: int>>", [((1, ["x", None]), {"k": 1.5}, [(1,), (2,)])])
    return rows.select(*[F.to_json(c, {"ignoreNullFields": "false"}).alias(c) for c in rows.columns])


@query("SELECT CAST(NULL AS INTEGER) AS id, CAST(NULL AS VARCHAR) AS name WHERE false")
def values_scan_empty(spark: SparkSession) -> DataFrame:
    return values(spark, "id int, name string", [])


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE n_name END AS name, n_nationkey / 2 AS half, n_nationkey > 10 AS large FROM nation")
def pandas_scan(spark: SparkSession, nation: DataFrame) -> DataFrame:
    """A pandas frame of a dimension table, read with the types of its columns."""
    rows = nation.select("n_nationkey", "n_name").toPandas()
    made = pd.DataFrame({"k": rows["n_nationkey"], "name": rows["n_name"].where(rows["n_nationkey"] % 2 == 1, None), "half": rows["n_nationkey"] / 2, "large": rows["n_nationkey"] > 10})
    schema = S.pandas_schema(made)
    schema["k"].dataType = nation.schema["n_nationkey"].dataType
    return S.typed_values(spark, made, schema)


@query("""SELECT * FROM (VALUES (1, DATE '2024-05-01', true, 1.5::DOUBLE, 'x'), (2, DATE '2024-05-02', false, NULL, 'N/A'), (3, NULL, NULL, -2, 'a,"b"'), (4, DATE '2020-02-29', true, 0, NULL)) v(id, day, flag, number, note)""")
def seed_coercion(spark: SparkSession) -> DataFrame:
    """A seed's texts as dates (with a time or without), truth values in many spellings, numbers and nulls."""
    folder = scratch_folder(spark, "seed")
    lines = ['1,2024-05-01 10:00:00,Yes,1.5,x', '2,2024-05-02,off,nan,N/A', '3,NULL,,-2,"a,""b"""', '4,2020-02-29,T,0,none']
    spark.createDataFrame([("id,day,flag,number,note\n" + "\n".join(lines),)], "value string").coalesce(1).write.text(folder)
    return S.seed(spark, folder, "id int, day date, flag boolean, number double, note string", S.SeedFormat(na_values={"note": ["none"], "day": ["NULL"], "number": ["nan"], "flag": [""]}, keep_default_na=False))


@query("""SELECT * FROM (VALUES ('discovered_one', 'k', 'bigint'), ('discovered_one', 'parts', 'array<struct<x:int>>'), ('discovered_two', 'day', 'date'), ('discovered_two', 'price', 'decimal(10,2)')) v("table", "column", type)""")
def external_schema_discovery(spark: SparkSession) -> DataFrame:
    """The columns of tables that no model makes, declared in YAML and read again."""
    spark.sql("SELECT 1L AS k, array(named_struct('x', 1)) AS parts").createOrReplaceTempView("discovered_one")
    spark.sql("SELECT current_date() AS day, CAST(1 AS DECIMAL(10,2)) AS price").createOrReplaceTempView("discovered_two")
    found = S.read_external_yaml(S.external_yaml(S.external_schemas(spark, ["discovered_one", "discovered_two"])))
    return values(spark, "table string, column string, type string", [(t, f.name, f.dataType.simpleString()) for t, kind in found.items() for f in kind.fields])


@query("SELECT 'listed_view' AS name, 'temporary' AS kind")
def catalog_listing(spark: SparkSession, region: DataFrame) -> DataFrame:
    region.createOrReplaceTempView("listed_view")
    return values(spark, "name string, kind string", [(o["name"], o["kind"]) for o in S.catalog_objects(spark, names=["listed_view", "no_such_view"])])


# projects: models, loads, environments


def project(spark: SparkSession, *models: Model, **more: Any) -> Context:
    return Context(spark, scratch_folder(spark, "project"), models, **more)


def applied(spark: SparkSession, name: str, *models: Model, now: str = "2024-05-02", **more: Any) -> DataFrame:
    """The table of a model after a project of these models was planned and applied."""
    ctx = project(spark, *models, **more)
    ctx.apply(ctx.plan(now=now))
    return ctx.table(name)


def registered(sql: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """query() for functions that need the folder of the tables: (spark, sf_dir)."""

    def register(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[make.__name__], SQL[make.__name__] = make, sql
        return make

    return register


@registered("""SELECT n_name, count(*) AS n_customers, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1""")
def model_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that reads an external one by name and an embedded one in its place."""
    customers = Model("customers", kind=Kind.EXTERNAL, path=f"{sf_dir}/customer.parquet")
    nations = Model("geo.nations", kind=Kind.EXTERNAL, path=f"{sf_dir}/nation.parquet")
    rich = Model("rich", "SELECT * FROM {customers} WHERE c_acctbal > 0", kind=Kind.EMBEDDED)
    totals = Model("totals", "SELECT n_name, count(*) AS n_customers, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM {rich} JOIN {geo.nations} ON c_nationkey = n_nationkey GROUP BY 1", start="2024-05-01")
    return applied(spark, "totals", customers, nations, rich, totals)


@registered("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, c_mktsegment LIMIT 3")
def adhoc_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query over what an environment shows, by the models' names."""
    ctx = project(spark, Model("fetched.customers", kind=Kind.EXTERNAL, path=f"{sf_dir}/customer.parquet"), Model("segments", "SELECT c_mktsegment, count(*) AS n FROM {fetched.customers} GROUP BY 1", kind=Kind.VIEW))
    ctx.apply(ctx.plan(now="2024-05-02"))
    return ctx.fetch("SELECT * FROM segments ORDER BY n DESC, c_mktsegment", limit=3)


@registered("SELECT n_nationkey, n_name FROM nation")
def staged_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged files of another format, read as an external model."""
    folder = scratch_folder(spark, "staged")
    spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").write.json(folder)
    staged = Model("staged", kind=Kind.EXTERNAL, path=folder, arguments={"format": "json"})
    kind = spark.read.parquet(f"{sf_dir}/nation.parquet").schema["n_nationkey"].dataType.simpleString()
    return applied(spark, "typed", staged, Model("typed", f"SELECT CAST(n_nationkey AS {kind}) AS n_nationkey, n_name FROM {{staged}}", start="2024-05-01"))


@registered("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1 UNION ALL SELECT r_regionkey, 0 FROM region")
def set_operation_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model whose body is a set operation."""
    parents = [Model(n, kind=Kind.EXTERNAL, path=f"{sf_dir}/{n}.parquet") for n in ("nation", "region")]
    return applied(spark, "both", *parents, Model("both", "SELECT n_regionkey, count(*) AS n FROM {nation} GROUP BY 1 UNION ALL SELECT r_regionkey, 0L FROM {region}", start="2024-05-01"))


@registered("SELECT n_nationkey AS k, upper(n_name) AS name FROM nation")
def python_model_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that is a function giving a pandas frame."""
    nation = Model("nation", kind=Kind.EXTERNAL, path=f"{sf_dir}/nation.parquet")
    kind = spark.read.parquet(nation.path).schema["n_nationkey"].dataType.simpleString()

    def shouted(ctx: RunContext) -> pd.DataFrame:
        rows = ctx.table("nation").select("n_nationkey", "n_name").toPandas()
        return pd.DataFrame({"name": rows["n_name"].str.upper(), "k": rows["n_nationkey"]})

    return applied(spark, "shouted", nation, Model("shouted", shouted, depends_on=["nation"], columns=T.StructType.fromDDL(f"k {kind}, name string"), start="2024-05-01"))


@registered("SELECT s_suppkey AS k, 'supplier' AS sort FROM supplier UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_custkey <= 50 UNION ALL SELECT 0, 'none'")
def python_model_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that is a function yielding batches, frames of Spark and of pandas, some of them empty."""
    parents = [Model(n, kind=Kind.EXTERNAL, path=f"{sf_dir}/{n}.parquet") for n in ("supplier", "customer")]

    def parties(ctx: RunContext) -> Iterator[Any]:
        yield ctx.table("supplier").select(F.col("s_suppkey").cast("bigint").alias("k"), F.lit("supplier").alias("sort"))
        yield pd.DataFrame({"k": [], "sort": []})
        yield ctx.table("customer").where("c_custkey <= 50").select(F.col("c_custkey").cast("bigint").alias("k"), F.lit("customer").alias("sort"))
        yield pd.DataFrame({"k": [0], "sort": ["none"]})

    return applied(spark, "parties", *parents, Model("parties", parties, depends_on=["supplier", "customer"], columns=T.StructType.fromDDL("k bigint, sort string"), start="2024-05-01"))


@registered("SELECT r_regionkey AS k, count(*) AS n FROM region, range(3) GROUP BY 1")
def unmanaged_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three days of an append-only model: each load adds its rows, none is loaded twice."""
    region = Model("region", kind=Kind.EXTERNAL, path=f"{sf_dir}/region.parquet")
    ctx = project(spark, region, Model("added", "SELECT r_regionkey AS k FROM {region}", kind=Kind.UNMANAGED, start="2024-05-01", batch_size=1))
    ctx.apply(ctx.plan(now="2024-05-03"))
    ctx.run(now="2024-05-04")
    ctx.run(now="2024-05-04 05:00:00")
    return ctx.table("added").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT n_nationkey, n_name FROM nation")
def seed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model whose rows are a CSV file."""
    folder = scratch_folder(spark, "seed")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    nation.write.csv(folder, header=True)
    return applied(spark, "seeded", Model("seeded", kind=Kind.SEED, path=folder, columns=nation.schema, start="2024-05-01"))


@registered("SELECT 'plain' AS view, count(*) AS n, false AS stored FROM nation UNION ALL SELECT 'kept', count(*), true FROM nation")
def materialized_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view is computed where it is read, a materialized one has a table."""
    nation = Model("nation", kind=Kind.EXTERNAL, path=f"{sf_dir}/nation.parquet")
    ctx = project(spark, nation, Model("plain", "SELECT * FROM {nation}", kind=Kind.VIEW, start="2024-05-01"), Model("kept", "SELECT * FROM {nation}", kind=Kind.VIEW, materialized=True, start="2024-05-01"))
    plan = ctx.plan(now="2024-05-02")
    ctx.apply(plan)
    return values(spark, "view string, n bigint, stored boolean", [(n, ctx.table(n).count(), n in plan.tables and ctx.store.exists(plan.tables[n])) for n in ("plain", "kept")])


@registered("SELECT event_id, user_id, event_type FROM events")
def managed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that a stream keeps up to date: a load merges what has come since the last one."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema

    def stream(ctx: RunContext) -> DataFrame:
        return ctx.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select("event_id", "user_id", "event_type")

    return applied(spark, "kept", Model("kept", stream, kind=Kind.MANAGED, keys=["event_id"], depends_on=[], start="2024-05-01"))


@W.materialization("largest_first")
def largest_first(target: DataFrame | None, source: DataFrame, by: str = "v") -> DataFrame:
    """Keeps of old and new rows the larger one of each key: a way to write that a project defines."""
    rows = source if target is None else target.unionByName(source)
    return rows.groupBy("k").agg(F.max(by).alias(by))


@registered("SELECT c_nationkey AS k, max(c_custkey) AS v FROM customer GROUP BY 1")
def custom_materialization(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = Model("customer", kind=Kind.EXTERNAL, path=f"{sf_dir}/customer.parquet")
    return applied(spark, "largest", customer, Model("largest", "SELECT c_nationkey AS k, c_custkey AS v FROM {customer}", kind=Kind.CUSTOM, custom="largest_first", start="2024-05-01"))


MERGE_ROWS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


@registered(f"""SELECT coalesce(s.o_orderkey, x.o_orderkey) AS o_orderkey, coalesce(s.o_custkey, x.o_custkey) AS o_custkey, coalesce(s.st, x.o_orderstatus) AS o_orderstatus, coalesce(s.o_totalprice, x.o_totalprice) AS o_totalprice
FROM (SELECT * FROM ({MERGE_ROWS}) WHERE o_orderkey % 3 <> 0) x FULL JOIN (SELECT *, 'X' AS st FROM ({MERGE_ROWS}) WHERE o_custkey % 7 = 0) s ON x.o_orderkey = s.o_orderkey""")
def bucketed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge into a table that is dealt into buckets of keys; a repeated load changes nothing."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    store = store_of(spark)
    merge_load(store, "t", rows.where("o_orderkey % 3 <> 0"), ["o_orderkey"])
    for _ in range(2):
        merge_load(store, "t", rows.where("o_custkey % 7 = 0").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"])
    return store.read("t")


@registered(time_step(T2, THIRD, NOW3))
def bucketed_history_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three loads of a history by time into buckets of keys."""
    store = store_of(spark)
    for rows, now in zip(snapshots(spark.read.parquet(f"{sf_dir}/customer.parquet")), (NOW1, NOW2, NOW3), strict=True):
        history_load(store, "h", rows, BY_TIME, now)
    return store.read("h")


@registered(column_step(C1, f"SELECT id, status FROM ({SECOND})", NOW2))
def bucketed_history_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads of a history by column into buckets of keys."""
    store = store_of(spark)
    for rows, now in zip(statuses(spark.read.parquet(f"{sf_dir}/customer.parquet"))[:2], (NOW1, NOW2), strict=True):
        history_load(store, "h", rows, BY_COLUMN, now)
    return store.read("h")


@registered(f"""WITH o AS ({ORDER_ROWS}) SELECT 'like' AS step, 0 AS n, 0::DOUBLE AS total UNION ALL SELECT 'clone', count(*), sum(o_custkey)::DOUBLE FROM o
UNION ALL SELECT 'deleted', count(*), sum(o_custkey)::DOUBLE FROM o WHERE o_orderstatus <> 'F' UNION ALL SELECT 'updated', count(*), sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE o_custkey END)::DOUBLE FROM o WHERE o_orderstatus <> 'F'
UNION ALL SELECT 'renamed', count(*), sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE o_custkey END)::DOUBLE FROM o WHERE o_orderstatus <> 'F' UNION ALL SELECT 'truncated', 0, 0""")
def table_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create like, clone, delete, update, rename, truncate and drop."""
    store, out = store_of(spark), []

    def note(step: str, df: DataFrame) -> None:
        out.append((step, *df.agg(F.count(F.lit(1)).cast("int"), F.coalesce(F.sum("o_custkey"), F.lit(0)).cast("double")).first()))

    store.write("a", order_rows(spark.read.parquet(f"{sf_dir}/orders.parquet")))
    note("like", store.create("b", store.schema("a")))
    note("clone", store.clone("a", "c"))
    note("deleted", store.delete_where("c", "o_orderstatus = 'F'"))
    note("updated", store.update_where("c", {"o_custkey": "1"}, "o_orderkey % 2 = 0"))
    store.rename("c", "d")
    note("renamed", store.read("d"))
    note("truncated", store.truncate("d"))
    assert store.drop("d") and not store.exists("d") and not store.exists("c")
    return values(spark, "step string, n int, total double", out).withColumn("n", F.col("n").cast("bigint"))


@query("SELECT 'inside' AS place, 25 AS n UNION ALL SELECT 'after', 0")
def temporary_table(spark: SparkSession, nation: DataFrame) -> DataFrame:
    """A table for the length of a block."""
    store = store_of(spark)
    with store.temporary(nation) as rows:
        inside = rows.count()
    return values(spark, "place string, n int", [("inside", inside), ("after", len(store.files.names()))])


@query("SELECT 'bad load' AS step, 'kept' AS outcome, 25 AS n UNION ALL SELECT 'good load', 'published', 5")
def write_audit_publish(spark: SparkSession, nation: DataFrame, region: DataFrame) -> DataFrame:
    """A write that its check refuses leaves the table as it was."""
    store, out = store_of(spark), []

    def check(staged: DataFrame) -> None:
        if staged.where("k < 0").count():
            raise ValueError("negative keys")

    store.write("t", nation.select(F.col("n_nationkey").alias("k")))
    for step, rows in (("bad load", region.select((-F.col("r_regionkey")).alias("k"))), ("good load", region.select(F.col("r_regionkey").alias("k")))):
        try:
            store.write("t", rows, check=check)
            out.append((step, "published", store.read("t").count()))
        except ValueError:
            out.append((step, "kept", store.read("t").count()))
    return values(spark, "step string, outcome string, n int", out)


@query("""SELECT * FROM (VALUES ('format', 'parquet'), ('owner', 'sales'), ('comments', '{"n_name":"the name"}')) v(property, value)""")
def table_properties(spark: SparkSession, nation: DataFrame) -> DataFrame:
    """Properties and column comments of a model's table, which survive a further load."""
    nation.createOrReplaceTempView("commented_nation")
    ctx = project(spark, Model("noted", "SELECT n_nationkey, n_name FROM commented_nation", depends_on=[], start="2024-05-01", properties={"format": "parquet", "owner": "sales"}, comments={"n_name": "the name"}))
    plan = ctx.plan(now="2024-05-02")
    ctx.apply(plan)
    ctx.run(now="2024-05-03")
    found = ctx.store.properties(plan.tables["noted"])
    return values(spark, "property string, value string", [(k, v if isinstance(v, str) else json.dumps(v, separators=(",", ":"))) for k, v in found.items()])


TIMED = "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-01-{last}' GROUP BY 1"


def timed(sf_dir: str, **more: Any) -> list[Model]:
    orders = Model("orders", kind=Kind.EXTERNAL, path=f"{sf_dir}/orders.parquet")
    daily = Model("daily", "SELECT to_date(o_orderdate) AS day, count(*) AS n FROM {orders} WHERE to_date(o_orderdate) BETWEEN :start_date AND :end_date GROUP BY 1", kind=Kind.TIME_RANGE, time_column="day", start="1995-01-01", **more)
    return [orders, daily]


@registered(TIMED.format(last=10))
def time_range_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten days loaded in batches of three, several at once, into a part for each day."""
    return applied(spark, "daily", *timed(sf_dir, batch_size=3, batch_concurrency=3), now="1995-01-11")


@registered("""SELECT * FROM (VALUES ('first', 5), ('again', 0), ('next day', 1), ('lookback', 3), ('restated', 2)) v(step, n)""")
def load_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many days each run finds to load: nothing is loaded twice, late data and restatements are loaded again."""
    ctx = project(spark, *timed(sf_dir))
    plan = ctx.plan(now="1995-01-06")
    out = [("first", len(plan.missing["daily"]))]
    ctx.apply(plan)
    out.append(("again", len(ctx.check_intervals(now="1995-01-06 09:00:00")["daily"])))
    out.append(("next day", len(ctx.check_intervals(now="1995-01-07")["daily"])))
    ctx.add(with_changes(ctx.models["daily"], lookback=2))
    out.append(("lookback", len(ctx.check_intervals(now="1995-01-07")["daily"])))
    ctx.add(with_changes(ctx.models["daily"], lookback=0))
    out.append(("restated", len(ctx.plan(restate=["daily"], start="1995-01-02", end="1995-01-03", now="1995-01-06").missing["daily"])))
    return values(spark, "step string, n int", out)


@registered("""SELECT * FROM (VALUES ('whole days', TIMESTAMP '1995-01-02', 1), ('with partials', TIMESTAMP '1995-01-02 06:00:00', 2)) v(step, "until", n)""")
def partial_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At six in the morning a day that has not ended is left out, or loaded as far as it goes."""
    out = []
    for step, allowed in (("whole days", False), ("with partials", True)):
        ctx = project(spark, *timed(sf_dir, allow_partials=allowed, cron="0 6 * * *", unit=t.IntervalUnit.DAY))
        found = ctx.plan(now="1995-01-02 06:00:00", end="1995-01-02 06:00:00").missing["daily"]
        out.append((step, t.from_millis(found[-1][1]).replace(tzinfo=None), len(found)))
    return values(spark, "step string, until timestamp_ntz, n int", out)


@registered(TIMED.format(last=3).replace("count(*) AS n", "count(*) + 1 AS n"))
def environment_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change shown in a development environment first: production keeps the old rows until it is planned there."""
    ctx = project(spark, *timed(sf_dir))
    ctx.apply(ctx.plan(now="1995-01-04"))
    ctx.add(with_changes(ctx.models["daily"], query=ctx.models["daily"].query.replace("count(*) AS n", "count(*) + 1 AS n")))
    ctx.apply(ctx.plan("dev", now="1995-01-04"))
    assert ctx.table("daily").exceptAll(ctx.table("daily", "dev")).count() == ctx.table("daily").count()
    return ctx.table("daily", "dev")


@registered("""SELECT 'daily' AS model, CAST(count(DISTINCT CAST(o_orderdate AS DATE)) AS INTEGER) AS join_count, 0 AS full_match_count, 'n' AS changed FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-01-20'""")
def environment_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row differences of models between two environments; those without a grain are left out."""
    ctx = project(spark, *timed(sf_dir, grain=["day"]), Model("no_grain", "SELECT 1 AS one", start="1995-01-01"))
    ctx.apply(ctx.plan(now="1995-01-21"))
    ctx.add(with_changes(ctx.models["daily"], query=ctx.models["daily"].query.replace("count(*) AS n", "count(*) + 1 AS n")))
    ctx.apply(ctx.plan("dev", now="1995-01-21"))
    out = []
    for name, diff in ctx.table_diff("prod", "dev", ["daily", "no_grain"]).items():
        row = diff.summary().first()
        out.append((name, row["join_count"], row["full_match_count"], ",".join(r["column_name"] for r in diff.column_stats().where("pct_match < 100").collect())))
    return values(spark, "model string, join_count int, full_match_count int, changed string", out)


CHANGED = "SELECT c_nationkey, count(*) AS n, max(c_acctbal) AS top FROM {customer} GROUP BY 1"
CHANGES = [
    ("unchanged", CHANGED), ("column added", CHANGED.replace(" AS top", " AS top, min(c_custkey) AS least")), ("column added between", CHANGED.replace("count(*) AS n", "count(*) AS n, 1 AS one")),
    ("column removed", CHANGED.replace("count(*) AS n, ", "")), ("column moved", CHANGED.replace("count(*) AS n, max(c_acctbal) AS top", "max(c_acctbal) AS top, count(*) AS n")),
    ("aggregate changed", CHANGED.replace("max(", "min(")), ("filter added", CHANGED.replace(" GROUP", " WHERE c_custkey > 1 GROUP")), ("distinct added", CHANGED.replace("SELECT", "SELECT DISTINCT")),
    ("grouping changed", CHANGED.replace("GROUP BY 1", "GROUP BY c_nationkey, c_mktsegment")), ("explode added", CHANGED.replace(" AS top", " AS top, explode(array(1, 2)) AS e")),
    ("window added", CHANGED.replace(" AS top", " AS top, row_number() OVER (ORDER BY c_nationkey) AS place")),
]


@registered("""SELECT * FROM (VALUES ('unchanged', 'none', 'none'), ('column added', 'non_breaking', 'indirect_non_breaking'), ('column added between', 'non_breaking', 'indirect_non_breaking'),
('column removed', 'breaking', 'indirect_breaking'), ('column moved', 'breaking', 'indirect_breaking'), ('aggregate changed', 'breaking', 'indirect_breaking'), ('filter added', 'breaking', 'indirect_breaking'),
('distinct added', 'breaking', 'indirect_breaking'), ('grouping changed', 'breaking', 'indirect_breaking'), ('explode added', 'breaking', 'indirect_breaking'), ('window added', 'non_breaking', 'indirect_non_breaking'),
('forward only', 'forward_only', 'indirect_non_breaking'), ('owner', 'metadata', 'none')) v(change, own, child)""")
def change_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes of a model's SQL mean for its data and for the model that reads it."""
    customer = Model("customer", kind=Kind.EXTERNAL, path=f"{sf_dir}/customer.parquet")
    base = Model("totals", CHANGED, start="2024-05-01")
    ctx = project(spark, customer, base, Model("child", "SELECT sum(n) AS n FROM {totals}", start="2024-05-01"))
    ctx.apply(ctx.plan(now="2024-05-02"))
    out = []
    for change, new in [*[(c, with_changes(base, query=q)) for c, q in CHANGES], ("forward only", with_changes(base, query=CHANGES[5][1], forward_only=True)), ("owner", with_changes(base, owner="me"))]:
        ctx.add(new)
        found = {c.name: c.category.value for c in ctx.diff()[0]}
        out.append((change, found.get("totals", "none"), found.get("child", "none")))
    return values(spark, "change string, own string, child string", out)


@registered("""SELECT * FROM (VALUES ('totals', 'non_breaking', true, true), ('child', 'indirect_non_breaking', false, false), ('other', 'none', false, true)) v(model, category, new_table, deployable)""")
def plan_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which models a plan gives a new table, and which of these production may show later."""
    customer = Model("customer", kind=Kind.EXTERNAL, path=f"{sf_dir}/customer.parquet")
    ctx = project(spark, customer, Model("totals", CHANGED, start="2024-05-01"), Model("child", "SELECT sum(n) AS n FROM {totals}", start="2024-05-01"), Model("other", "SELECT 1 AS one", start="2024-05-01"))
    ctx.apply(ctx.plan(now="2024-05-02"))
    shown = ctx.ledger.environment("prod")["tables"]
    ctx.add(with_changes(ctx.models["totals"], query=CHANGES[1][1]))
    plan = ctx.plan(now="2024-05-02")
    categories = {c.name: c.category.value for c in plan.changes}
    return values(spark, "model string, category string, new_table boolean, deployable boolean", [(n, categories.get(n, "none"), plan.tables[n] != shown[n], plan.deployable[n]) for n in ("totals", "child", "other")])


@registered("""SELECT * FROM (VALUES (1, 'before_all', ''), (2, 'restate', 'daily'), (3, 'load', 'daily'), (4, 'promote', 'daily'), (5, 'demote', 'gone'), (6, 'after_all', '')) v(place, stage, models)""")
def plan_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = project(spark, *timed(sf_dir), Model("gone", "SELECT 1 AS one", start="1995-01-01"))
    ctx.apply(ctx.plan(now="1995-01-03"))
    del ctx.models["gone"]
    plan = ctx.plan(restate=["daily"], start="1995-01-01", end="1995-01-01", now="1995-01-03")
    return values(spark, "place int, stage string, models string", [(i + 1, s, ",".join(m)) for i, (s, m) in enumerate(plan.stages())])


@registered("""SELECT * FROM (VALUES ('gaps', 'daily 1995-01-01 1995-01-03'), ('expired', 'dev'), ('environments', 'prod'), ('dropped', '1')) v(step, outcome)""")
def environment_housekeeping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a plan that starts too late would lose, an environment whose time is over, and tables that nobody shows."""
    ctx = project(spark, *timed(sf_dir))
    ctx.apply(ctx.plan(now="1995-01-04"))
    ctx.add(with_changes(ctx.models["daily"], query=ctx.models["daily"].query.replace("count(*)", "count(1) + 0")))
    late = ctx.plan("prod", start="1995-01-03", now="1995-01-04")
    stamp = lambda ms: f"{t.from_millis(ms):%Y-%m-%d}"
    out = [("gaps", ";".join(f"{n} {stamp(a)} {stamp(b)}" for n, i in ctx.gaps(late).items() for a, b in i))]
    ctx.apply(ctx.plan("dev", now="1995-01-04"), days=7)
    out += [("expired", ",".join(ctx.expire("1995-01-12"))), ("environments", ",".join(ctx.environments()))]
    return values(spark, "step string, outcome string", [*out, ("dropped", str(len([n for n in ctx.janitor() if n.startswith("daily")])))])


@registered("""SELECT * FROM (VALUES ('environments', 'prod'), ('loaded', '3'), ('form', '3'), ('steps', 'one,two')) v(fact, value)""")
def state_export_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of one project loaded into another, and state of an old form brought up to date."""
    ctx, other = project(spark, *timed(sf_dir)), project(spark, *timed(sf_dir))
    ctx.apply(ctx.plan(now="1995-01-04"))
    other.ledger.load(ctx.ledger.dump())
    table = other.ledger.environment("prod")["tables"]["daily"]
    loaded = sum((b - a) // DAY for a, b in other.ledger.intervals(table))
    new = migrated({"form": 1, "done": []}, {1: lambda s: s | {"done": [*s["done"], "one"]}, 2: lambda s: s | {"done": [*s["done"], "two"]}})
    return values(spark, "fact string, value string", [("environments", ",".join(other.environments())), ("loaded", str(loaded)), ("form", str(new["form"])), ("steps", ",".join(new["done"]))])


@query("""SELECT * FROM (VALUES ('not_null', true, 0, true), ('accepted_range_non_blocking', false, 5, false), ('not_empty_string', false, 0, true)) v(audit, blocks, n, passed)""")
def audit_outcomes(spark: SparkSession, nation: DataFrame) -> DataFrame:
    """Blocking and non-blocking twins of audits, and what each finds."""
    wanted = [Audit("not_null", {"columns": ["n_name"]}), Audit("accepted_range_non_blocking", {"column": "n_regionkey", "min_v": 1}), Audit("not_empty_string", {"column": "n_name"}, blocking=False)]
    return values(spark, "audit string, blocks boolean, n int, passed boolean", [(o.audit.name, o.audit.blocks, o.count, o.passed) for o in failures(nation, wanted)])


CASE_TEXT = """
whole:
  model: paid
  inputs:
    raw: {format: csv, rows: "id,amount\\n1,10\\n1,5\\n2,\\n", columns: {id: int, amount: int}}
    names: {query: "SELECT 1 AS id, 'a' AS name UNION ALL SELECT 2, 'b'"}
  output:
    rows: [{name: a, total: 15, day: 2024-03-04}]
    ctes: {sums: {rows: [{id: 1, total: 15}, {id: 2, total: null}], columns: {id: int, total: bigint}}}
  execution: 2024-03-04
fails:
  model: paid
  inputs:
    raw: [{id: 1, amount: 1}]
    names: [{id: 1, name: a}]
  output:
    rows: [{name: a, total: 2, day: 2024-03-04}]
    ctes: {sums: [{id: 1, total: 1}]}
  execution: 2024-03-04
partial:
  model: paid
  partial: true
  inputs:
    raw: [{id: 1, amount: 1}]
    names: [{id: 1, name: a}]
  output: [{name: a}]
"""


@query("""SELECT * FROM (VALUES ('whole', 0), ('whole/sums', 0), ('fails', 2), ('fails/sums', 0), ('partial', 0)) v("case", n)""")
def model_cases(spark: SparkSession) -> DataFrame:
    """Tests of a model with rows from CSV, YAML and SQL, of a common table expression, and at a frozen date."""
    paid = Model("paid", "WITH sums AS (SELECT id, sum(amount) AS total FROM {raw} GROUP BY id) SELECT name, total, current_date() AS day FROM sums JOIN {names} USING (id) WHERE total IS NOT NULL", start="2024-01-01")
    ctx = project(spark, paid)
    return values(spark, "case string, n int", [(n, d.count()) for n, d in ctx.run_tests(load_cases(CASE_TEXT, ctx.models)).items()])


@query("SELECT DATE '2023-05-06' AS a, 'current_date' AS b, TIMESTAMP '2023-05-06 07:08:09' AS c, 1 AS current_dates")
def frozen_clock(spark: SparkSession) -> DataFrame:
    """SQL with the current date and time of a test; quoted texts and other names stay."""
    text = frozen_times("SELECT current_date AS a, 'current_date' AS b, CAST(now() AS TIMESTAMP_NTZ) AS c, /* now() */ 1 AS current_dates", datetime(2023, 5, 6, 7, 8, 9, tzinfo=UTC))
    return spark.sql(text)


@registered("""SELECT 'generated' AS "case", 0 AS n""")
def generated_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test made from present rows passes."""
    region = Model("region", kind=Kind.EXTERNAL, path=f"{sf_dir}/region.parquet")
    ctx = project(spark, region, Model("counted", "SELECT count(*) AS n, max(r_name) AS last FROM {region}", start="2024-05-01"))
    ctx.apply(ctx.plan(now="2024-05-02"))
    return values(spark, "case string, n int", [("generated", ctx.test(ctx.create_test("counted")).count())])


@registered("""SELECT * FROM (VALUES ('starry', 'invalid_select_star_expansion'), ('starry', 'no_select_star'), ('starry', 'no_missing_unit_test'), ('wrong', 'ambiguous_or_invalid_column'), ('unnamed', 'no_ambiguous_projections'), ('wrong', 'no_missing_unit_test')) v(model, rule)""")
def lint_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that models break (owners, grains, audits and unknown parents left out)."""
    raw = Model("raw", kind=Kind.EXTERNAL, path=f"{sf_dir}/nation.parquet")
    ctx = project(spark, raw, Model("starry", "SELECT * FROM {raw}"), Model("wrong", "SELECT no_such_column FROM {raw}"), Model("unnamed", "SELECT n_nationkey + 1, n_name FROM {raw}"), Model("fine", "SELECT n_name FROM {raw}"))
    shown = {"invalid_select_star_expansion", "no_select_star", "no_missing_unit_test", "ambiguous_or_invalid_column", "no_ambiguous_projections"}
    return values(spark, "model string, rule string", [(m, r) for m, rules in ctx.lint(tested=["unnamed", "fine"]).items() for r in rules if r in shown])


# intervals, schedules and times


@query(january(("day", 1, 3)) + """ UNION ALL SELECT * FROM (VALUES ('hours outward', TIMESTAMP '2024-01-01 05:00:00', TIMESTAMP '2024-01-01 08:00:00'), ('hours inward', TIMESTAMP '2024-01-01 06:00:00', TIMESTAMP '2024-01-01 07:00:00'),
('partial', TIMESTAMP '2024-01-01 05:00:00', TIMESTAMP '2024-01-01 07:10:00'), ('month', TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-01')) w""")
def interval_bounds(spark: SparkSession) -> DataFrame:
    """Ranges in whole steps: an end that names a day lies inside, a moment does not."""
    low, high, u = "2024-01-01 05:30:00", "2024-01-01 07:10:00", t.IntervalUnit
    return day_rows(spark, {
        "day": [iv.bounds("2024-01-01", "2024-01-02", u.DAY)], "hours outward": [iv.bounds(low, high, u.HOUR)], "hours inward": [iv.bounds(low, high, u.HOUR, outward=False)],
        "partial": [iv.bounds(low, high, u.HOUR, partials=True)], "month": [iv.bounds("2024-01-10", "2024-02-03", u.MONTH)],
    })


@query(january(("difference", 1, 2), ("difference", 4, 5), ("uninterrupted", 1, 2), ("contiguous", 1, 4), ("contiguous", 6, 8), ("batches", 1, 3), ("batches", 3, 4), ("batches", 6, 8), ("gaps", 2, 3), ("gaps", 5, 6)))
def interval_operations(spark: SparkSession) -> DataFrame:
    """Differences, contiguous runs, batches of at most two days, and what a replacement would lose."""
    grid = days((1, 2), (2, 3), (3, 4), (6, 7), (7, 8))
    return day_rows(spark, {
        "difference": iv.difference(days((1, 2), (2, 3), (4, 5)), days((2, 3))), "uninterrupted": iv.difference(days((1, 2), (2, 3), (4, 5)), days((2, 3)), uninterrupted=True),
        "contiguous": iv.contiguous(grid), "batches": iv.batches(grid, 2), "gaps": iv.gaps(days((1, 6)), days((1, 2), (3, 5))),
    })


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 29 = 0), r AS (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS run FROM d),
n AS (SELECT day, run, (row_number() OVER (PARTITION BY run ORDER BY day) - 1) // 2 AS part FROM r)
SELECT CAST(min(day) AS TIMESTAMP) AS "start", CAST(max(day) + 1 AS TIMESTAMP) AS "end" FROM n GROUP BY run, part""")
def interval_batches(spark: SparkSession, orders: DataFrame) -> DataFrame:
    """Loaded days in batches of at most two that follow each other."""
    found = sorted(t.millis(r[0]) for r in orders.where("o_orderkey % 29 = 0").select(F.to_date("o_orderdate")).distinct().collect())
    stamp = lambda ms: t.from_millis(ms).replace(tzinfo=None)
    return values(spark, "start timestamp_ntz, end timestamp_ntz", [(stamp(a), stamp(b)) for a, b in iv.batches([(d, d + DAY) for d in found], 2)])


@query(january(("yes", 1, 2), ("yes", 2, 3), ("yes", 5, 6), ("long runs", 1, 2), ("long runs", 2, 3), ("until", 1, 2), ("fresh", 1, 2)))
def signal_readiness(spark: SparkSession) -> DataFrame:
    """What signals let through: all, runs of two days, what ends in time, and what has newer files."""
    store, grid = store_of(spark), days((1, 2), (2, 3), (5, 6))
    store.write("t", spark.range(1))
    path = f"{store.files.root}/t"
    return day_rows(spark, {
        "yes": iv.ready(grid, lambda run: True), "no": iv.ready(grid, lambda run: False), "long runs": iv.ready(grid, lambda run: len(run) > 1), "until": iv.ready(grid, until(lambda: days((1, 2))[0][1])),
        "fresh": iv.ready(grid[:1], fresh(spark, [path], lambda: 0)), "stale": iv.ready(grid[:1], fresh(spark, [path], lambda: 1 << 60)),
    })


@query(january(("never before", 8, 10), ("due", 8, 10), ("all", 1, 10), ("own steps", 2, 4), ("self", 2, 16)) + """ UNION ALL SELECT 'months', TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01'""")
def restatements(spark: SparkSession) -> DataFrame:
    """What a schedule takes out of the ledger, and what a restatement means in a model's own steps."""
    loaded, weekly, now = days((1, 10)), t.Cron("@weekly"), datetime(2024, 1, 16, 3, tzinfo=UTC)
    due = lambda last, count: [x] if (x := iv.due_restatement(last, weekly, now, loaded, count, t.IntervalUnit.DAY)) else []
    some = (days((2, 3))[0][0] + 3_600_000, days((3, 4))[0][0] + 3_600_000)
    return day_rows(spark, {
        "never before": due(None, 2), "due": due(datetime(2024, 1, 8, tzinfo=UTC), 2), "not yet": due(datetime(2024, 1, 15, tzinfo=UTC), 2), "all": due(None, None),
        "own steps": [iv.restated(some, t.IntervalUnit.DAY, False, now)], "self": [iv.restated(some, t.IntervalUnit.DAY, True, now)], "months": [iv.restated(some, t.IntervalUnit.MONTH, False, now)],
    })


@query("""SELECT * FROM (VALUES ('declared', TIMESTAMP '2020-01-01'), ('from parents', TIMESTAMP '2024-01-01'), ('last scheduled', TIMESTAMP '2024-05-14')) v("case", "start")""")
def start_inference(spark: SparkSession) -> DataFrame:
    daily = t.Cron("@daily")
    found = {"declared": iv.first_start("2020-01-01", [5], daily, NOW), "from parents": iv.first_start(None, [t.millis("2024-02-01"), t.millis("2024-01-01")], daily, NOW), "last scheduled": iv.first_start(None, [], daily, NOW)}
    return values(spark, "case string, start timestamp_ntz", [(k, t.from_millis(v).replace(tzinfo=None)) for k, v in found.items()])


@query("""SELECT * FROM (VALUES ('@hourly', TIMESTAMP '2024-05-15 12:00:00', TIMESTAMP '2024-05-15 12:00:00', TIMESTAMP '2024-05-15 13:00:00', 'HOUR'), ('@daily', TIMESTAMP '2024-05-15', TIMESTAMP '2024-05-15', TIMESTAMP '2024-05-16', 'DAY'),
('@weekly', TIMESTAMP '2024-05-12', TIMESTAMP '2024-05-12', TIMESTAMP '2024-05-19', 'DAY'), ('@monthly', TIMESTAMP '2024-05-01', TIMESTAMP '2024-05-01', TIMESTAMP '2024-06-01', 'MONTH'), ('@yearly', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-01', TIMESTAMP '2025-01-01', 'YEAR'),
('*/5 * * * *', TIMESTAMP '2024-05-15 12:30:00', TIMESTAMP '2024-05-15 12:25:00', TIMESTAMP '2024-05-15 12:35:00', 'FIVE_MINUTE'), ('30 6 1,15 * *', TIMESTAMP '2024-05-15 06:30:00', TIMESTAMP '2024-05-15 06:30:00', TIMESTAMP '2024-06-01 06:30:00', 'DAY'),
('0 9-17/4 * * mon-fri', TIMESTAMP '2024-05-15 09:00:00', TIMESTAMP '2024-05-15 09:00:00', TIMESTAMP '2024-05-15 13:00:00', 'HOUR'), ('0 0 29 2 *', TIMESTAMP '2024-02-29', TIMESTAMP '2024-02-29', TIMESTAMP '2028-02-29', 'YEAR')) v(cron, at_or_before, previous, following, unit)""")
def cron_schedules(spark: SparkSession) -> DataFrame:
    """Schedules around half past twelve on a Wednesday."""
    texts = ["@hourly", "@daily", "@weekly", "@monthly", "@yearly", "*/5 * * * *", "30 6 1,15 * *", "0 9-17/4 * * mon-fri", "0 0 29 2 *"]
    rows = []
    for text in texts:
        cron = t.Cron(text)
        unit = "YEAR" if text == "0 0 29 2 *" else cron.unit().name
        rows.append((text, *[x.replace(tzinfo=None) for x in (cron.floor(NOW), cron.previous(NOW), cron.next(NOW))], unit))
    return values(spark, "cron string, at_or_before timestamp_ntz, previous timestamp_ntz, following timestamp_ntz, unit string", rows)


@query("""SELECT * FROM (VALUES ('20240101', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-02'), ('1704067200000', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-01'), ('2024-01-01 10:00:00', TIMESTAMP '2024-01-01 10:00:00', TIMESTAMP '2024-01-01 10:00:00'),
('yesterday', TIMESTAMP '2024-05-14', TIMESTAMP '2024-05-15'), ('1 week ago', TIMESTAMP '2024-05-08', TIMESTAMP '2024-05-09'), ('2 hours ago', TIMESTAMP '2024-05-15 10:30:00', TIMESTAMP '2024-05-15 10:30:00'), ('3 months ago', TIMESTAMP '2024-02-15', TIMESTAMP '2024-02-16')) v(text, "time", "end")""")
def time_texts(spark: SparkSession) -> DataFrame:
    """Times as users write them, and where a range that ends with them ends."""
    texts = ["20240101", "1704067200000", "2024-01-01 10:00:00", "yesterday", "1 week ago", "2 hours ago", "3 months ago"]
    return values(spark, "text string, time timestamp_ntz, end timestamp_ntz", [(x, t.to_datetime(x, NOW).replace(tzinfo=None), t.exclusive_end(x, NOW).replace(tzinfo=None)) for x in texts])


@query("""SELECT * FROM (VALUES ('start_ds', '2024-01-01'), ('end_ds', '2024-01-02'), ('end_ts', '2024-01-02 23:59:59.999999'), ('start_millis', '1704067200000'), ('execution_hour', '12'), ('start_date', '2024-01-01'), ('latest_ds', '2024-01-02'), ('start_epoch', '1704067200.0')) v(name, value)""")
def time_variables(spark: SparkSession) -> DataFrame:
    """Variables of a load of two days."""
    found = t.variables("2024-01-01", "2024-01-02", NOW)
    return values(spark, "name string, value string", [(n, str(found[n])) for n in ("start_ds", "end_ds", "end_ts", "start_millis", "execution_hour", "start_date", "latest_ds", "start_epoch")])


@query("""SELECT strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)), '%Y-%m-%d %H') AS hour, count(*) AS n FROM orders GROUP BY ALL""")
def partition_truncation(spark: SparkSession, orders: DataFrame) -> DataFrame:
    """The names of the parts that rows of a time-partitioned table go to, by unit."""
    at = F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    u = t.IntervalUnit
    return orders.groupBy(F.date_format("o_orderdate", u.YEAR.label).alias("year"), F.date_format("o_orderdate", u.MONTH.label).alias("month"), F.date_format(at, u.HOUR.label).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


# schema changes


BEFORE = "id int, name string, price decimal(10,2), old string, nested struct<a: int, b: string>, many array<struct<x: int>>"
AFTER = "id bigint, name int, price decimal(12,2), nested struct<a: int, c: date>, many array<struct<x: int, y: string>>, fresh double"


@query("""SELECT * FROM (VALUES ('drop', 'old', true, false), ('drop', 'name', true, false), ('drop', 'nested.b', true, false), ('add', 'fresh', false, true), ('add', 'name', false, true), ('add', 'nested.c', false, true), ('add', 'many.element.y', false, true),
('alter', 'id', false, false), ('alter', 'price', false, false)) v(kind, path, destructive, additive)""")
def schema_changes(spark: SparkSession) -> DataFrame:
    """The steps from one schema to another, nested ones too; a type that does not fit is dropped and added."""
    steps = E.changes(T.StructType.fromDDL(BEFORE), T.StructType.fromDDL(AFTER))
    return values(spark, "kind string, path string, destructive boolean, additive boolean", [(s.kind, ".".join(s.path), s.destructive, s.additive) for s in steps])


@query("""SELECT * FROM (VALUES ('int', 'bigint', true), ('bigint', 'int', false), ('decimal(10,2)', 'decimal(12,2)', true), ('decimal(10,2)', 'decimal(10,3)', false), ('decimal(10,2)', 'decimal(11,3)', true), ('float', 'double', true), ('double', 'float', false), ('date', 'timestamp', true), ('string', 'int', false), ('string', 'string', true)) v("from", "to", compatible)""")
def compatible_types(spark: SparkSession) -> DataFrame:
    pairs = [("int", "bigint"), ("bigint", "int"), ("decimal(10,2)", "decimal(12,2)"), ("decimal(10,2)", "decimal(10,3)"), ("decimal(10,2)", "decimal(11,3)"), ("float", "double"), ("double", "float"), ("date", "timestamp"), ("string", "int"), ("string", "string")]
    kind = lambda x: T.StructType.fromDDL(f"c {x}")["c"].dataType
    return values(spark, "from string, to string, compatible boolean", [(a, b, E.compatible(kind(a), kind(b))) for a, b in pairs])


@query("""SELECT * FROM (VALUES ('error', 'refused', 0), ('warn', 'passed', 9), ('allow', 'passed', 9), ('ignore', 'passed', 6)) v(policy, outcome, steps)""")
def evolution_policies(spark: SparkSession) -> DataFrame:
    """What each policy does with destructive steps."""
    steps, out = E.changes(T.StructType.fromDDL(BEFORE), T.StructType.fromDDL(AFTER)), []
    for policy in E.Policy:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                out.append((policy.value, "passed", len(E.enforce(steps, policy))))
        except E.EvolutionError:
            out.append((policy.value, "refused", 0))
    return values(spark, "policy string, outcome string, steps int", out)


@query("SELECT CAST(s_suppkey AS DOUBLE) AS s_suppkey, s_name, CAST(NULL AS VARCHAR) AS note, s_acctbal FROM supplier")
def schema_evolution(spark: SparkSession, supplier: DataFrame) -> DataFrame:
    """A table takes on a wider type and a new column, and loses one."""
    store = store_of(spark)
    store.write("t", supplier.select(F.col("s_suppkey").cast("int").alias("s_suppkey"), "s_name", "s_nationkey", "s_acctbal"))
    store.evolve("t", T.StructType.fromDDL("s_suppkey double, s_name string, note string, s_acctbal double"), destructive=E.Policy.ALLOW)
    return store.read("t").select("s_suppkey", "s_name", "note", "s_acctbal")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(NULL AS DATE) AS day, n_name AS name FROM (SELECT n_nationkey, n_name FROM nation)")
def column_alignment(spark: SparkSession, nation: DataFrame) -> DataFrame:
    """Columns in a table's order and types: casts, nulls for missing ones, others dropped."""
    rows = nation.select(F.col("n_name").alias("name"), "n_regionkey", "n_nationkey")
    return R.align(rows, T.StructType.fromDDL("n_nationkey bigint, day date, name string"))


# streams


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Counts of daily windows of a stream that has read all there is."""
    folder = scratch_folder(spark, "stream")
    events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(f"{folder}/in")
    counts = windowed(stream, "ts", "1 day", "400 days", ["event_type"], [F.count(F.lit(1)).alias("n")])

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'changed' ELSE event_type END AS kind FROM events")
def stream_merge(spark: SparkSession, events: DataFrame) -> DataFrame:
    """A table that a stream merges into: rows, and later corrections of some of them."""
    folder, store = scratch_folder(spark, "stream"), store_of(spark)
    rows = events.select("event_id", F.col("event_type").alias("kind"))
    for part in (rows, rows.where("event_id % 5 = 0").withColumn("kind", F.lit("changed"))):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        merge_stream(stream, store, "kinds", ["event_id"], f"{folder}/progress").awaitTermination()
    return store.read("kinds")


# macros, blueprints, graphs, lineage, metrics


@macro("repeat_names")
def repeat_names(names: list[str], times: int = 1, upper: bool = False) -> list[str]:
    return [n.upper() if upper else n for n in names for _ in range(times)]


@macro()
def plus(column: Column, *more: int) -> Column:
    for m in more:
        column = column + m
    return column


@query("""SELECT n_nationkey + 3 AS k, 'A,A,B,B' AS names, 'refused' AS wrong FROM nation""")
def typed_macros(spark: SparkSession, nation: DataFrame) -> DataFrame:
    """Macro functions whose arguments take the types of their signatures."""
    try:
        repeat_names(["a"], "many")
        wrong = "taken"
    except (TypeError, ValueError):
        wrong = "refused"
    return nation.select(plus("n_nationkey", "1", 2).alias("k"), F.lit(",".join(repeat_names(("a", "b"), "2", upper="true"))).alias("names"), F.lit(wrong).alias("wrong"))


@query("""SELECT * FROM (VALUES ('m_eu', 'SELECT 3 AS region', 'eu'), ('m_us', 'SELECT 1 AS region', 'us')) v(name, query, tags)""")
def blueprint_models(spark: SparkSession) -> DataFrame:
    """One model for each variant; a variant's values go before the project's."""
    made = blueprints(Model("m_@{Name}", "SELECT @{region} AS region", tags=["@{name}"]), [{"name": "eu"}, {"name": "us", "region": 1}], {"REGION": 3})
    return values(spark, "name string, query string, tags string", [(m.name, m.query, ",".join(m.tags)) for m in made])


@query("""SELECT * FROM (VALUES ('s3://b/prod/cat/sch/tab'), ('x//tab')) v(path)""")
def path_templates(spark: SparkSession) -> DataFrame:
    return values(spark, "path string", [(resolve_template("s3://b/prod/@{catalog_name}/@{schema_name}/@{table_name}", "cat.sch.tab"),), (resolve_template("x/@{schema_name}/@{table_name}", "tab"),)])


@registered("""SELECT * FROM (VALUES ('project', '7'), ('default', 'none'), ('eval', '14'), ('local', '8')) v(name, value)""")
def model_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables of a project in SQL and functions, values computed while the plan is built, local functions."""
    def made(ctx: RunContext) -> DataFrame:
        local = lambda x: x + 1
        return ctx.spark.createDataFrame([("project", str(ctx.var("limit"))), ("default", ctx.var("missing", "none")), ("eval", str(ctx.var("limit") * 2)), ("local", str(local(ctx.var("limit"))))], "name string, value string")

    sql = Model("in_sql", "SELECT CAST(:limit AS STRING) AS value", depends_on=[], start="2024-05-01")
    ctx = project(spark, Model("in_python", made, depends_on=[], start="2024-05-01"), sql, settings={"LIMIT": 7})
    ctx.apply(ctx.plan(now="2024-05-02"))
    assert ctx.table("in_sql").first()[0] == "7"
    return ctx.table("in_python")


@query("SELECT n_nationkey, n_regionkey * 10 + 1 AS tenfold FROM nation")
def sql_function(spark: SparkSession, nation: DataFrame) -> DataFrame:
    """A function defined in SQL, as a statement before a model's query."""
    nation.createOrReplaceTempView("function_nation")
    make = "CREATE OR REPLACE TEMPORARY FUNCTION tenfold_plus(x INT) RETURNS INT RETURN x * 10 + 1"
    kind = nation.schema["n_regionkey"].dataType.simpleString()
    return applied(spark, "with_function", Model("with_function", f"SELECT n_nationkey, CAST(tenfold_plus(CAST(n_regionkey AS INT)) AS {kind}) AS tenfold FROM function_nation", depends_on=[], before=[make], start="2024-05-01"))


GRAPH = {"raw": [], "clean": ["raw"], "daily": ["clean"], "monthly": ["daily"], "ids": ["raw"], "report": ["monthly", "ids"], "alone": []}


@query("""SELECT * FROM (VALUES ('order', 'alone,raw,clean,ids,daily,monthly,report'), ('upstream of monthly', 'clean,daily,raw'), ('downstream of clean', 'daily,monthly,report'), ('roots', 'alone,raw'), ('leaves', 'alone,report'), ('lineage of ids', 'ids,raw,report'), ('reversed order', 'alone,report,ids,monthly,daily,clean,raw')) v(what, nodes)""")
def graph_operations(spark: SparkSession) -> DataFrame:
    g = Graph(GRAPH)
    text = lambda x: ",".join(sorted(x))
    return values(spark, "what string, nodes string", [
        ("order", ",".join(g.order())), ("upstream of monthly", text(g.upstream("monthly"))), ("downstream of clean", text(g.downstream("clean"))), ("roots", text(g.roots)), ("leaves", text(g.leaves)),
        ("lineage of ids", text(g.lineage("ids").parents)), ("reversed order", ",".join(g.reversed().order())),
    ])


@query("""SELECT * FROM (VALUES ('daily', 'daily'), ('+daily', 'clean,daily,raw'), ('daily+', 'daily,monthly,report'), ('+ids+', 'ids,raw,report'), ('*ly', 'daily,monthly'), ('tag:x', 'clean,ids'), ('tag:x & +monthly', 'clean'), ('^(+report)', 'alone'), ('alone | tag:y*', 'alone,report'), ('git:main', 'raw'), ('resource_type:view', 'ids')) v(expression, models)""")
def selector_grammar(spark: SparkSession) -> DataFrame:
    chosen = Selector(Graph(GRAPH), {"clean": ["x"], "ids": ["x"], "report": ["yy"]}, {n: "view" if n == "ids" else "full" for n in GRAPH}, lambda ref: ["raw", "gone"])
    texts = ["daily", "+daily", "daily+", "+ids+", "*ly", "tag:x", "tag:x & +monthly", "^(+report)", "alone | tag:y*", "git:main", "resource_type:view"]
    return values(spark, "expression string, models string", [(x, ",".join(sorted(chosen.select(x)))) for x in texts])


@query("""SELECT * FROM (VALUES ('done', 'alone,clean,ids,raw'), ('failed', 'daily'), ('skipped', 'monthly,report')) v(outcome, nodes)""")
def graph_execution(spark: SparkSession) -> DataFrame:
    """Nodes run after their parents, several at once; what depends on a failure is skipped."""
    done: list[str] = []

    def work(name: str) -> None:
        if name == "daily":
            raise ValueError(name)
        assert set(GRAPH[name]) <= set(done)
        done.append(name)

    failed, skipped = run_graph(Graph(GRAPH), work, 3)
    return values(spark, "outcome string, nodes string", [("done", ",".join(sorted(done))), ("failed", ",".join(failed)), ("skipped", ",".join(sorted(skipped)))])


@query("""SELECT * FROM (VALUES ('status', 'orders', 'o_orderstatus', 'the status'), ('nation', 'customer', 'c_nationkey', NULL), ('worth', 'customer', 'c_acctbal', NULL), ('worth', 'orders', 'o_totalprice', NULL)) v("column", relation, source, description)""")
def lineage_of_columns(spark: SparkSession, orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Where the columns of a query come from, through a subquery, a join and an aggregate."""
    orders.createOrReplaceTempView("lineage_orders")
    customer.createOrReplaceTempView("lineage_customer")
    out = spark.sql("""WITH j AS (SELECT o_orderstatus AS s, c_nationkey AS n, o_totalprice + c_acctbal AS w FROM {o} JOIN {c} ON o_custkey = c_custkey WHERE c_mktsegment <> 'x')
        SELECT s AS status, n AS nation, sum(w) AS worth FROM j GROUP BY 1, 2""", o=orders, c=customer)
    found = column_lineage(out, {"orders": orders, "customer": customer})
    described = inherited_descriptions(found, {"orders": {"o_orderstatus": "the status", "o_totalprice": "the price"}})
    return values(spark, "column string, relation string, source string, description string", [(c, r, s, described.get(c)) for c, by in found.items() for r, names in by.items() for s in sorted(names)])


@query("""SELECT c_mktsegment, count(o_orderkey) AS n, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_orderkey), 4) AS mean FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY 1 ORDER BY 2 DESC LIMIT 3""")
def metric_sql(spark: SparkSession, orders: DataFrame, lineitem: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """A query in SQL over metrics."""
    return semantic(orders, lineitem, customer, nation).sql("SELECT c_mktsegment, METRIC(n_orders) AS n, METRIC(per_order) AS mean FROM __semantic.__table WHERE o_orderstatus = 'O' GROUP BY c_mktsegment ORDER BY n DESC LIMIT 3")


@query("""SELECT o_orderpriority, CAST(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS building, count(DISTINCT o_custkey) AS buyers FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def metric_inference(spark: SparkSession, orders: DataFrame, lineitem: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Metrics written in SQL: what they measure is the table of their results, not that of their conditions."""
    model = semantic(orders, lineitem, customer, nation).add(
        metric_from_sql(spark, "building", "CAST(sum(CASE WHEN customer.c_mktsegment = 'BUILDING' THEN CAST(orders.o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE)"),
        metric_from_sql(spark, "buyers", "count(DISTINCT orders.o_custkey)"),
    )
    assert model.metrics["building"].table == "orders"
    return model.query(["building", "buyers"], ["o_orderpriority"])


@query("""SELECT * FROM (VALUES ('schema_and_table', 'sch__tab_1__v7', 'sch__tab_1__v7__dev'), ('table_only', 'tab_1__v7', 'tab_1__v7__dev'), ('hash', 'md5__' || md5('sch__tab_1__v7'), 'md5__' || md5('sch__tab_1__v7__dev'))) v(convention, "table", preview)""")
def physical_names(spark: SparkSession) -> DataFrame:
    """Names of the tables of a version of a model, by convention."""
    return values(spark, "convention string, table string, preview string", [(c.value, physical_name("cat.sch.tab-1", "v7", c), physical_name("cat.sch.tab-1", "v7", c, "dev")) for c in Convention])


@query("""SELECT * FROM (VALUES ('schema', 'cat.sch.tab', 'cat.sch__dev.tab', 'default__dev.tab'), ('table', 'cat.sch.tab', 'cat.sch.tab__dev', 'default.tab__dev'), ('catalog', 'cat.sch.tab', 'cat__dev.sch.tab', 'refused')) v(target, production, development, short)""")
def view_names(spark: SparkSession) -> DataFrame:
    """Names under which environments show a model."""
    rows = []
    for target in Target:
        try:
            short = view_name("tab", "dev", target)
        except ValueError:
            short = "refused"
        rows.append((target.value, view_name("cat.sch.tab", "prod", target), view_name("cat.sch.tab", "dev", target), short))
    return values(spark, "target string, production string, development string, short string", rows)


@query("""SELECT * FROM (VALUES ('n_name', 'nation'), ('c_mktsegment', 'customer'), ('o_orderstatus', 'orders'), ('l_quantity', '')) v("column", tables)""")
def tables_for_column(spark: SparkSession, orders: DataFrame, lineitem: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """The tables that own a column and can be joined to the orders."""
    model: SemanticModel = semantic(orders, lineitem, customer, nation)
    return values(spark, "column string, tables string", [(c, ",".join(model.tables_with(c, "orders"))) for c in ("n_name", "c_mktsegment", "o_orderstatus", "l_quantity")])


@registered("SELECT n_name FROM nation ORDER BY n_name LIMIT 4")
def evaluate_with_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a model, computed for a range and not written."""
    ctx = project(spark, Model("nation", kind=Kind.EXTERNAL, path=f"{sf_dir}/nation.parquet"), Model("named", "SELECT n_name FROM {nation} ORDER BY n_name", start="2024-05-01"))
    return ctx.evaluate("named", "2024-05-01", "2024-05-01", limit=4)
