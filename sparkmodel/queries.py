"""Queries that exercise the engine's operators on the driver's tables, each with the same rows as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmodel.functions import columns as C
from sparkmodel.functions import frames as R
from sparkmodel.operators import audits as A
from sparkmodel.operators import interval_frames as I
from sparkmodel.operators import table_diff as D
from sparkmodel.operators import writers as W
from sparkmodel.operators.metrics import Metric, Reference, SemanticModel
from sparkmodel.session import scratch_folder
from sparkmodel.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a query; its arguments after (spark, sf_dir) are the tables they are named after."""

    def register(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        tables = make.__code__.co_varnames[1 : make.__code__.co_argcount]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(spark, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})

        key = name or make.__name__
        QUERIES[key] = run
        if sql:
            SQL[key] = sql
        return make

    return register


# models


@query("""
SELECT CAST(o_orderdate AS DATE) AS event_date, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue,
       count(DISTINCT o_orderkey) AS n_orders
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31 23:59:59.999999' GROUP BY 1""")
def revenue_by_day(spark: SparkSession, orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Revenue of every day of a load window: the filter reaches the scan of orders."""
    window = orders.where(F.col("o_orderdate").between(F.lit(datetime(1995, 1, 1)).cast("timestamp_ntz"), F.lit(datetime(1996, 12, 31, 23, 59, 59, 999999)).cast("timestamp_ntz")))
    price = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    joined = window.join(lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.to_date("o_orderdate").alias("event_date")).agg(F.sum(price).cast("double").alias("revenue"), F.countDistinct("o_orderkey").alias("n_orders"))


@query("""
WITH day AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1996-01-02' GROUP BY 1),
before AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1996-01-02' GROUP BY 1)
SELECT coalesce(d.o_custkey, b.o_custkey) AS customer_id, round(coalesce(b.revenue, 0) + coalesce(d.revenue, 0), 2) AS revenue
FROM day d FULL JOIN before b ON d.o_custkey = b.o_custkey""")
def customer_lifetime_increment(spark: SparkSession, orders: DataFrame) -> DataFrame:
    """A model that reads its own last state: yesterday's totals and today's orders in a full join."""
    def total(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col("o_custkey").alias(f"{name}_key")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias(name))

    on, until = F.to_date("o_orderdate"), F.lit("1996-01-02").cast("date")
    day, before = total(orders.where(on == until), "today"), total(orders.where(on < until), "before")
    both = day.join(before, F.col("today_key") == F.col("before_key"), "full_outer")
    return both.select(F.coalesce("today_key", "before_key").alias("customer_id"), F.round(F.coalesce("before", F.lit(0.0)) + F.coalesce("today", F.lit(0.0)), 2).alias("revenue"))


@query("""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)
ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def top_orders_of_latest_day(spark: SparkSession, orders: DataFrame) -> DataFrame:
    """A scalar subquery as predicate, then the ten largest."""
    latest = orders.agg(F.max(F.to_date("o_orderdate")).alias("latest"))
    rows = orders.join(F.broadcast(latest), F.to_date("o_orderdate") == F.col("latest"))
    return rows.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC")
def latest_row(spark: SparkSession, orders: DataFrame) -> DataFrame:
    """The last order of each customer: one aggregate, no sort of the table."""
    return orders.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("o")).select("o_custkey", "o.*")


@query("""
SELECT DISTINCT c.c_custkey AS customer_id, c.c_mktsegment AS status, n.n_name AS nation FROM orders o
LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def customers_of_orders(spark: SparkSession, orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Customers with an order, with attributes from dimension tables; keys are made distinct before the joins."""
    keys = orders.select("o_custkey").distinct()
    rows = keys.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("status"), F.col("n_name").alias("nation")).distinct()


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS maybe FROM part")
def seed_csv_scan(spark: SparkSession, part: DataFrame) -> DataFrame:
    """A seed: CSV files with a header, read with declared types and texts that stand for null."""
    folder = scratch_folder(spark, "seed")
    rows = part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", F.when(F.col("p_size") % 5 == 0, "N/A").otherwise(F.col("p_brand")).alias("maybe"))
    rows.write.csv(folder, header=True, quoteAll=True)
    return S.seed(spark, folder, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, maybe string")


@query("SELECT * FROM (VALUES (1, 'a', DATE '2020-01-01', [1, 2]), (2, NULL, NULL, NULL)) v(id, name, day, parts)")
def values_scan(spark: SparkSession) -> DataFrame:
    """Typed rows, nested values included."""
    from datetime import date

    return S.typed_values(spark, [(1, "a", date(2020, 1, 1), [1, 2]), (2, None, None, None)], "id int, name string, day date, parts array<int>")


# macros


@query("SELECT c_custkey AS c_c_custkey_x, c_name AS c_c_name_x, c_nationkey AS c_c_nationkey_x FROM customer")
def star_exclude_prefix(spark: SparkSession, customer: DataFrame) -> DataFrame:
    return R.star(customer, exclude=["C_ACCTBAL", "c_mktsegment"], prefix="c_", suffix="_x")


CUSTOMERS = "SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer"
SUPPLIERS = "SELECT s_nationkey AS nation, s_suppkey AS key, s_name AS name, CAST(s_acctbal AS BIGINT) AS balance FROM supplier"


def parties(customer: DataFrame, supplier: DataFrame) -> tuple[DataFrame, DataFrame]:
    one = customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return one, supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").cast("bigint").alias("balance"))


@query(f"SELECT key, name, nation FROM ({CUSTOMERS}) UNION ALL SELECT key, name, nation FROM ({SUPPLIERS})")
def union_all_common(spark: SparkSession, customer: DataFrame, supplier: DataFrame) -> DataFrame:
    return R.union_common(*parties(customer, supplier))


@query("SELECT nation FROM (SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier)")
def union_distinct_common(spark: SparkSession, customer: DataFrame, supplier: DataFrame) -> DataFrame:
    return R.union_common(customer.select(F.col("c_nationkey").alias("nation")), supplier.select(F.col("s_nationkey").alias("nation")), how="distinct")


@query(f"SELECT key, name, nation, balance FROM ({CUSTOMERS})")
def union_condition_off(spark: SparkSession, customer: DataFrame, supplier: DataFrame) -> DataFrame:
    return R.union_common(*parties(customer, supplier), condition=False)


@query("""SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS "n_F", CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS "n_O",
CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS "n_P" FROM orders GROUP BY 1""")
def pivot_status_counts(spark: SparkSession, orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_custkey").agg(*R.pivot_columns("o_orderstatus", ["F", "O", "P"], prefix="n_"))


@query("""SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS "F",
CAST(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS "O" FROM orders GROUP BY 1""")
def pivot_sum_price(spark: SparkSession, orders: DataFrame) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(18,2)")
    sums = orders.groupBy("o_orderpriority").agg(*R.pivot_columns("o_orderstatus", ["F", "O"], then=price))
    return sums.select("o_orderpriority", F.col("F").cast("double").alias("F"), F.col("O").cast("double").alias("O"))


@query("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id ASC NULLS LAST) = 1")
def deduplicate_latest(spark: SparkSession, events: DataFrame) -> DataFrame:
    return R.deduplicate(events, ["user_id", "event_type"], ["ts desc", "event_id asc nulls last"])


def _spine(part: str, step: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return R.date_spine(spark, part, "2019-11-05", "2024-02-20")

    QUERIES[f"date_spine_{part}"] = run
    SQL[f"date_spine_{part}"] = f"SELECT CAST(unnest(generate_series(DATE '2019-11-05', DATE '2024-02-20', INTERVAL {step})) AS DATE) AS date_{part}"


for _p, _s in (("day", "1 DAY"), ("week", "7 DAY"), ("month", "1 MONTH"), ("quarter", "3 MONTH"), ("year", "1 YEAR")):
    _spine(_p, _s)


@query("""
SELECT d.date_day, count(o_orderkey) AS n_orders FROM (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1995-12-31', INTERVAL 1 DAY)) AS DATE) AS date_day) d
LEFT JOIN orders ON CAST(o_orderdate AS DATE) = d.date_day GROUP BY 1""")
def date_spine_left_join_daily(spark: SparkSession, orders: DataFrame) -> DataFrame:
    """Counts of every day of a year, days without orders included; orders are counted before the join."""
    daily = orders.where(F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1995-12-31 23:59:59.999999").cast("timestamp_ntz")))
    daily = daily.groupBy(F.to_date("o_orderdate").alias("date_day")).agg(F.count("o_orderkey").alias("n"))
    return R.date_spine(spark, "day", "1995-01-01", "1995-12-31").join(daily, "date_day", "left").select("date_day", F.coalesce("n", F.lit(0)).alias("n_orders"))


KEY_PARTS = "concat_ws('|', coalesce(CAST(l_orderkey AS VARCHAR), '{n}'), coalesce(CAST(l_linenumber AS VARCHAR), '{n}'), coalesce(nullif(l_returnflag, 'N'), '{n}'))".format(n=C.NULL_PART)


@query(f"SELECT l_orderkey, l_linenumber, md5({KEY_PARTS}) AS key FROM lineitem")
def surrogate_key_md5(spark: SparkSession, lineitem: DataFrame) -> DataFrame:
    return lineitem.select("l_orderkey", "l_linenumber", C.surrogate_key("l_orderkey", "l_linenumber", F.nullif(F.col("l_returnflag"), F.lit("N"))).alias("key"))


@query(f"SELECT l_orderkey, l_linenumber, sha256({KEY_PARTS}) AS key FROM lineitem")
def surrogate_key_sha256(spark: SparkSession, lineitem: DataFrame) -> DataFrame:
    return lineitem.select("l_orderkey", "l_linenumber", C.surrogate_key("l_orderkey", "l_linenumber", F.nullif(F.col("l_returnflag"), F.lit("N")), algorithm="SHA256").alias("key"))


HOLES = "SELECT l_orderkey, l_linenumber, nullif(l_linenumber, 1) AS a, nullif(CAST(l_quantity AS INT) % 4, 0) AS b FROM lineitem"


def holes(lineitem: DataFrame) -> DataFrame:
    return lineitem.select("l_orderkey", "l_linenumber", F.nullif("l_linenumber", F.lit(1)).alias("a"), F.nullif(F.col("l_quantity").cast("int") % 4, F.lit(0)).alias("b"))


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE coalesce(a, 0) + coalesce(b, 0) END AS v FROM ({HOLES})")
def safe_add(spark: SparkSession, lineitem: DataFrame) -> DataFrame:
    return holes(lineitem).select("l_orderkey", "l_linenumber", C.safe_add("a", "b").alias("v"))


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE coalesce(a, 0) - coalesce(b, 0) END AS v FROM ({HOLES})")
def safe_sub(spark: SparkSession, lineitem: DataFrame) -> DataFrame:
    return holes(lineitem).select("l_orderkey", "l_linenumber", C.safe_sub("a", "b").alias("v"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_discount, 0), 4) AS v FROM lineitem")
def safe_div(spark: SparkSession, lineitem: DataFrame) -> DataFrame:
    return lineitem.select("l_orderkey", "l_linenumber", F.round(C.safe_div("l_extendedprice", "l_discount"), 4).alias("v"))


def _haversine(unit: str, rate: float) -> None:
    places = "SELECT c_custkey, (c_custkey % 90) * 1.0 AS lat1, (c_custkey % 180) * 1.0 AS lon1, (c_nationkey * 3 - 30) * 1.0 AS lat2, (c_nationkey * 7 - 80) * 1.0 AS lon2 FROM customer"
    SQL[f"haversine_{unit}"] = f"""SELECT c_custkey, round(7922 * asin(sqrt(power(sin(radians((lat2 - lat1) / 2)), 2) + cos(radians(lat1)) * cos(radians(lat2))
        * power(sin(radians((lon2 - lon1) / 2)), 2))) * {rate}, 4) AS distance FROM (SELECT c_custkey, CAST(lat1 AS DOUBLE) AS lat1, CAST(lon1 AS DOUBLE) AS lon1, CAST(lat2 AS DOUBLE) AS lat2, CAST(lon2 AS DOUBLE) AS lon2 FROM ({places}))"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = spark.read.parquet(f"{sf_dir}/customer.parquet")
        at = [(F.col("c_custkey") % 90), (F.col("c_custkey") % 180), (F.col("c_nationkey") * 3 - 30), (F.col("c_nationkey") * 7 - 80)]
        return c.select("c_custkey", F.round(C.haversine(*[x.cast("double") for x in at], unit=unit), 4).alias("distance"))

    QUERIES[f"haversine_{unit}"] = run


_haversine("mi", 1.0)
_haversine("km", 1.60934)


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1 HAVING count(*) > 5 ORDER BY 2 DESC LIMIT 2")
def conditional_clauses_on(spark: SparkSession, orders: DataFrame) -> DataFrame:
    return clauses(orders, True)


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def conditional_clauses_off(spark: SparkSession, orders: DataFrame) -> DataFrame:
    return clauses(orders, False)


def clauses(orders: DataFrame, on: bool) -> DataFrame:
    rows = R.clause(orders, on, lambda d: d.where("o_totalprice > 100000")).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    rows = R.clause(rows, on, lambda d: d.where("n > 5"))
    return R.clause(rows, on, lambda d: d.orderBy(F.desc("n")).limit(2))


@query("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%BRASS%' OR p_type LIKE '%STEEL%' OR p_size IN (1, 2, 3)")
def each_reduce_or(spark: SparkSession, part: DataFrame) -> DataFrame:
    wanted = C.each(C.keep(["BRASS", "", "STEEL"], bool), lambda w: F.col("p_type").contains(w))
    return part.where(C.any_of(C.fold(wanted, lambda a, b: a | b), F.col("p_size").isin(1, 2, 3), C.choose(False, F.lit(True)))).select("p_partkey", "p_type")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN '1' ELSE '0' END AS flag, CAST(o_custkey AS VARCHAR) AS whole, CAST(CAST(o_totalprice AS DECIMAL(38,3)) AS VARCHAR) AS fraction,
strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS moment FROM orders""")
def value_normalization(spark: SparkSession, orders: DataFrame) -> DataFrame:
    rows = orders.select("o_orderkey", (F.col("o_totalprice") > 150000).alias("flag"), F.col("o_custkey").alias("whole"), F.col("o_totalprice").alias("fraction"), F.to_date("o_orderdate").alias("day"), F.col("o_orderdate").alias("moment"))
    return rows.select("o_orderkey", *[C.canonical_text(f.name, f.dataType).alias(f.name) for f in rows.schema.fields[1:]])


@query("""SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem
WHERE (l_orderkey, l_linenumber) IN (SELECT o_orderkey, CAST(o_orderkey % 7 AS INT) FROM orders WHERE o_orderstatus = 'F')""")
def tuple_in_semi_join(spark: SparkSession, lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    keys = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 7).cast("int").alias("l_linenumber"))
    return R.keys_in(lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"), ["l_orderkey", "l_linenumber"], keys)


@query("""SELECT l_orderkey, l_linenumber FROM lineitem
WHERE (l_orderkey, l_linenumber) NOT IN (SELECT o_orderkey, CAST(o_orderkey % 7 AS INT) FROM orders)""")
def tuple_not_in_anti_join(spark: SparkSession, lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    keys = orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 7).cast("int").alias("l_linenumber"))
    return R.keys_in(lineitem.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], keys, negate=True)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE (o_custkey, o_orderkey) > (100, 500) ORDER BY o_custkey, o_orderkey LIMIT 50")
def keyset_page(spark: SparkSession, orders: DataFrame) -> DataFrame:
    return R.keyset_page(orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey", "o_orderkey"], (100, 500), 50)


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_count(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Counts of fixed windows of one day."""
    counts = events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.to_date("window.start").alias("day"), "event_type", "n")


@query("""WITH RECURSIVE reach AS (SELECT 0 AS level, r_regionkey AS key, r_name AS name FROM region UNION ALL
SELECT level + 1, n_nationkey, n_name FROM reach JOIN nation ON n_regionkey = key WHERE level = 0) SELECT level, key, name FROM reach""")
def recursive_query(spark: SparkSession, region: DataFrame, nation: DataFrame) -> DataFrame:
    """A recursive common table expression goes to the engine as it is."""
    return spark.sql("""WITH RECURSIVE reach(level, key, name) AS (SELECT 0, r_regionkey, r_name FROM {region} UNION ALL
        SELECT level + 1, n_nationkey, n_name FROM reach JOIN {nation} ON n_regionkey = key WHERE level = 0) SELECT level, key, name FROM reach""", region=region, nation=nation)


# writers: targets and new rows derive from the tables


def order_rows(orders: DataFrame) -> DataFrame:
    return orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("day"))


ORDER_ROWS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS day FROM orders"
TARGET = f"SELECT * FROM ({ORDER_ROWS}) WHERE o_orderkey % 3 <> 0"
SOURCE = f"SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, o_totalprice + 1 AS o_totalprice, day FROM ({ORDER_ROWS}) WHERE o_orderkey % 2 = 0"


def both_sides(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = order_rows(orders)
    source = rows.where("o_orderkey % 2 = 0").withColumns({"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") + 1})
    return rows.where("o_orderkey % 3 <> 0"), source


@query(f"SELECT * FROM ({SOURCE})")
def write_full_replace(spark: SparkSession, orders: DataFrame) -> DataFrame:
    return W.replaced(*both_sides(orders))


@query(f"SELECT * FROM ({TARGET}) UNION ALL SELECT * FROM ({SOURCE})")
def write_append(spark: SparkSession, orders: DataFrame) -> DataFrame:
    return W.appended(*both_sides(orders))


@query(f"""SELECT * FROM ({TARGET}) WHERE NOT day BETWEEN DATE '1995-03-01' AND DATE '1996-02-28'
UNION ALL SELECT * FROM ({SOURCE}) WHERE day BETWEEN DATE '1995-03-01' AND DATE '1996-02-28'""")
def write_overwrite_time_range(spark: SparkSession, orders: DataFrame) -> DataFrame:
    return W.overwritten_range(*both_sides(orders), "day", F.lit("1995-03-01").cast("date"), F.lit("1996-02-28").cast("date"))


@query(f"""WITH s AS (SELECT * FROM ({SOURCE}) WHERE o_custkey % 5 = 0)
SELECT * FROM ({TARGET}) t WHERE t.o_custkey NOT IN (SELECT o_custkey FROM s) UNION ALL SELECT * FROM s""")
def write_overwrite_partition(spark: SparkSession, orders: DataFrame) -> DataFrame:
    target, source = both_sides(orders)
    return W.overwritten_partitions(target, source.where("o_custkey % 5 = 0"), ["o_custkey"])


MERGED = f"FROM ({TARGET}) t FULL JOIN ({SOURCE}) s ON t.o_orderkey = s.o_orderkey"


def _merged(expressions: dict[str, str]) -> str:
    names = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "day")
    return ", ".join(f"{expressions.get(c, f'coalesce(s.{c}, t.{c})')} AS {c}" for c in names)


@query(f"SELECT {_merged({})} {MERGED}")
def write_merge_default(spark: SparkSession, orders: DataFrame) -> DataFrame:
    return W.merged(*both_sides(orders), ["o_orderkey"])


@query(f"""SELECT {_merged({
    'o_orderstatus': "CASE WHEN t.o_orderkey IS NULL THEN s.o_orderstatus WHEN s.o_orderkey IS NULL THEN t.o_orderstatus WHEN t.o_orderkey % 4 = 0 AND t.o_totalprice <= 200000 THEN 'U' ELSE t.o_orderstatus END",
    'o_totalprice': "CASE WHEN t.o_orderkey IS NULL THEN s.o_totalprice WHEN s.o_orderkey IS NULL THEN t.o_totalprice WHEN t.o_orderkey % 4 = 0 AND t.o_totalprice <= 200000 THEN s.o_totalprice * 2 ELSE t.o_totalprice END"})}
{MERGED} WHERE NOT coalesce(s.o_orderkey IS NOT NULL AND t.o_totalprice > 200000, false)""")
def write_merge_when_matched(spark: SparkSession, orders: DataFrame) -> DataFrame:
    clauses = [W.When(delete=True, condition="target.o_totalprice > 200000"), W.When(update={"o_orderstatus": "'U'", "o_totalprice": "source.o_totalprice * 2"}, condition="target.o_orderkey % 4 = 0")]
    return W.merged(*both_sides(orders), ["o_orderkey"], clauses)


@query(f"""SELECT {_merged({})} FROM ({TARGET}) t FULL JOIN ({SOURCE}) s ON t.o_orderkey = s.o_orderkey AND t.day >= DATE '1995-06-01'""")
def write_merge_filter_duplicates(spark: SparkSession, orders: DataFrame) -> DataFrame:
    return W.merged(*both_sides(orders), ["o_orderkey"], merge_filter="target.day >= date '1995-06-01'")


@query(f"""SELECT {_merged({})} {MERGED}""")
def write_merge_if_changed(spark: SparkSession, orders: DataFrame) -> DataFrame:
    return W.merged_if_changed(*both_sides(orders), ["o_orderkey"])


@query(f"""WITH s AS (SELECT * FROM ({SOURCE}) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1)
SELECT * FROM ({TARGET}) t WHERE t.o_custkey NOT IN (SELECT o_custkey FROM s) UNION ALL SELECT * FROM s""")
def write_logical_merge(spark: SparkSession, orders: DataFrame) -> DataFrame:
    return W.logically_merged(*both_sides(orders), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")])


# histories (slowly changing dimensions)

FIRST = "SELECT c_custkey AS id, c_mktsegment AS status, TIMESTAMP '2022-01-01' + to_days(CAST(c_custkey % 20 AS INT)) AS updated_at FROM customer WHERE c_custkey % 13 <> 0"
SECOND = """SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'MOVED' ELSE c_mktsegment END AS status,
  TIMESTAMP '2022-01-01' + to_days(CAST(c_custkey % 20 + CASE WHEN c_custkey % 7 = 0 THEN 100 ELSE 0 END AS INT)) AS updated_at FROM customer WHERE c_custkey % 11 <> 0"""
THIRD = SECOND.replace(" WHERE c_custkey % 11 <> 0", "").replace("% 7 = 0", "% 5 = 0").replace("THEN 100", "THEN 200")
NOW1, NOW2, NOW3 = datetime(2022, 3, 1), datetime(2022, 6, 1), datetime(2022, 9, 1)


def snapshots(customer: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    def made(where: str, every: int, days: int) -> DataFrame:
        moved = F.col("c_custkey") % every == 0 if every else F.lit(False)
        at = F.lit(datetime(2022, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval((F.col("c_custkey") % 20 + F.when(moved, days).otherwise(0)).cast("int"))
        return customer.where(where).select(F.col("c_custkey").alias("id"), F.when(moved, "MOVED").otherwise(F.col("c_mktsegment")).alias("status"), at.alias("updated_at"))

    return made("c_custkey % 13 <> 0", 0, 0), made("c_custkey % 11 <> 0", 7, 100), made("true", 5, 200)


T1 = f"SELECT id, status, updated_at, TIMESTAMP '1970-01-01' AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to FROM ({FIRST})"


def time_step(target: str, source: str, now: datetime, hard: bool = True, fresh: str = "TIMESTAMP '1970-01-01'") -> str:
    gone = f"WHEN s.id IS NULL THEN TIMESTAMP '{now}'" if hard else ""
    return f"""(WITH t AS ({target}), s AS ({source}), live AS (SELECT * FROM t WHERE valid_to IS NULL),
ended AS (SELECT id, max(valid_to) AS ended FROM t WHERE valid_to IS NOT NULL GROUP BY id)
SELECT * FROM t WHERE valid_to IS NOT NULL
UNION ALL SELECT coalesce(l.id, s.id), coalesce(l.status, s.status), coalesce(l.updated_at, s.updated_at),
  CASE WHEN l.id IS NOT NULL THEN l.valid_from WHEN e.ended IS NULL THEN {fresh} WHEN e.ended > s.updated_at THEN e.ended ELSE s.updated_at END,
  CASE WHEN l.id IS NULL THEN NULL WHEN s.updated_at > l.updated_at THEN s.updated_at {gone} END
FROM live l FULL JOIN s ON l.id = s.id LEFT JOIN ended e ON e.id = s.id
UNION ALL SELECT s.id, s.status, s.updated_at, s.updated_at, NULL FROM live l JOIN s ON l.id = s.id WHERE s.updated_at > l.updated_at)"""


T2 = time_step(T1, SECOND, NOW2)
BY_TIME = W.History(keys=["id"], updated_at="updated_at")


@query(T1)
def history_time_first(spark: SparkSession, customer: DataFrame) -> DataFrame:
    return W.historized(None, snapshots(customer)[0], BY_TIME, NOW1, first_load=True)


@query(T2)
def history_time_second(spark: SparkSession, customer: DataFrame) -> DataFrame:
    one, two, _ = snapshots(customer)
    return W.historized(W.historized(None, one, BY_TIME, NOW1, True), two, BY_TIME, NOW2)


@query(time_step(T1, SECOND, NOW2, hard=False))
def history_time_keep_deleted(spark: SparkSession, customer: DataFrame) -> DataFrame:
    one, two, _ = snapshots(customer)
    soft = W.History(keys=["id"], updated_at="updated_at", invalidate_hard_deletes=False)
    return W.historized(W.historized(None, one, soft, NOW1, True), two, soft, NOW2)


@query(time_step(T2, THIRD, NOW3))
def history_time_undelete(spark: SparkSession, customer: DataFrame) -> DataFrame:
    one, two, three = snapshots(customer)
    return W.historized(W.historized(W.historized(None, one, BY_TIME, NOW1, True), two, BY_TIME, NOW2), three, BY_TIME, NOW3)


@query(time_step(T1.replace("TIMESTAMP '1970-01-01'", "updated_at"), SECOND, NOW2, fresh="s.updated_at"))
def history_updated_at_as_valid_from(spark: SparkSession, customer: DataFrame) -> DataFrame:
    one, two, _ = snapshots(customer)
    kind = W.History(keys=["id"], updated_at="updated_at", updated_at_as_valid_from=True)
    return W.historized(W.historized(None, one, kind, NOW1, True), two, kind, NOW2)


def column_step(target: str, source: str, now: datetime, hard: bool = True) -> str:
    gone = "OR s.id IS NULL" if hard else ""
    return f"""(WITH t AS ({target}), s AS ({source}), live AS (SELECT * FROM t WHERE valid_to IS NULL)
SELECT * FROM t WHERE valid_to IS NOT NULL
UNION ALL SELECT coalesce(l.id, s.id), coalesce(l.status, s.status), CASE WHEN l.id IS NULL THEN TIMESTAMP '{now}' ELSE l.valid_from END,
  CASE WHEN l.id IS NOT NULL AND (s.id IS NOT NULL AND s.status IS DISTINCT FROM l.status {gone}) THEN TIMESTAMP '{now}' END
FROM live l FULL JOIN s ON l.id = s.id
UNION ALL SELECT s.id, s.status, TIMESTAMP '{now}', NULL FROM live l JOIN s ON l.id = s.id WHERE s.status IS DISTINCT FROM l.status)"""


C1 = f"SELECT id, status, TIMESTAMP '1970-01-01' AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to FROM ({FIRST})"
BY_COLUMN = W.History(keys=["id"], columns=["status"])


def statuses(customer: DataFrame) -> list[DataFrame]:
    return [s.select("id", "status") for s in snapshots(customer)]


@query(C1)
def history_column_first(spark: SparkSession, customer: DataFrame) -> DataFrame:
    return W.historized(None, statuses(customer)[0], BY_COLUMN, NOW1, True)


@query(column_step(C1, f"SELECT id, status FROM ({SECOND})", NOW2))
def history_column_second(spark: SparkSession, customer: DataFrame) -> DataFrame:
    one, two, _ = statuses(customer)
    return W.historized(W.historized(None, one, BY_COLUMN, NOW1, True), two, BY_COLUMN, NOW2)


@query(column_step(C1.replace("1970-01-01", str(NOW1)), f"SELECT id, status FROM ({SECOND})", NOW2, hard=False))
def history_column_star_execution_time(spark: SparkSession, customer: DataFrame) -> DataFrame:
    one, two, _ = statuses(customer)
    kind = W.History(keys=["id"], columns="*", execution_time_as_valid_from=True, invalidate_hard_deletes=False)
    return W.historized(W.historized(None, one, kind, NOW1, True), two, kind, NOW2)


@query(column_step(C1, f"SELECT id, status FROM ({SECOND})", NOW2))
def history_column_composite_key(spark: SparkSession, customer: DataFrame) -> DataFrame:
    one, two, _ = statuses(customer)
    kind = W.History(keys=[F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("id") % 2], columns=["status"])
    return W.historized(W.historized(None, one, kind, NOW1, True), two, kind, NOW2)


# audits


def audit(name: str, table: str, sql: str, suffix: str = "", derive: Sequence[str] = (), **arguments: Any) -> None:
    """Register audit_<name> on a table, or on columns derived from it (SQL of both engines), {t} in the SQL.

    A condition or criteria are given as SQL text.
    """
    key = f"audit_{name}{suffix}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = {k: F.expr(v) if k == "condition" else [F.expr(x) for x in v] if k == "criteria" else v for k, v in arguments.items()}
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        return A.Audit(name, given).violations(rows.selectExpr(*derive) if derive else rows)

    QUERIES[key], SQL[key] = run, sql.replace("{t}", f"(SELECT {', '.join(derive)} FROM {table})" if derive else table)


def cases(number: str, values: Sequence[str | None], name: str) -> str:
    """A column that takes the values in turn, by the remainder of a number: SQL of both engines."""
    whens = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values))
    return f"CASE {number} % {len(values)} {whens} END AS {name}"


audit("not_null", "orders", "SELECT * FROM {t} WHERE a IS NULL OR b IS NULL", derive=["o_orderkey", "nullif(o_custkey % 5, 0) AS a", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS b"], columns=["a", "b"])
audit("accepted_values", "orders", "SELECT * FROM orders WHERE o_orderstatus NOT IN ('F', 'O')", column="o_orderstatus", is_in=["F", "O"])
audit("not_accepted_values", "orders", "SELECT * FROM orders WHERE o_orderstatus IN ('P')", column="o_orderstatus", is_in=["P"])
audit("forall", "lineitem", "SELECT * FROM lineitem WHERE NOT (l_quantity < 49) OR NOT (l_tax < 0.08)", criteria=["l_quantity < 49", "l_tax < 0.08"])
audit("accepted_range", "lineitem", "SELECT * FROM lineitem WHERE l_discount < 0.01 OR l_discount > 0.09", column="l_discount", min_v=0.01, max_v=0.09)
audit("accepted_range", "lineitem", "SELECT * FROM lineitem WHERE l_quantity >= 50 AND l_returnflag = 'R'", "_exclusive", column="l_quantity", max_v=50, inclusive=False, condition="l_returnflag = 'R'")
audit("accepted_range", "nation", "SELECT * FROM nation", "_unbounded", column="n_regionkey")
audit("not_empty_string", "part", "SELECT * FROM {t} WHERE name = '' AND p_size > 10", derive=["p_partkey", "p_size", cases("p_partkey", ["", None, "x", " "], "name")], column="name", condition="p_size > 10")
UUIDS = ["123e4567-e89b-12d3-a456-426614174000", "123E4567-E89B-12D3-A456-426614174000", "123e4567-e89b-92d3-a456-426614174000", "123e4567-e89b-12d3-c456-426614174000", "123e4567e89b12d3a456426614174000", "x123e4567-e89b-12d3-a456-426614174000", None]
audit("valid_uuid", "customer", "SELECT * FROM {t} WHERE NOT regexp_matches(lower(u), '^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$')", derive=["c_custkey", cases("c_custkey", UUIDS, "u")], column="u")
URLS = ["http://example.com/a?b=c", "https://x", "ftp://host/p", "HTTP://example.com", "gopher://x.y", "http://a b", "http://?x", "example.com", "", None]
audit("valid_url", "customer", r"SELECT * FROM {t} WHERE NOT regexp_matches(u, '^(https?|ftp)://[^\s/$.?#].[^\s]*$')", derive=["c_custkey", cases("c_custkey", URLS, "u")], column="u")
audit("valid_http_method", "customer", "SELECT * FROM {t} WHERE m NOT IN ('GET', 'POST', 'PUT', 'DELETE', 'PATCH', 'HEAD', 'OPTIONS', 'TRACE', 'CONNECT')", derive=["c_custkey", cases("c_custkey", ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "TRACE", "CONNECT", "get", "FETCH", "", None], "m")], column="m")
EMAILS = ["a.b+c@d-e.org", "x_y@z.co.uk", "x@y", "@z.com", "a b@c.de", "a@b@c.de", "A-1@B.C-", None]
audit("valid_email", "customer", r"SELECT * FROM {t} WHERE NOT regexp_matches(m, '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$')", derive=["c_custkey", cases("c_custkey", EMAILS, "m")], column="m")
audit("match_regex_pattern_list", "part", "SELECT * FROM part WHERE NOT regexp_matches(p_type, '^S') AND NOT regexp_matches(p_type, 'S$')", column="p_type", patterns=["^S", "S$"])
audit("match_regex_pattern_list", "customer", r"SELECT * FROM {t} WHERE (NOT regexp_matches(a, '^\d.*') AND NOT regexp_matches(a, '.*!$')) AND c_nationkey > 3", "_digits", derive=["c_custkey", "c_nationkey", cases("c_custkey", ["1x", "x!", "2!", "xy", "!", "", None], "a")], column="a", patterns=[r"^\d.*", ".*!$"], condition="c_nationkey > 3")
audit("not_match_regex_pattern_list", "part", "SELECT * FROM part WHERE regexp_matches(p_brand, '5$') OR regexp_matches(p_type, '^SMALL')", column="p_brand", patterns=["5$", "#1"])
SQL["audit_not_match_regex_pattern_list"] = "SELECT * FROM part WHERE regexp_matches(p_brand, '5$') OR regexp_matches(p_brand, '#1')"
audit("match_like_pattern_list", "part", "SELECT * FROM part WHERE p_type NOT LIKE 'S%' AND p_type NOT LIKE '%S'", column="p_type", patterns=["S%", "%S"])
audit("match_like_pattern_list", "customer", "SELECT * FROM {t} WHERE a NOT LIKE 'jim%' AND a NOT LIKE 'pam%'", "_names", derive=["c_custkey", cases("c_custkey", ["jim", "pamela", "tim", "Jim", "", None], "a")], column="a", patterns=["jim%", "pam%"])
audit("not_match_like_pattern_list", "part", "SELECT * FROM part WHERE p_type LIKE '%STEEL' OR p_type LIKE 'SMALL%'", column="p_type", patterns=["%STEEL", "SMALL%"])
audit("string_length_between", "part", "SELECT * FROM part WHERE length(p_name) < 6 OR length(p_name) > 9", column="p_name", min_v=6, max_v=9)
audit("string_length_equal", "part", "SELECT * FROM part WHERE length(p_brand) <> 8", column="p_brand", v=8)
audit("unique_values", "customer", """SELECT * FROM (SELECT row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_mktsegment) AS rank_c_mktsegment FROM customer) WHERE rank_c_mktsegment > 1""", columns=["c_mktsegment"])
audit("unique_combination_of_columns", "lineitem", "SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1", columns=["l_returnflag", "l_linestatus", "l_linenumber"])
audit("number_of_rows", "region", "SELECT count(*) AS n_rows FROM region HAVING count(*) <= 10", threshold=10)
audit("at_least_one", "orders", "SELECT count(*) AS n_rows, count(v) AS n_values FROM {t} WHERE o_orderstatus = 'O' HAVING count(*) > 0 AND count(v) = 0", derive=["o_orderstatus", "CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS v"], column="v", condition="o_orderstatus = 'O'")
audit("at_least_one", "orders", "SELECT count(*) AS n_rows, count(v) AS n_values FROM {t} HAVING count(*) > 0 AND count(v) = 0", "_passes", derive=["o_orderstatus", "CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS v"], column="v")
audit("not_constant", "orders", "SELECT count(DISTINCT o_orderstatus) AS n_values FROM orders WHERE o_orderstatus = 'F' HAVING count(DISTINCT o_orderstatus) <= 1", column="o_orderstatus", condition="o_orderstatus = 'F'")
audit("not_null_proportion", "customer", "SELECT count(*) AS n_rows, count(c_acctbal) AS n_values FROM customer HAVING count(c_acctbal) <= count(*) * 1.0", column="c_acctbal", threshold=1.0)
audit("sequential_values", "orders", "SELECT * FROM (SELECT o_custkey, lag(o_custkey) OVER (ORDER BY o_custkey) AS prv FROM orders) WHERE NOT (o_custkey = prv + 1)", column="o_custkey")
audit("unique_values", "orders", """SELECT rank_o_custkey, rank_o_orderkey FROM (SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_custkey) AS rank_o_custkey,
  row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderkey) AS rank_o_orderkey FROM orders) WHERE rank_o_custkey > 1 OR rank_o_orderkey > 1""", "_of_two_columns", columns=["o_custkey", "o_orderkey"])
audit("mutually_exclusive_ranges", "orders", """
WITH w AS (SELECT lo AS lower_bound, hi AS upper_bound, lead(lo) OVER (ORDER BY lo, hi) AS next_lower_bound,
  row_number() OVER (ORDER BY lo DESC, hi DESC) = 1 AS is_last_record FROM {t} WHERE o_orderkey > 50),
c AS (SELECT *, coalesce(lower_bound <= upper_bound, false) AS lower_bound_lte_upper_bound, coalesce(upper_bound <= next_lower_bound, is_last_record, false) AS upper_bound_lte_next_lower_bound FROM w)
SELECT * FROM c WHERE NOT (lower_bound_lte_upper_bound AND upper_bound_lte_next_lower_bound)""", derive=["o_orderkey", "o_orderkey * 10 AS lo", "o_orderkey * 10 + o_custkey % 60 - 5 AS hi"], lower_bound_column="lo", upper_bound_column="hi", condition="o_orderkey > 50")
RANGES = """
WITH r AS (SELECT l_suppkey, l_orderkey AS lo, l_orderkey + CAST(l_quantity AS BIGINT) * 20 AS hi FROM lineitem),
w AS (SELECT lo AS lower_bound, hi AS upper_bound, lead(lo) OVER (PARTITION BY l_suppkey ORDER BY lo, hi) AS next_lower_bound,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY lo DESC, hi DESC) = 1 AS is_last_record FROM r),
c AS (SELECT *, coalesce(lower_bound <= upper_bound, false) AS lower_bound_lte_upper_bound, coalesce(upper_bound <= next_lower_bound, is_last_record, false) AS upper_bound_lte_next_lower_bound FROM w)
SELECT * FROM c WHERE NOT (lower_bound_lte_upper_bound AND upper_bound_lte_next_lower_bound)"""


@query(RANGES)
def audit_mutually_exclusive_ranges_partitioned(spark: SparkSession, lineitem: DataFrame) -> DataFrame:
    rows = lineitem.select("l_suppkey", F.col("l_orderkey").alias("lo"), (F.col("l_orderkey") + F.col("l_quantity").cast("bigint") * 20).alias("hi"))
    return A.mutually_exclusive_ranges(rows, "lo", "hi", ["l_suppkey"])


@query(RANGES.replace("PARTITION BY l_suppkey ", ""))
def audit_mutually_exclusive_ranges_global(spark: SparkSession, lineitem: DataFrame) -> DataFrame:
    rows = lineitem.select(F.col("l_orderkey").alias("lo"), (F.col("l_orderkey") + F.col("l_quantity").cast("bigint") * 20).alias("hi"))
    return A.mutually_exclusive_ranges(rows, "lo", "hi")


@query("""WITH s AS (SELECT avg(c_acctbal) AS m, stddev(c_acctbal) AS d FROM customer)
SELECT c_acctbal, round((c_acctbal - m) / nullif(d, 0), 6) AS z_score FROM customer, s WHERE abs((c_acctbal - m) / nullif(d, 0)) > 1.5""")
def audit_z_score(spark: SparkSession, customer: DataFrame) -> DataFrame:
    return A.z_score(customer, "c_acctbal", 1.5).withColumn("z_score", F.round("z_score", 6))


@query("SELECT round(stddev(c_acctbal), 6) AS stddev_c_acctbal FROM customer HAVING stddev(c_acctbal) > 10")
def audit_stddev_in_range(spark: SparkSession, customer: DataFrame) -> DataFrame:
    return A.stddev_in_range(customer, "c_acctbal", max_v=10).withColumn("stddev_c_acctbal", F.round("stddev_c_acctbal", 6))


@query("SELECT round(avg(l_quantity), 6) AS mean_l_quantity FROM lineitem HAVING avg(l_quantity) <= 100 OR avg(l_quantity) >= 200")
def audit_mean_in_range(spark: SparkSession, lineitem: DataFrame) -> DataFrame:
    return A.mean_in_range(lineitem, "l_quantity", 100, 200, inclusive=False).withColumn("mean_l_quantity", F.round("mean_l_quantity", 6))


@query("""WITH r AS (SELECT c_nationkey AS a, c_custkey % 25 AS b FROM customer), n AS (SELECT count(*) AS n FROM r),
p AS (SELECT a AS value, count(*) / (SELECT n FROM n) AS p FROM r GROUP BY 1), q AS (SELECT b AS value, count(*) / (SELECT n FROM n) AS q FROM r GROUP BY 1)
SELECT CAST(p.value AS BIGINT) AS value, round(p * ln(p / q) + q * ln(q / p), 9) AS kl_divergence FROM p JOIN q ON p.value = q.value WHERE p * ln(p / q) + q * ln(q / p) > 0.0001""")
def audit_kl_divergence(spark: SparkSession, customer: DataFrame) -> DataFrame:
    rows = customer.select(F.col("c_nationkey").cast("bigint").alias("a"), (F.col("c_custkey") % 25).alias("b"))
    return A.kl_divergence(rows, "a", "b", 0.0001).withColumn("kl_divergence", F.round("kl_divergence", 9))


CHI = """WITH s AS (SELECT o_orderstatus AS a, o_orderpriority AS b FROM orders), c AS (SELECT a, b, count(*) AS observed FROM s GROUP BY 1, 2),
e AS (SELECT *, sum(observed) OVER (PARTITION BY a) * sum(observed) OVER (PARTITION BY b) / sum(observed) OVER () AS expected FROM c)
SELECT (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS degrees_of_freedom, round(CAST(sum((observed - expected) * (observed - expected) / expected) AS DOUBLE), 6) AS chi_square FROM e"""


@query(f"SELECT * FROM ({CHI}) WHERE NOT chi_square > 1000000")
def audit_chi_square(spark: SparkSession, orders: DataFrame) -> DataFrame:
    return A.chi_square(orders, "o_orderstatus", "o_orderpriority", 1000000.0).withColumn("chi_square", F.round("chi_square", 6))


@query(f"SELECT * FROM ({CHI}) WHERE NOT chi_square <= 0.001")
def audit_chi_square_independent(spark: SparkSession, orders: DataFrame) -> DataFrame:
    return A.chi_square(orders, "o_orderstatus", "o_orderpriority", 0.001, dependent=False).withColumn("chi_square", F.round("chi_square", 6))


@query("SELECT * FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def audit_relationship(spark: SparkSession, lineitem: DataFrame, part: DataFrame) -> DataFrame:
    return A.relationship(lineitem, "l_partkey", part.where("p_size > 5"), "p_partkey")


@query("""SELECT coalesce(a.k, b.k) AS value, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a
FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def audit_cardinality_equality(spark: SparkSession, customer: DataFrame, supplier: DataFrame) -> DataFrame:
    return A.cardinality_equality(customer, "c_nationkey", supplier, "s_nationkey")


@query("SELECT *, 'right' AS side FROM nation WHERE n_regionkey = 3")
def audit_equality(spark: SparkSession, nation: DataFrame) -> DataFrame:
    return A.equality(nation.where("n_regionkey <> 3"), nation)


@query("SELECT (SELECT count(*) FROM region) AS n_left, (SELECT count(*) FROM nation) AS n_right")
def audit_equal_row_count(spark: SparkSession, region: DataFrame, nation: DataFrame) -> DataFrame:
    return A.equal_row_count(region, nation)


@query("SELECT (SELECT count(*) FROM nation) AS n_left, (SELECT count(*) FROM region) AS n_right")
def audit_fewer_rows_than(spark: SparkSession, region: DataFrame, nation: DataFrame) -> DataFrame:
    return A.fewer_rows_than(nation, region)


@query("""SELECT unnest(['not_null', 'accepted_values', 'accepted_range']) AS audit, unnest([(SELECT count(*) FROM orders WHERE o_custkey IS NULL),
(SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')), (SELECT count(*) FROM orders WHERE o_totalprice < 1000 OR o_totalprice > 300000)]) AS violations""")
def audit_many_in_one_pass(spark: SparkSession, orders: DataFrame) -> DataFrame:
    """Several audits of one table, counted in one aggregation."""
    wanted = [A.Audit("not_null", {"columns": ["o_custkey"]}), A.Audit("accepted_values", {"column": "o_orderstatus", "is_in": ["F", "O"]}), A.Audit("accepted_range_non_blocking", {"column": "o_totalprice", "min_v": 1000, "max_v": 300000})]
    return S.typed_values(spark, [(o.audit.base, o.count) for o in A.failures(orders, wanted)], "audit string, violations bigint")


# table diff


def edited(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = order_rows(orders)
    other = rows.where("o_orderkey % 17 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return rows.where("o_orderkey % 19 <> 0"), other


LEFT = f"SELECT * FROM ({ORDER_ROWS}) WHERE o_orderkey % 19 <> 0"
RIGHT = f"SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, day FROM ({ORDER_ROWS}) WHERE o_orderkey % 17 <> 0"
PAIRS = f"FROM ({LEFT}) s FULL JOIN ({RIGHT}) t ON s.o_orderkey = t.o_orderkey"


@query(f"""WITH c AS (SELECT count(s.o_orderkey) AS s_count, count(t.o_orderkey) AS t_count, count(CASE WHEN s.o_orderkey = t.o_orderkey THEN 1 END) AS join_count, CAST(0 AS BIGINT) AS null_grain_count,
  count(CASE WHEN s.o_orderkey = t.o_orderkey AND s.o_totalprice = t.o_totalprice THEN 1 END) AS full_match_count, count(DISTINCT s.o_orderkey) AS distinct_count_s, count(DISTINCT t.o_orderkey) AS distinct_count_t {PAIRS})
SELECT *, s_count - join_count AS s_only_count, t_count - join_count AS t_only_count, join_count - full_match_count AS partial_match_count, round(full_match_count * 200.0 / (s_count + t_count), 2) AS full_match_pct,
  round((join_count - full_match_count) * 200.0 / (s_count + t_count), 2) AS partial_match_pct, round((s_count - join_count) * 100.0 / (s_count + t_count), 2) AS s_only_pct, round((t_count - join_count) * 100.0 / (s_count + t_count), 2) AS t_only_pct FROM c""")
def row_diff_stats(spark: SparkSession, orders: DataFrame) -> DataFrame:
    return D.RowDiff(*edited(orders), ["o_orderkey"]).summary()


@query(f"""WITH j AS (SELECT s.o_custkey = t.o_custkey AS a, s.o_orderstatus = t.o_orderstatus AS b, s.o_totalprice = t.o_totalprice AS c, s.day = t.day AS d FROM ({LEFT}) s JOIN ({RIGHT}) t ON s.o_orderkey = t.o_orderkey)
SELECT unnest(['o_custkey', 'o_orderstatus', 'o_totalprice', 'day']) AS column_name, unnest([round(sum(a::INT) * 100.0 / count(*), 9), round(sum(b::INT) * 100.0 / count(*), 9), round(sum(c::INT) * 100.0 / count(*), 9), round(sum(d::INT) * 100.0 / count(*), 9)]) AS pct_match FROM j""")
def row_diff_column_stats(spark: SparkSession, orders: DataFrame) -> DataFrame:
    return D.RowDiff(*edited(orders), ["o_orderkey"]).column_stats()


@query(f"""WITH p AS (SELECT s.o_orderkey AS sk, t.o_orderkey AS tk, s.o_orderstatus AS a, t.o_orderstatus AS b, s.o_totalprice = t.o_totalprice AS same {PAIRS})
SELECT 'source_only' AS side, CAST(sk AS VARCHAR) AS key, a AS s__o_orderstatus, b AS t__o_orderstatus FROM (SELECT * FROM p WHERE tk IS NULL ORDER BY sk LIMIT 20)
UNION ALL SELECT 'target_only', CAST(tk AS VARCHAR), a, b FROM (SELECT * FROM p WHERE sk IS NULL ORDER BY tk LIMIT 20)
UNION ALL SELECT 'common', CAST(sk AS VARCHAR), a, b FROM (SELECT * FROM p WHERE NOT same ORDER BY sk LIMIT 20)""")
def row_diff_samples(spark: SparkSession, orders: DataFrame) -> DataFrame:
    return D.RowDiff(*edited(orders), ["o_orderkey"]).samples().select("side", "key", "s__o_orderstatus", "t__o_orderstatus")


@query(f"""WITH j AS (SELECT s.o_orderkey AS sk, t.o_orderkey AS tk, s.o_totalprice = t.o_totalprice AS same FROM ({LEFT}) s FULL JOIN ({RIGHT}) t ON s.o_orderkey = t.o_orderkey AND s.day = t.day AND t.o_custkey % 2 = 0)
SELECT count(sk) AS s_count, count(tk) AS t_count, count(CASE WHEN sk = tk THEN 1 END) AS join_count, count(CASE WHEN sk = tk AND same THEN 1 END) AS full_match_count, count(DISTINCT sk) AS distinct_count_s FROM j""")
def row_diff_condition(spark: SparkSession, orders: DataFrame) -> DataFrame:
    """Tables joined by a condition other than equal keys."""
    counts = D.RowDiff(*edited(orders), ["o_orderkey"], on="s.o_orderkey = t.o_orderkey AND s.day = t.day AND t.o_custkey % 2 = 0").summary()
    return counts.select("s_count", "t_count", "join_count", "full_match_count", "distinct_count_s")


@query("SELECT 7 AS s_count, 10 AS t_count, 7 AS join_count, 4 AS null_grain_count, 7 AS full_match_count, 3 AS t_only_count, 7 AS distinct_count_s, 10 AS distinct_count_t")
def row_diff_null_keys(spark: SparkSession) -> DataFrame:
    """Composite keys with nulls: their texts meet."""
    rows = [(1, 1, 1), (7, 4, 2), (None, 3, 3), (None, None, 3), (1, 2, 4), (7, 3, 5), (None, 2, 6)]
    more = [*rows, (1, None, 7), (8, 8, 8), (9, 9, 9)]
    frames = [S.typed_values(spark, r, "key_1 int, key_2 int, value int") for r in (rows, more)]
    counts = D.RowDiff(*frames, ["key_1", "key_2"]).summary()
    return counts.select(*[F.col(c).cast("int").alias(c) for c in ("s_count", "t_count", "join_count", "null_grain_count", "full_match_count", "t_only_count", "distinct_count_s", "distinct_count_t")])


@query("SELECT decimals, 5 - decimals AS full_match_count FROM (SELECT unnest([1, 2, 3, 4]) AS decimals)")
def row_diff_decimals(spark: SparkSession) -> DataFrame:
    """Fractions compared at so many places: rows differ at the first to the fifth."""
    from functools import reduce

    left = S.typed_values(spark, [(i, 33.0) for i in range(1, 6)], "key int, value double")
    right = S.typed_values(spark, [(i, 33.0 + 2 * 10.0**-i) for i in range(1, 6)], "key int, value double")
    found = [D.RowDiff(left, right, ["key"], decimals=d).summary().select(F.lit(d).alias("decimals"), F.col("full_match_count").cast("int").alias("full_match_count")) for d in (1, 2, 3, 4)]
    return reduce(DataFrame.unionByName, found)


@query("""SELECT * FROM (VALUES ('added_on', 'added', NULL, 'date'), ('o_orderpriority', 'removed', 'string', NULL), ('o_custkey', 'modified', 'bigint', 'int')) v("column", change, source_type, target_type)""")
def schema_diff(spark: SparkSession, orders: DataFrame) -> DataFrame:
    other = orders.drop("o_orderpriority").withColumns({"o_custkey": F.col("o_custkey").cast("int"), "added_on": F.current_date()})
    return S.typed_values(spark, D.schema_diff(orders.schema, other.schema).rows(), "column string, change string, source_type string, target_type string")


@query("""SELECT r_regionkey, r_name, 'missing' AS side FROM region WHERE r_regionkey = 0 UNION ALL SELECT r_regionkey, r_name, 'unexpected' FROM region WHERE r_regionkey = 1""")
def model_test_multiset_diff(spark: SparkSession, region: DataFrame) -> DataFrame:
    return D.multiset_diff(region, region.where("r_regionkey <> 0").unionByName(region.where("r_regionkey = 1")))


# metrics


def semantic(orders: DataFrame, lineitem: DataFrame, customer: DataFrame, nation: DataFrame) -> SemanticModel:
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    items = lineitem.join(orders.select("o_orderkey", F.col("o_custkey").alias("buyer")), F.col("l_orderkey") == F.col("o_orderkey"))
    model = SemanticModel({"orders": orders, "items": items, "customer": customer, "nation": nation}, [
        Reference("orders", "customer", "o_custkey"), Reference("items", "customer", "buyer"), Reference("customer", "customer", "c_custkey", unique=True),
        Reference("customer", "nation", "c_nationkey"), Reference("nation", "nation", "n_nationkey", unique=True),
    ])
    return model.add(
        Metric("order_value", "orders", lambda: money("o_totalprice")),
        Metric("n_orders", "orders", lambda: F.count("o_orderkey")),
        Metric("quantity", "items", lambda: money("l_quantity")),
        Metric("per_order", formula=lambda m: F.round(m["order_value"] / m["n_orders"], 4), inputs=["order_value", "n_orders"]),
        Metric("items_per_order", formula=lambda m: F.round(m["quantity"] / m["n_orders"], 4), inputs=["quantity", "n_orders"]),
    )


@query("SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS order_value, count(o_orderkey) AS n_orders FROM orders GROUP BY 1")
def metric_simple(spark: SparkSession, orders: DataFrame, lineitem: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    return semantic(orders, lineitem, customer, nation).query(["order_value", "n_orders"], ["o_orderstatus"])


@query("""SELECT n_name, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS order_value FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus = 'O' GROUP BY 1""")
def metric_dim_join(spark: SparkSession, orders: DataFrame, lineitem: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    return semantic(orders, lineitem, customer, nation).query(["order_value"], ["n_name"], where="o_orderstatus = 'O'")


@query("SELECT o_orderpriority, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_orderkey), 4) AS per_order FROM orders GROUP BY 1")
def metric_derived_ratio(spark: SparkSession, orders: DataFrame, lineitem: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    return semantic(orders, lineitem, customer, nation).query(["per_order"], ["o_orderpriority"])


@query("""WITH o AS (SELECT c_mktsegment, count(o_orderkey) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1),
i AS (SELECT c_mktsegment, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT coalesce(o.c_mktsegment, i.c_mktsegment) AS c_mktsegment, round(q / n, 4) AS items_per_order, n AS n_orders FROM o FULL JOIN i ON o.c_mktsegment = i.c_mktsegment""")
def metric_two_sources_full_join(spark: SparkSession, orders: DataFrame, lineitem: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    return semantic(orders, lineitem, customer, nation).query(["items_per_order", "n_orders"], ["c_mktsegment"])


# intervals

SPANS = "SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) + 86400 * (1 + event_id % 5) AS \"end\" FROM events"


def spans(events: DataFrame) -> DataFrame:
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return events.select("user_id", at.alias("start"), (at + 86400 * (1 + F.col("event_id") % 5)).alias("end"))


@query(f"""WITH o AS (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens FROM ({SPANS})),
g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY start, "end") AS island FROM o) SELECT user_id, min(start) AS start, max("end") AS "end" FROM g GROUP BY user_id, island""")
def islands_merge(spark: SparkSession, events: DataFrame) -> DataFrame:
    return I.islands(spans(events), ["user_id"])


DAYS = "SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1996-12-31', INTERVAL 1 DAY)) AS DATE) AS day"
LOADED = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 29 = 0"


def loaded_days(spark: SparkSession, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    whole = S.typed_values(spark, [("1995-01-01", "1997-01-01")], "start string, end string").select(F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    return I.grid(whole, "start", "end", "1 DAY", "day"), orders.where("o_orderkey % 29 = 0").select(F.to_date("o_orderdate").alias("day"))


@query(f"SELECT day FROM ({DAYS}) WHERE day NOT IN (SELECT day FROM ({LOADED}))")
def missing_days(spark: SparkSession, orders: DataFrame) -> DataFrame:
    return I.missing(*loaded_days(spark, orders), ["day"])


@query(f"WITH d AS ({DAYS}), m AS (SELECT day FROM d WHERE day NOT IN (SELECT day FROM ({LOADED}))) SELECT day FROM d WHERE EXISTS (SELECT 1 FROM m WHERE m.day BETWEEN d.day AND d.day + 2)")
def missing_with_lookback(spark: SparkSession, orders: DataFrame) -> DataFrame:
    return I.missing_with_lookback(*loaded_days(spark, orders), "day", 2)


DAY_SPANS = 'SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS start, CAST(floor(epoch(ts) / 86400) AS BIGINT) + 1 + event_id % {n} AS "end" FROM events WHERE event_id % 2 = {side}'


@query(f"""WITH days AS (SELECT user_id, unnest(range(start, "end")) AS day FROM ({DAY_SPANS.format(n=5, side=0)})
  EXCEPT SELECT user_id, unnest(range(start, "end")) FROM ({DAY_SPANS.format(n=2, side=1)})),
runs AS (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS run FROM days)
SELECT user_id, min(day) AS start, max(day) + 1 AS "end" FROM runs GROUP BY user_id, run""")
def interval_subtract(spark: SparkSession, events: DataFrame) -> DataFrame:
    """What of each user's intervals (of even events) those of odd events leave."""
    day = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400)

    def side(n: int, which: int) -> DataFrame:
        return events.where(F.col("event_id") % 2 == which).select("user_id", day.alias("start"), (day + 1 + F.col("event_id") % n).alias("end"))

    return I.subtracted(side(5, 0), side(2, 1), ["user_id"])
