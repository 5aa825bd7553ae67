"""Data-quality audits: each takes a frame and returns the rows (or a row) that violate it.

Conditions with a null outcome are no violation, as in SQL. `condition` restricts the audited rows. Audits that only
filter can be counted together in one pass over the table, see failures().
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmodel.functions.columns import all_of, any_of

#: Patterns and verbs that decide what is valid: fixed values.
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
URL = r"^(https?|ftp)://[^\s/$.?#].[^\s]*$"
EMAIL = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
HTTP_METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "TRACE", "CONNECT")

#: Copies of a row that one task makes; salts that a hot value is dealt by; rows of a range of an order over a whole
#: table, rows looked at for each range, and ranges at most.
COPIES, SALTS = 100_000, 64
RANGE_ROWS, RANGE_SAMPLE, RANGES = 1_000_000, 50, 4_096

Condition = Column | None
PREDICATES: dict[str, Callable[..., Column]] = {}
AUDITS: dict[str, Callable[..., DataFrame]] = {}


def predicate(make: Callable[..., Column]) -> Callable[..., DataFrame]:
    """Register an audit that is a filter: make(...) is true for a violating row."""
    name = make.__name__

    def audit(df: DataFrame, *args: Any, condition: Condition = None, **kwargs: Any) -> DataFrame:
        return df.where(all_of(make(*args, **kwargs), condition))

    audit.__name__, audit.__doc__ = name, make.__doc__
    PREDICATES[name] = make
    AUDITS[name] = audit
    return audit


def query(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Register an audit that aggregates, ranks or joins."""
    AUDITS[make.__name__] = make
    return make


def scoped(df: DataFrame, condition: Condition) -> DataFrame:
    return df if condition is None else df.where(condition)


def outside(value: Column, low: Any, high: Any, inclusive: bool) -> Column:
    """Beyond the bounds that are given; without bounds every value is."""
    below = None if low is None else (value < low if inclusive else value <= low)
    above = None if high is None else (value > high if inclusive else value >= high)
    return any_of(below, above)


@predicate
def not_null(columns: Sequence[str]) -> Column:
    """Rows with a null in any of the columns."""
    return any_of(*[F.col(c).isNull() for c in columns])


@predicate
def accepted_values(column: str, is_in: Sequence[Any]) -> Column:
    """Rows whose value is none of those accepted."""
    return ~F.col(column).isin(list(is_in))


@predicate
def not_accepted_values(column: str, is_in: Sequence[Any]) -> Column:
    """Rows whose value is one of those refused."""
    return F.col(column).isin(list(is_in))


@predicate
def forall(criteria: Sequence[Column]) -> Column:
    """Rows for which some criterion is false."""
    return any_of(*[~c for c in criteria])


@predicate
def accepted_range(column: str, min_v: Any = None, max_v: Any = None, inclusive: bool = True) -> Column:
    """Rows whose value lies outside the range."""
    return outside(F.col(column), min_v, max_v, inclusive)


@predicate
def not_empty_string(column: str) -> Column:
    """Rows with an empty text."""
    return F.col(column) == ""


@predicate
def valid_uuid(column: str) -> Column:
    """Rows whose value is no UUID of version 1 to 5."""
    return ~F.lower(column).rlike(UUID)


@predicate
def valid_url(column: str) -> Column:
    """Rows whose value is no URL."""
    return ~F.col(column).rlike(URL)


@predicate
def valid_http_method(column: str) -> Column:
    """Rows whose value is no HTTP method."""
    return ~F.col(column).isin(*HTTP_METHODS)


@predicate
def valid_email(column: str) -> Column:
    """Rows whose value is no e-mail address."""
    return ~F.col(column).rlike(EMAIL)


@predicate
def match_regex_pattern_list(column: str, patterns: Sequence[str]) -> Column:
    """Rows that match none of the patterns."""
    return all_of(*[~F.col(column).rlike(p) for p in patterns])


@predicate
def not_match_regex_pattern_list(column: str, patterns: Sequence[str]) -> Column:
    """Rows that match one of the patterns."""
    return any_of(*[F.col(column).rlike(p) for p in patterns])


@predicate
def match_like_pattern_list(column: str, patterns: Sequence[str]) -> Column:
    """Rows that match none of the LIKE patterns."""
    return all_of(*[~F.col(column).like(p) for p in patterns])


@predicate
def not_match_like_pattern_list(column: str, patterns: Sequence[str]) -> Column:
    """Rows that match one of the LIKE patterns."""
    return any_of(*[F.col(column).like(p) for p in patterns])


@predicate
def string_length_between(column: str, min_v: int | None = None, max_v: int | None = None, inclusive: bool = True) -> Column:
    """Rows whose text is too short or too long."""
    return outside(F.length(column), min_v, max_v, inclusive)


@predicate
def string_length_equal(column: str, v: int) -> Column:
    """Rows whose text has another length."""
    return F.length(column) != v


def repeated(df: DataFrame, n: str, first: int = 1) -> DataFrame:
    """Each row once for every number from `first` to its value of `n`, with the number as __copy.

    The copies of a row are dealt over tasks, COPIES of them to a row of the exchange.
    """
    parts = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(n) - first) / COPIES))
    rows = df.where(F.col(n) >= first).withColumn("__deal", F.explode(parts))
    low = F.col("__deal") * COPIES + first
    rows = rows.withColumns({"__low": low, "__high": F.least(low + (COPIES - 1), F.col(n))}).repartition("__deal", *df.columns)
    return rows.withColumn("__copy", F.explode(F.sequence("__low", "__high"))).drop("__deal", "__low", "__high")


@query
def unique_values(df: DataFrame, columns: Sequence[str], condition: Condition = None) -> DataFrame:
    """For each column by itself the number of each repeat, as rank_<column>; rows with a repeat in any.

    Values are counted, and the repeats numbered from the counts. With several columns a row's numbers belong together:
    rows are numbered within a value and a salt from the whole row, to which the counts of the salts before are added.
    """
    rows = scoped(df, condition)
    if len(columns) == 1:
        counts = rows.groupBy(F.col(columns[0]).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
        return repeated(counts, "__n", 2).select(F.col("__copy").alias(f"rank_{columns[0]}"))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)]), F.lit(SALTS)))
    for c in columns:
        own = [F.col(f"`{c}`"), F.col("__salt")]
        counts = rows.groupBy(own[0].alias("__value"), own[1].alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
        before = F.sum("__n").over(Window.partitionBy("__value").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.select("__value", "__of", F.coalesce(before, F.lit(0)).alias("__before"))
        numbered = rows.withColumn("__own", F.row_number().over(Window.partitionBy(*own).orderBy(own[0])))
        same = numbered[f"`{c}`"].eqNullSafe(counts["__value"]) & (numbered["__salt"] == counts["__of"])
        rows = numbered.join(counts, same).withColumn(f"rank_{c}", F.col("__before") + F.col("__own")).drop("__value", "__of", "__before", "__own")
    return rows.select(*[f"rank_{c}" for c in columns]).where(any_of(*[F.col(f"rank_{c}") > 1 for c in columns]))


def repeats(df: DataFrame, columns: Sequence[str], condition: Condition = None) -> int | None:
    """The number of rows of unique_values, of a single column from its counts alone."""
    if len(columns) > 1:
        return None
    counts = scoped(df, condition).groupBy(columns[0]).agg(F.count(F.lit(1)).alias("__n"))
    return counts.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0))).first()[0]


@query
def unique_combination_of_columns(df: DataFrame, columns: Sequence[str], condition: Condition = None) -> DataFrame:
    """The combinations that occur more than once."""
    return scoped(df, condition).groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")


@query
def number_of_rows(df: DataFrame, threshold: int, condition: Condition = None) -> DataFrame:
    """One row if there are at most `threshold` rows; counting stops one row beyond."""
    return scoped(df, condition).select(F.lit(1).alias("__one")).limit(threshold + 1).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") <= threshold)


@query
def at_least_one(df: DataFrame, column: str, condition: Condition = None) -> DataFrame:
    """One row if the table has rows and the column is null in all."""
    counts = scoped(df, condition).agg(F.count(F.lit(1)).alias("n_rows"), F.count(column).alias("n_values"))
    return counts.where("n_rows > 0 AND n_values = 0")


@query
def not_constant(df: DataFrame, column: str, condition: Condition = None) -> DataFrame:
    """One row if the column has at most one different value."""
    return scoped(df, condition).agg(F.countDistinct(column).alias("n_values")).where("n_values <= 1")


@query
def not_null_proportion(df: DataFrame, column: str, threshold: float, condition: Condition = None) -> DataFrame:
    """One row if the share of values that are not null does not exceed the threshold."""
    counts = scoped(df, condition).agg(F.count(F.lit(1)).alias("n_rows"), F.count(column).alias("n_values"))
    return counts.where(F.col("n_values") <= F.col("n_rows") * F.lit(threshold))


@query
def sequential_values(df: DataFrame, column: str, interval: Any = 1, condition: Condition = None) -> DataFrame:
    """(column, prv) where the value is not its predecessor plus the interval.

    Values are counted first: the predecessor of a repeat is the value itself, whatever the number of repeats, and only
    different values are ordered. Every range of these is ordered by itself, and only the largest of each is handed to
    the next, so no task sees the whole column.
    """
    counts = scoped(df, condition).groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    value = F.col(f"`{column}`")
    firsts = with_neighbour(counts, [column], column, "prv", -1).where(~(value == F.col("prv") + interval)).select(value, "prv")
    again = counts.where("__n > 1").where(~(value == value + interval))
    return firsts.unionByName(repeated(again, "__n", 2).select(value, value.alias("prv")))


def cut_points(rows: DataFrame, order: list[str], per_range: int) -> list[tuple]:
    """Values of the order columns that cut the rows into ranges of about per_range rows: quantiles of a sample."""
    n = rows.count()
    parts = min(RANGES, -(-n // per_range))
    if parts < 2:
        return []
    sample = rows.select(*order).sample(min(1.0, RANGE_SAMPLE * parts / n), seed=7).collect()
    ranked = sorted({tuple(r) for r in sample}, key=lambda r: [(x is not None, x) for x in r])
    return [ranked[i] for i in sorted({len(ranked) * k // parts for k in range(1, parts)}) if i < len(ranked)]


def range_number(rows: DataFrame, order: list[str], cuts: list[tuple]) -> Column:
    """How many of the ascending cut points lie below a row, found in two steps of about the root of their number."""
    kinds = [rows.schema[c].dataType for c in order]

    def struct(values: Sequence[Column]) -> Column:
        return F.struct(*[v.cast(k).alias(f"c{i}") for i, (v, k) in enumerate(zip(values, kinds, strict=True))])

    own = struct([F.col(f"`{c}`") for c in order])
    step = max(1, round(len(cuts) ** 0.5))
    blocks = [[struct([F.lit(x) for x in cut]) for cut in cuts[i : i + step]] for i in range(0, len(cuts), step)]
    below = F.size(F.filter(F.array(*[b[0] for b in blocks]), lambda c: c < own))
    block = F.get(F.array(*[F.array(*b) for b in blocks]), F.greatest(below - 1, F.lit(0)))
    return F.greatest(below - 1, F.lit(0)) * step + F.size(F.filter(block, lambda c: c < own))


def with_neighbour(rows: DataFrame, order: list[str], value: str, name: str, step: int, per_range: int | None = None) -> DataFrame:
    """rows with the previous (step -1) or next (1) row's value in a global order, nulls first, under `name`.

    Quantiles of the order columns, of any type that sorts, cut the rows into ranges; their number follows that of the
    rows. `rows` is read three times: counted, sampled (where there are several ranges), and ordered.
    """
    cuts = cut_points(rows, order, per_range or RANGE_ROWS)
    marked = rows.withColumn("__part", range_number(rows, order, cuts) if cuts else F.lit(0))
    down = [F.col(c).asc() if step < 0 else F.col(c).desc() for c in order]
    near = F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy("__part").orderBy(*down))
    marked = marked.withColumn("__near", near)
    if not cuts:
        return marked.withColumn(name, F.col("__near")["v"]).drop("__part", "__near")
    rank = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order])
    edges = rows.withColumn("__part", range_number(rows, order, cuts)).groupBy("__part").agg((F.max_by if step < 0 else F.min_by)(F.struct(F.col(value).alias("v")), rank).alias("edge"))
    across = Window.orderBy(F.col("__part").asc() if step < 0 else F.col("__part").desc())
    edges = edges.select("__part", F.lag("edge").over(across).alias("__edge"))
    marked = marked.join(F.broadcast(edges), "__part")
    return marked.withColumn(name, F.coalesce("__near", "__edge")["v"]).drop("__part", "__near", "__edge")


@query
def mutually_exclusive_ranges(df: DataFrame, lower_bound_column: str, upper_bound_column: str, partition_by: Sequence[str] = (), condition: Condition = None) -> DataFrame:
    """Ranges that end before they start, or after the next one starts; within partitions if given."""
    rows = scoped(df, condition).select(F.col(lower_bound_column).alias("lower_bound"), F.col(upper_bound_column).alias("upper_bound"), *[F.col(c).alias(f"__p{i}") for i, c in enumerate(partition_by)])
    if partition_by:
        keys = [f"__p{i}" for i in range(len(partition_by))]
        window = Window.partitionBy(*keys).orderBy("lower_bound", "upper_bound")
        rows = rows.withColumn("__next", F.lead(F.struct(F.col("lower_bound").alias("v"))).over(window))
        rows = rows.withColumns({"next_lower_bound": F.col("__next.v"), "is_last_record": F.col("__next").isNull()}).drop("__next", *keys)
    else:
        # of equal ranges all but the last are followed by one that starts where they do
        counts = rows.groupBy("lower_bound", "upper_bound").agg(F.count(F.lit(1)).alias("__n")).withColumn("__lower", F.struct(F.col("lower_bound").alias("v")))
        lasts = with_neighbour(counts, ["lower_bound", "upper_bound"], "__lower", "__next", 1).drop("__n", "__lower")
        others = repeated(counts, "__n", 2).select("lower_bound", "upper_bound", F.col("__lower").alias("__next"))
        rows = lasts.unionByName(others)
        rows = rows.withColumns({"next_lower_bound": F.col("__next.v"), "is_last_record": F.col("__next").isNull()}).drop("__next")
    ordered = F.coalesce(F.col("lower_bound") <= F.col("upper_bound"), F.lit(False))
    apart = F.coalesce(F.col("upper_bound") <= F.col("next_lower_bound"), F.col("is_last_record"), F.lit(False))
    rows = rows.withColumns({"lower_bound_lte_upper_bound": ordered, "upper_bound_lte_next_lower_bound": apart})
    return rows.where("NOT (lower_bound_lte_upper_bound AND upper_bound_lte_next_lower_bound)")


@query
def z_score(df: DataFrame, column: str, threshold: float, condition: Condition = None) -> DataFrame:
    """(column, z_score) of values further from the mean than so many standard deviations.

    The condition restricts what mean and deviation come from, not the rows that are judged.
    """
    stats = scoped(df, condition).agg(F.avg(column).alias("__mean"), F.stddev_samp(column).alias("__deviation"))
    score = (F.col(column) - F.col("__mean")) / F.nullif(F.col("__deviation"), F.lit(0.0))
    return df.crossJoin(F.broadcast(stats)).select(column, score.alias("z_score")).where(F.abs("z_score") > threshold)


def statistic_in_range(df: DataFrame, name: str, value: Column, min_v: Any, max_v: Any, inclusive: bool, condition: Condition) -> DataFrame:
    return scoped(df, condition).agg(value.alias(name)).where(outside(F.col(name), min_v, max_v, inclusive))


@query
def stddev_in_range(df: DataFrame, column: str, min_v: Any = None, max_v: Any = None, inclusive: bool = True, condition: Condition = None) -> DataFrame:
    """One row if the sample standard deviation lies outside the range."""
    return statistic_in_range(df, f"stddev_{column}", F.stddev_samp(column), min_v, max_v, inclusive, condition)


@query
def mean_in_range(df: DataFrame, column: str, min_v: Any = None, max_v: Any = None, inclusive: bool = True, condition: Condition = None) -> DataFrame:
    """One row if the mean lies outside the range."""
    return statistic_in_range(df, f"mean_{column}", F.avg(column), min_v, max_v, inclusive, condition)


@query
def kl_divergence(df: DataFrame, source_column: str, target_column: str, threshold: float, condition: Condition = None) -> DataFrame:
    """(value, kl_divergence): values whose shares in the two columns diverge by more than the threshold.

    A value's terms are p log(p / q) and q log(q / p); a value that one column lacks has no term (q or p is 0). The
    columns are aligned by value, so they need not be the same column.
    """
    rows = scoped(df, condition)
    total = rows.agg(F.count(F.lit(1)).alias("__total"))

    def shares(column: str, name: str) -> DataFrame:
        counts = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("__n"))
        return counts.crossJoin(F.broadcast(total)).select("value", (F.col("__n") / F.col("__total")).alias(name))

    both = shares(source_column, "p").join(shares(target_column, "q"), "value", "full_outer").fillna(0.0, ["p", "q"])
    forth = F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("p") * F.log(F.col("p") / F.col("q")))
    back = F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("q") * F.log(F.col("q") / F.col("p")))
    return both.select("value", (forth + back).alias("kl_divergence")).where(F.col("kl_divergence") > threshold)


@query
def chi_square(df: DataFrame, column_a: str, column_b: str, critical_value: float, dependent: bool = True, condition: Condition = None) -> DataFrame:
    """(degrees_of_freedom, chi_square) if the test of independence contradicts what is claimed.

    One pass counts the cells; totals of rows and columns of the table come from these counts.
    """
    rows = scoped(df, condition).select(F.col(column_a).alias("a"), F.col(column_b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    cells = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("observed"))
    cells = cells.withColumns({"in_a": F.sum("observed").over(Window.partitionBy("a")), "in_b": F.sum("observed").over(Window.partitionBy("b"))})
    totals = cells.agg(F.sum("observed").alias("total"), F.countDistinct("a").alias("n_a"), F.countDistinct("b").alias("n_b"))
    expected = F.col("in_a") * F.col("in_b") / F.col("total")
    result = cells.crossJoin(F.broadcast(totals)).agg(
        ((F.first("n_a") - 1) * (F.first("n_b") - 1)).alias("degrees_of_freedom"),
        F.sum((F.col("observed") - expected) * (F.col("observed") - expected) / expected).alias("chi_square"),
    )
    claim = F.col("chi_square") > critical_value if dependent else F.col("chi_square") <= critical_value
    return result.where(~claim)


# audits across tables


@query
def relationship(df: DataFrame, column: str, parent: DataFrame, parent_column: str, condition: Condition = None) -> DataFrame:
    """Rows whose value is missing in the parent table; nulls pass."""
    keys = parent.select(F.col(parent_column).alias("__key")).distinct()
    rows = scoped(df, condition).where(F.col(column).isNotNull())
    return rows.join(keys, rows[column] == keys["__key"], "left_anti")


@query
def cardinality_equality(df: DataFrame, column: str, other: DataFrame, other_column: str, condition: Condition = None) -> DataFrame:
    """Values with different numbers of rows in the two tables, with both numbers."""
    left = scoped(df, condition).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n_left"))
    right = other.groupBy(F.col(other_column).alias("value")).agg(F.count(F.lit(1)).alias("n_right"))
    joined = left.join(right, left["value"].eqNullSafe(right["value"]), "full_outer")
    return joined.select(F.coalesce(left["value"], right["value"]).alias("value"), F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right")).where("n_left <> n_right")


@query
def equality(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows that one table holds more often than the other, with the side."""
    right = other.select(df.columns)
    return df.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(df).withColumn("side", F.lit("right")))


@query
def equal_row_count(df: DataFrame, other: DataFrame) -> DataFrame:
    """One row if the tables have different numbers of rows."""
    return counts_of(df, other).where("n_left <> n_right")


@query
def fewer_rows_than(df: DataFrame, other: DataFrame) -> DataFrame:
    """One row if the table does not have fewer rows than the other."""
    return counts_of(df, other).where("n_left >= n_right")


def counts_of(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_left")).crossJoin(other.agg(F.count(F.lit(1)).alias("n_right")))


#: Audits whose violations can be counted without making them; None where they cannot after all.
COUNTS: dict[str, Callable[..., int | None]] = {"unique_values": repeats}


@dataclass(frozen=True)
class Audit:
    """An audit with its arguments. A blocking one stops what follows; '<name>_non_blocking' only warns."""

    name: str
    arguments: dict[str, Any]
    blocking: bool | None = None

    @property
    def base(self) -> str:
        return self.name.removesuffix("_non_blocking")

    @property
    def blocks(self) -> bool:
        return self.blocking if self.blocking is not None else not self.name.endswith("_non_blocking")

    def violations(self, df: DataFrame) -> DataFrame:
        if self.base not in AUDITS:
            raise KeyError(f"no audit {self.base}")
        return AUDITS[self.base](df, **self.arguments)


@dataclass(frozen=True)
class Outcome:
    audit: Audit
    count: int

    @property
    def passed(self) -> bool:
        return self.count == 0


class AuditError(Exception):
    """A blocking audit found violations."""


def failures(df: DataFrame, audits: Sequence[Audit]) -> list[Outcome]:
    """Violations of every audit. All that are plain filters are counted in one aggregation over one scan."""
    plain = [a for a in audits if a.base in PREDICATES]
    counts: dict[int, int] = {}
    if plain:
        columns = []
        for i, audit in enumerate(plain):
            arguments = dict(audit.arguments)
            condition = arguments.pop("condition", None)
            columns.append(F.count_if(all_of(PREDICATES[audit.base](**arguments), condition)).alias(f"n{i}"))
        row = df.agg(*columns).first()
        counts = {id(a): row[f"n{i}"] for i, a in enumerate(plain)}

    def count(a: Audit) -> int:
        known = COUNTS[a.base](df, **a.arguments) if a.base in COUNTS else None
        return a.violations(df).count() if known is None else known

    return [Outcome(a, counts[id(a)] if id(a) in counts else count(a)) for a in audits]


def enforce(df: DataFrame, audits: Sequence[Audit]) -> list[Outcome]:
    """Run audits; raise if a blocking one fails, else return all outcomes."""
    found = failures(df, audits)
    bad = [o for o in found if not o.passed and o.audit.blocks]
    if bad:
        raise AuditError("; ".join(f"{o.audit.name}: {o.count} violations" for o in bad))
    return found
