"""Differences between two tables: of their schemas, and row by row."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmodel.functions.columns import canonical_text, row_key_text


@dataclass(frozen=True)
class SchemaDiff:
    """Columns that the target adds, lacks, or has with another type."""

    added: dict[str, T.DataType]
    removed: dict[str, T.DataType]
    modified: dict[str, tuple[T.DataType, T.DataType]]

    @property
    def changed(self) -> bool:
        return bool(self.added or self.removed or self.modified)

    def rows(self) -> list[tuple[str, str, str | None, str | None]]:
        """(column, change, source type, target type)."""
        out = [(c, "added", None, t.simpleString()) for c, t in self.added.items()]
        out += [(c, "removed", t.simpleString(), None) for c, t in self.removed.items()]
        return out + [(c, "modified", a.simpleString(), b.simpleString()) for c, (a, b) in self.modified.items()]


def schema_diff(source: T.StructType, target: T.StructType, ignore_case: bool = False) -> SchemaDiff:
    name = str.lower if ignore_case else str
    left, right = ({name(f.name): f.dataType for f in s.fields} for s in (source, target))
    return SchemaDiff(
        {c: t for c, t in right.items() if c not in left},
        {c: t for c, t in left.items() if c not in right},
        {c: (t, right[c]) for c, t in left.items() if c in right and right[c] != t},
    )


class RowDiff:
    """A full join of two tables on their grain, and what it shows.

    A single key column joins by '=', so null keys never meet. Several are joined by their texts with nulls as empty
    ones, so they can. `on` is another condition to join by, over s.column and t.column; keys then only name the rows.
    Columns of the same name and type are compared: nulls equal each other, fractional numbers are compared at
    `decimals` places, nested values as JSON.
    """

    def __init__(self, source: DataFrame, target: DataFrame, keys: Sequence[str] | Sequence[tuple[str, str]], decimals: int = 3, where: str | None = None, on: str | None = None):
        pairs = [(k, k) if isinstance(k, str) else k for k in keys]
        self.keys, self.decimals, self.on = pairs, decimals, on
        self.source, self.target = ((df.where(where) if where else df) for df in (source, target))
        types = {f.name: f.dataType for f in self.target.schema.fields}
        paired = {a for a, _ in pairs}
        self.compared = [f.name for f in self.source.schema.fields if types.get(f.name) == f.dataType and f.name not in paired]

    @cached_property
    def joined(self) -> DataFrame:
        """One row per pair or single row: keys, s__ and t__ columns, flags, and <column>_matches."""
        left_keys, right_keys = [a for a, _ in self.keys], [b for _, b in self.keys]
        many = len(self.keys) > 1
        left = self.source.select(*[F.col(f"`{c}`").alias(f"s__{c}") for c in self.source.columns], (row_key_text(self.source, left_keys) if many else F.col(f"`{left_keys[0]}`")).alias("s_key"), F.lit(1).alias("s_exists"))
        right = self.target.select(*[F.col(f"`{c}`").alias(f"t__{c}") for c in self.target.columns], (row_key_text(self.target, right_keys) if many else F.col(f"`{right_keys[0]}`")).alias("t_key"), F.lit(1).alias("t_exists"))
        if self.on is None:
            rows = left.join(right, left["s_key"] == right["t_key"], "full_outer")
        else:
            whole = lambda df, side: F.struct(*[F.col(f"{side}__{c}").alias(c) for c in df.columns]).alias(side)
            rows = left.select("*", whole(self.source, "s")).join(right.select("*", whole(self.target, "t")), F.expr(self.on), "full_outer").drop("s", "t")
        rows = rows.withColumns({"s_exists": F.coalesce("s_exists", F.lit(0)), "t_exists": F.coalesce("t_exists", F.lit(0))})
        no_left, no_right = (reduce(operator.or_, [F.col(f"{side}__{c}").isNull() for c in names]) for side, names in (("s", left_keys), ("t", right_keys)))
        rows = rows.withColumns({"row_joined": (F.col("s_exists") * F.col("t_exists")), "null_grain": (no_left & no_right).cast("int")})
        rows = rows.withColumns({f"{c}_matches": self.equal(c).cast("int") for c in self.compared})
        full = reduce(operator.mul, [F.col(f"{c}_matches") for c in self.compared], F.col("row_joined"))
        return rows.withColumn("row_full_match", full)

    def equal(self, column: str) -> Column:
        kind = self.source.schema[column].dataType
        left, right = F.col(f"s__{column}"), F.col(f"t__{column}")
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            left, right = (c.cast(f"decimal(38,{self.decimals})") for c in (left, right))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            left, right = (canonical_text(c, kind) for c in (left, right))
        return left.eqNullSafe(right)

    def summary(self) -> DataFrame:
        """One row of counts, and of percentages in which a pair counts for both tables.

        Rows are added up by key first, so that different keys are counted without a copy of the rows for each side.
        """
        names = {"s_count": "s_exists", "t_count": "t_exists", "join_count": "row_joined", "null_grain_count": "null_grain", "full_match_count": "row_full_match"}
        if self.on is not None:
            # the two keys of a pair may differ, so they are counted side by side
            sums = self.joined.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for n, c in names.items()], F.countDistinct("s_key").alias("distinct_count_s"), F.countDistinct("t_key").alias("distinct_count_t"))
            return self.with_shares(sums)
        by_key = self.joined.groupBy(F.coalesce("s_key", "t_key").alias("key")).agg(
            *[F.sum(c).alias(n) for n, c in names.items()],
            *[F.max(F.col(f"{side}_key").isNotNull().cast("int")).alias(f"distinct_count_{side}") for side in "st"],
        )
        sums = by_key.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in (*names, "distinct_count_s", "distinct_count_t")])
        return self.with_shares(sums)

    def with_shares(self, sums: DataFrame) -> DataFrame:
        """Counts with what follows from them."""
        sums = sums.withColumns({"s_only_count": F.col("s_count") - F.col("join_count"), "t_only_count": F.col("t_count") - F.col("join_count"), "partial_match_count": F.col("join_count") - F.col("full_match_count")})
        total = F.nullif(F.col("s_count") + F.col("t_count"), F.lit(0))

        def share(c: str, weight: int) -> Column:
            return F.round(F.coalesce(F.col(c) * weight * 100.0 / total, F.lit(0.0)), 2)

        return sums.withColumns({"full_match_pct": share("full_match_count", 2), "partial_match_pct": share("partial_match_count", 2), "s_only_pct": share("s_only_count", 1), "t_only_pct": share("t_only_count", 1)})

    def column_stats(self) -> DataFrame:
        """(column_name, pct_match): by column the share of pairs that agree in it."""
        rates = self.joined.where("row_joined = 1").agg(*[F.round(F.sum(f"{c}_matches") * 100.0 / F.count(F.lit(1)), 9).alias(c) for c in self.compared])
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("pct_match")) for c in self.compared]))
        return rates.select(pairs.alias("p")).select("p.*")

    def samples(self, limit: int = 20) -> DataFrame:
        """The first rows, by key, that only one table has, and pairs that differ: (side, key, columns as text).

        One pass over the join: each task hands on the first rows of each sort that it sees.
        """
        side = F.when(F.col("t_exists") == 0, "source_only").when(F.col("s_exists") == 0, "target_only").when(F.col("row_full_match") == 0, "common")
        key = F.coalesce("s_key", "t_key")
        texts = [F.col(f"{s}__{x}").cast("string").alias(f"{s}__{x}") for x in self.compared for s in "st"]
        rows = self.joined.select(side.alias("side"), key.alias("__key"), *texts).where("side IS NOT NULL")
        first = F.row_number().over(Window.partitionBy("side").orderBy("__key"))
        return rows.withColumn("__n", first).where(F.col("__n") <= limit).select("side", F.col("__key").cast("string").alias("key"), *[f"{s}__{x}" for x in self.compared for s in "st"])


def comparable(value: Column, kind: T.DataType) -> Column:
    """A value with its maps, at any depth, as lists of entries in the order of their keys: set operations take no maps."""
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(value))
        return F.transform(entries, lambda e: F.struct(e["key"].alias("key"), comparable(e["value"], kind.valueType).alias("value")))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: comparable(x, kind.elementType)) if "map<" in kind.simpleString() else value
    if isinstance(kind, T.StructType) and "map<" in kind.simpleString():
        return F.when(value.isNotNull(), F.struct(*[comparable(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


def multiset_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of one frame beyond those of the other, repeats counted, with `side` missing or unexpected.

    Nulls equal each other, and so do NaN values; maps are compared, and shown, as lists of their entries.
    """
    expected, actual = (df.select(*[comparable(F.col(f"`{c}`"), df.schema[c].dataType).alias(c) for c in expected.columns]) for df in (expected, actual))
    missing, extra = expected.exceptAll(actual), actual.exceptAll(expected)
    return missing.withColumn("side", F.lit("missing")).unionByName(extra.withColumn("side", F.lit("unexpected")))
