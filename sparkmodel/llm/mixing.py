"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source asks for its weight's share of the total. A source may repeat at most `max_epochs` times, so its target is
clamped there, and what it cannot take is shared again among the others by weight, until none is above its clamp. That
fixed point needs no iteration: with the sources ordered by clamp / weight, the clamped ones are a prefix, and running
sums tell where it ends. A target is then met by whole repetitions of the source and, for what is left, by one more copy of
documents in a seeded order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmodel.llm.runtime import BROADCAST_ROWS, drop_table, written

WEIGHTS, MAX_EPOCHS, SEED = (5, 2, 1), 3, "mix"
#: A word is what these six white-space characters separate.
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sources: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """(source, size, n) to the same with weight and target. Works on one row per source, in one task."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    rows = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int")).cast("bigint"))
    rows = rows.withColumn("cap", F.col("size") * max_epochs)
    fill = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumns({"all": F.sum("size").over(Window.partitionBy()), "left": F.sum("size").over(Window.partitionBy()) - F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("cap"), "asking": F.sum("weight").over(after)})
    big = "decimal(38,0)"
    rows = rows.withColumn("open", F.col("cap").cast(big) * F.col("asking").cast("decimal(19,0)") > F.col("left").cast(big) * F.col("weight").cast("decimal(19,0)"))
    level = F.max(F.when(F.col("open"), F.col("left").cast("double") / F.col("asking").cast("double"))).over(Window.partitionBy())
    target = F.when(F.col("open"), F.col("weight").cast("double") * level).otherwise(F.col("cap").cast("double"))
    return rows.select("source", "size", "n", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per document: id, source, size (words), source_size, target (of its source), taken (words, repeats counted).

    Sources are ordered by code point, null last, and take `weights` in turn; a null source is a source. The total is
    that of all sizes. taken is size times the copies in the mix: the source's whole repetitions, and one more for the
    documents that come first by md5 of seed and id, as long as half of the document still fits. A source's taken words
    differ from its target by at most half of one document. Null and empty texts have size 0 and take nothing; repeated
    rows count each for itself; a null id is hashed as the text 'null'. Extra columns are ignored, whatever their names;
    an empty table gives an empty result. A very long text is only counted, in the memory of its row.

    One pass reads the texts; after that only ids, sizes and hashes are moved. Words to fill are found without sorting a
    source: sizes are added up by hash prefix, with about as many prefixes as rows in one, and only the documents of the
    one prefix where the target is met are put in order. The table of sources, a row for each, is worked on in one task.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
    base = base.withColumn("key", F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("id").cast("string"), F.lit("null")))))
    base = written(base, "sizes")
    sources = base.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    plan = source_targets(sources, weights, max_epochs)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0)).cast("bigint")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("target") - (F.col("whole") * F.col("size")).cast("double"))
    plan = plan.withColumn("digits", F.ceil(F.log2(F.greatest(F.col("n"), F.lit(1)).cast("double")) / 8).cast("int"))
    plan = written(plan.select("source", F.col("size").alias("source_size"), "target", "whole", "rest", "digits"), "plan")
    few = plan.count() <= BROADCAST_ROWS

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("source", "__source")
        return left.join(F.broadcast(right) if few else right, left["source"].eqNullSafe(right["__source"]), "left").drop("__source")

    parts = beside(base, plan.select("source", "digits")).groupBy("source", F.expr("substr(key, 1, digits)").alias("part")).agg(F.sum("size").alias("sum"))
    upto = F.sum("sum").over(Window.partitionBy("source").orderBy("part"))
    parts = beside(parts.withColumn("upto", upto), plan.select("source", "rest")).where("upto > rest")
    edge = written(parts.groupBy("source").agg(F.min_by(F.col("upto") - F.col("sum"), "part").alias("before"), F.min("part").alias("edge")), "edges")
    rows = beside(beside(base, plan), edge)
    part = F.expr("substr(key, 1, digits)")
    inner = F.coalesce(part == F.col("edge"), F.lit(False))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at_edge = rows.where(inner).withColumn("more", (F.col("before") + upto - F.col("size")).cast("double") + F.col("size") / F.lit(2.0) <= F.col("rest"))
    others = rows.where(~inner).withColumn("more", F.coalesce(part < F.col("edge"), F.lit(False)))
    taken = F.col("size") * (F.col("whole") + F.col("more").cast("bigint"))
    out = written(at_edge.unionByName(others).select(F.col("id").alias(id_col), F.col("source"), "size", "source_size", "target", taken.alias("taken")), "mix")
    drop_table(base, plan, edge)
    return out


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The documents that the mix takes, with their columns and size, source_size, target, taken.

    Documents it takes no words of are left out. Rows that repeat id, source and size are taken alike (as the one of
    them that is taken least). Where docs has a column of one of the four names, both stay: the mix's gets a '_' at its
    end. Null, empty and very long texts and empty tables are as in mix_sources.
    """
    mixed = mix_sources(docs, id_col, text_col, source_col, weights, max_epochs, seed).toDF("__id", "__source", "__size", "source_size", "target", "taken")
    mixed = mixed.groupBy("__id", "__source", "__size").agg(F.first("source_size").alias("__source_size"), F.first("target").alias("__target"), F.min("taken").alias("__taken")).where("__taken > 0")
    names = {}
    for name in ("size", "source_size", "target", "taken"):
        names[f"__{name}"] = name
        while names[f"__{name}"] in docs.columns:
            names[f"__{name}"] += "_"
    own_size = "__own_size"
    while own_size in docs.columns:
        own_size += "_"
    rows = docs.select(*[docs[f"`{c}`"] for c in docs.columns], F.coalesce(F.regexp_count(docs[f"`{text_col}`"], F.lit(WORD)), F.lit(0)).cast("bigint").alias(own_size))
    same = rows[f"`{id_col}`"].eqNullSafe(mixed["__id"]) & rows[f"`{source_col}`"].eqNullSafe(mixed["__source"]) & (rows[own_size] == mixed["__size"])
    return rows.join(mixed, same).select(*[rows[f"`{c}`"] for c in docs.columns], *[mixed[c].alias(n) for c, n in names.items()])


def mix_sql(relation: str = "documents", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> str:
    """The same rows (doc_id, source, size, source_size, target, taken) as DuckDB SQL over a relation of documents."""
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return rf"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM {relation}),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {cases} END AS weight
  FROM sizes GROUP BY source),
filled AS (
  SELECT *, source_size * {max_epochs} AS cap,
         CAST(sum(source_size) OVER () - coalesce(sum(source_size * {max_epochs}) OVER (
           ORDER BY CAST(source_size * {max_epochs} AS DOUBLE) / weight, source NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS remaining,
         CAST(sum(weight) OVER (ORDER BY CAST(source_size * {max_epochs} AS DOUBLE) / weight, source NULLS LAST
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS HUGEINT) AS asking
  FROM sources),
levels AS (
  SELECT *, CAST(cap AS HUGEINT) * asking > remaining * weight AS is_open FROM filled),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_open THEN CAST(weight AS DOUBLE) * max(CASE WHEN is_open THEN CAST(remaining AS DOUBLE) / CAST(asking AS DOUBLE) END) OVER ()
              ELSE CAST(cap AS DOUBLE) END AS target
  FROM levels),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
running AS (
  SELECT s.doc_id, s.source, s.size, p.source_size, p.target, p.whole,
         p.target - CAST(p.whole * p.source_size AS DOUBLE) AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS FIRST, s.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sizes s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, size, source_size, target,
       CAST(size * (whole + CASE WHEN CAST(upto - size AS DOUBLE) + CAST(size AS DOUBLE) / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM running"""
