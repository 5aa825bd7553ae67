"""Loads by key that rewrite what they change: tables are dealt into buckets of keys, and a load touches its buckets only.

A bucket is the set of keys with one remainder of their hash, and a part of its own in the table's manifest. A merge
reads and rewrites the buckets of the keys that it brings. A history keeps each bucket's open versions in one part and
closed ones in others: closed versions are written once, by the load that closes them, and never again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmodel.functions.columns import ColumnLike, as_column
from sparkmodel.functions.frames import align
from sparkmodel.operators.writers import History, When, historized, merged
from sparkmodel.plans.storage import TableStore

#: Rows of a bucket that a table's first load aims at, and the least and most buckets of a table.
BUCKET_ROWS, LEAST, MOST = 1_000_000, 16, 4_096
Check = Callable[[DataFrame], None] | None


def number_of(keys: Sequence[ColumnLike], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[as_column(k) for k in keys]), F.lit(buckets)).cast("string")


def wanted_buckets(rows: int) -> int:
    return max(LEAST, min(MOST, -(-rows // BUCKET_ROWS)))


def numbers(rows: DataFrame, bucket: Column) -> set[str]:
    """The buckets that rows lie in: at most MOST values."""
    return {r[0] for r in rows.select(bucket.alias("b")).distinct().collect()}


def bucket_of(part: str) -> str:
    """The bucket in a part's name: '<bucket>', 'open|<bucket>' or 'closed|<bucket>|<load>'."""
    return part.split("|")[1] if "|" in part else part


def whole(store: TableStore, table: str, check: Check, touched: Callable[[str], bool]) -> Check:
    """A check of the table's next state, as one of the rows that a load writes."""
    if check is None or not store.exists(table):
        return check
    return lambda staged: check(staged.unionByName(store.load_parts(table, lambda p: not touched(p))))


def merge_load(store: TableStore, table: str, source: DataFrame, keys: Sequence[str], when: Sequence[When] = (), merge_filter: str | None = None, order: Sequence[Column] = (), check: Check = None, buckets: int | None = None) -> DataFrame:
    """merged() into a table by key, rewriting the buckets of the source's keys. The first load makes the table.

    A table that was written as a whole is dealt into buckets once. Loading the same rows again changes nothing.
    """
    now = store.manifest(table)
    if now is not None:
        source = align(source, store.schema(table))
    with store.temporary(source) as rows:
        n = (now or {}).get("buckets") or buckets or wanted_buckets(rows.count() + (store.read(table).count() if now else 0))
        bucket = number_of(keys, n)
        if now is None or "buckets" not in now:
            present = store.read(table) if now else rows.limit(0)
            gone: Callable[[str], bool] = lambda _: True
        else:
            own = numbers(rows, bucket)
            present = store.load_parts(table, own.__contains__)
            gone = own.__contains__
        after = merged(present, rows, keys, when, merge_filter, order)
        if now is not None and "" in now["parts"]:
            return rewritten(store, table, after, bucket, check, buckets=n)
        return store.replace_parts(table, after, bucket, gone, whole(store, table, check, gone), buckets=n)


def rewritten(store: TableStore, table: str, rows: DataFrame, part: Column, check: Check, **more: Any) -> DataFrame:
    """Replace a table that was one part by parts."""
    basis = store.manifest(table)
    schema = rows.schema
    version, inside = store.stage_parts(table, rows, part, schema, check)
    store.publish(table, basis, inside, schema, basis["partition_by"], **more)
    return store.read(table)


def history_load(store: TableStore, table: str, source: DataFrame, history: History, now: datetime, check: Check = None, buckets: int | None = None) -> DataFrame:
    """historized() into a table of versions, rewriting the open versions of buckets where something changes.

    Without invalidate_hard_deletes only the buckets of the source's keys are looked at; with it all open versions are
    read, to see which keys are gone, but only changed buckets are written. Closed versions of changed buckets are read
    where versions change by time, to see when a key that comes back was closed.
    """
    basis = store.manifest(table)
    first = basis is None
    if not first:
        # a key's hash depends on its type
        kinds = {f.name: f.dataType for f in store.schema(table).fields if f.name != history.updated_at}
        source = source.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in source.columns])
    with store.temporary(source) as rows:
        n = (basis or {}).get("buckets") or buckets or wanted_buckets(rows.count() + (store.read(table).count() if basis else 0))
        bucket = number_of(history.keys, n)
        still_open = F.col(history.valid_to).isNull()
        if first or "buckets" not in basis:
            after = historized(None if first else store.read(table), rows, history, now, first_load=first)
            part = F.when(still_open, F.concat(F.lit("open|"), bucket)).otherwise(F.concat(F.lit("closed|"), bucket, F.lit("|0")))
            if first:
                return store.replace_parts(table, after, part, check=check, buckets=n)
            return rewritten(store, table, after, part, check, buckets=n)
        looked_at = {str(b) for b in range(n)} if history.invalidate_hard_deletes is not False else numbers(rows, bucket)
        opened = store.load_parts(table, lambda p: p.startswith("open|") and bucket_of(p) in looked_at)
        changed = numbers(historized(opened, rows, history, now, mark="__changes").where("__changes"), bucket)
        if not changed:
            if check is not None:
                check(store.read(table))
            return store.read(table)
        needs_closed = history.columns is None
        present = store.load_parts(table, lambda p: bucket_of(p) in changed and (needs_closed or p.startswith("open|")))
        after = historized(present, rows.where(bucket.isin(sorted(changed))), history, now, keep_closed=False)
        part = F.when(still_open, F.concat(F.lit("open|"), bucket)).otherwise(F.concat(F.lit("closed|"), bucket, F.lit(f"|{basis['number']}")))

        def gone(p: str) -> bool:
            return p.startswith("open|") and bucket_of(p) in changed

        return store.replace_parts(table, after, part, gone, whole(store, table, check, gone))
