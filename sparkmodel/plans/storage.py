"""Tables as directories of parts with a manifest of the present ones: atomic replacement without a table format.

A write makes new directories beside the present ones and then adds the next manifest, so readers see either state, a
table can be read by what replaces it, and a write can be checked before it is published. Manifests are numbered and
never replaced: of two writers that start from the same one, the second finds its number taken.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from typing import Any
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmodel.functions.frames import align
from sparkmodel.plans.evolution import Policy, applied, changes, enforce, evolved


class Conflict(Exception):
    """Another process has changed what a write was computed from."""


class Files:
    """Small files on whatever file system Spark reaches a path with."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file, whole or not at all; False if there is one of that name."""
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        out = self.fs.create(self.path(draft))
        out.write(bytearray(text.encode()))
        out.close()
        kind = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        no_options = self.jvm.java.lang.reflect.Array.newInstance(kind, 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.conf).rename(self.path(draft), self.path(name), no_options)
        except Py4JJavaError as e:
            self.fs.delete(self.path(draft), True)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def latest(self, folder: str) -> tuple[int, Any]:
        """(number, content) of the last of a folder's numbered documents; (0, None) if there is none."""
        numbers = [int(n[len(NUMBERED) : -5]) for n in self.names(folder) if n.startswith(NUMBERED) and n.endswith(".json")]
        return (max(numbers), json.loads(self.read(f"{folder}/{NUMBERED}{max(numbers):012d}.json"))) if numbers else (0, None)

    def numbered(self, folder: str, number: int) -> Any:
        """One of a folder's numbered documents; None if it is not there."""
        name = f"{folder}/{NUMBERED}{number:012d}.json"
        return json.loads(self.read(name)) if self.exists(name) else None

    def add(self, folder: str, number: int, content: Any) -> bool:
        """Add a numbered document; False if the number is taken."""
        return self.create(f"{folder}/{NUMBERED}{number:012d}.json", json.dumps(content, indent=1, sort_keys=True))

    def update(self, folder: str, change: Callable[[Any], Any]) -> Any:
        """Add the changed content of the last document, however often another process comes first."""
        while True:
            number, content = self.latest(folder)
            after = change(content)
            if self.add(folder, number + 1, after):
                if number > KEPT:
                    self.delete(f"{folder}/{NUMBERED}{number - KEPT:012d}.json")
                return after

    def delete(self, name: str) -> bool:
        return self.fs.delete(self.path(name), True)

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.exists(name) else []


PART = "__part"
#: Names of numbered documents, and how many old ones stay.
NUMBERED, KEPT = "state-", 20
TEMPORARY_HOURS = 24


class TableStore:
    """Tables by name under one root.

    A table is a manifest (the last of its numbered documents) that names its schema and its parts: directories, each
    written once. A full write has one part. Tables that are loaded range by range, partition by partition or by
    buckets of keys have a part for each of these, so a load writes the rows it brings and touches no others.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    def manifest(self, name: str) -> dict[str, Any] | None:
        number, content = self.files.latest(name)
        return None if content is None or content.get("dropped") else content | {"number": number}

    def exists(self, name: str) -> bool:
        return self.manifest(name) is not None

    def parts(self, name: str) -> dict[str, str]:
        """Directories by part; the part of a whole write is ''."""
        now = self.manifest(name)
        if now is None:
            raise KeyError(f"no table {name}")
        return now["parts"]

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromJson(self.manifest(name)["schema"])

    def read(self, name: str) -> DataFrame:
        parts, schema = self.parts(name), self.schema(name)
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.load(name, parts.values(), schema)

    def load(self, name: str, parts: Iterable[str], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.files.root}/{name}/{p}" for p in parts])

    def load_parts(self, name: str, wanted: Callable[[str], bool]) -> DataFrame:
        """The rows of some parts."""
        now = self.manifest(name)
        schema = T.StructType.fromJson(now["schema"])
        found = [v for k, v in now["parts"].items() if wanted(k)]
        return self.load(name, found, schema) if found else self.spark.createDataFrame([], schema)

    def publish(self, name: str, basis: dict[str, Any] | None, parts: dict[str, str], schema: T.StructType, partition_by: Sequence[str] = (), **more: Any) -> None:
        """Make these parts the table's state, if it still is the one that the write started from.

        A table keeps what it has noted about itself (number of buckets, properties) unless `more` says otherwise.
        """
        kept = {k: v for k, v in (basis or {}).items() if k not in ("number", "dropped")}
        previous = sorted(basis["parts"].values()) if basis else []
        content = kept | {"parts": parts, "schema": json.loads(schema.json()), "previous": previous, "partition_by": list(partition_by)} | more
        number = basis["number"] if basis else self.files.latest(name)[0]
        if not self.files.add(name, number + 1, content):
            raise Conflict(f"{name} was changed by another write")

    def stage(self, name: str, df: DataFrame, partition_by: Sequence[str], schema: T.StructType, check: Callable[[DataFrame], None] | None) -> tuple[str, list[str]]:
        """Write rows to a new directory and let `check` look at them: (directory, its parts). An exception removes it."""
        version = uuid.uuid4().hex
        df.write.partitionBy(*partition_by).parquet(f"{self.files.root}/{name}/{version}")
        inside = [n for n in self.files.names(f"{name}/{version}") if n.startswith(f"{PART}=")]
        if check is not None:
            try:
                paths = [f"{version}/{n}" for n in inside] if partition_by and partition_by[0] == PART else [version]
                check(self.load(name, paths, schema) if paths else self.spark.createDataFrame([], schema))
            except Exception:
                self.files.delete(f"{name}/{version}")
                raise
        return version, inside

    def stage_parts(self, name: str, df: DataFrame, part: Column, schema: T.StructType, check: Callable[[DataFrame], None] | None) -> tuple[str, dict[str, str]]:
        """stage() with a part for each value of `part`: (directory, its parts by value).

        The rows of a part go to one task, and those of a large one to several: the exchange is cut by size.
        """
        rows = align(df, schema).withColumn(PART, part)
        version, inside = self.stage(name, rows.hint("rebalance", F.col(PART)), [PART], schema, check)
        return version, {unquote(n.partition("=")[2]): f"{version}/{n}" for n in inside}

    def write(self, name: str, df: DataFrame, partition_by: Sequence[str] = (), check: Callable[[DataFrame], None] | None = None, **more: Any) -> DataFrame:
        """Write the next state of the whole table; an exception from `check` keeps the present one."""
        basis = self.manifest(name)
        version, _ = self.stage(name, df, partition_by, df.schema, check)
        self.publish(name, basis, {"": version}, df.schema, partition_by, **more)
        return self.read(name)

    def append(self, name: str, df: DataFrame, check: Callable[[DataFrame], None] | None = None) -> DataFrame:
        """Add rows as a part of their own; other writers do not matter."""
        schema = self.schema(name)
        version, _ = self.stage(name, align(df, schema), (), schema, check)
        while True:
            now = self.manifest(name)
            try:
                self.publish(name, now, {**now["parts"], version: version}, schema, now["partition_by"])
                return self.read(name)
            except Conflict:
                continue

    def replace_parts(self, name: str, df: DataFrame, part: Column, gone: Callable[[str], bool] = lambda _: False, check: Callable[[DataFrame], None] | None = None, **more: Any) -> DataFrame:
        """Write rows as one part per value of `part` (text). Parts of these names are replaced, and those in `gone` go.

        A write that meets another one takes its other parts over; if both replace a part, the second fails.
        """
        basis = now = self.manifest(name)
        schema = T.StructType.fromJson(now["schema"]) if now else df.schema
        _, fresh = self.stage_parts(name, df, part, schema, check)

        def goes(k: str) -> bool:
            return k in fresh or bool(k and gone(k))

        while True:
            had = now["parts"] if now else {}
            if {k: v for k, v in had.items() if goes(k)} != {k: v for k, v in (basis["parts"] if basis else {}).items() if goes(k)} or now and now["schema"] != json.loads(schema.json()):
                raise Conflict(f"{name}: parts of this write were changed by another one")
            try:
                self.publish(name, now, {k: v for k, v in had.items() if not goes(k)} | fresh, schema, now["partition_by"] if now else [], **more)
                return self.read(name)
            except Conflict:
                now = self.manifest(name)

    def evolve(self, name: str, schema: T.StructType, destructive: Policy = Policy.ERROR, additive: Policy = Policy.ALLOW) -> bool:
        """Take on another schema if the policies allow it; False if nothing changes.

        New columns are null in old parts without rewriting them; anything else rewrites each part by itself.
        """
        basis = self.manifest(name)
        now = T.StructType.fromJson(basis["schema"])
        steps = enforce(changes(now, schema), destructive, additive)
        if not steps:
            return False
        after = applied(now, steps)
        parts = basis["parts"]
        if not all(s.additive and len(s.path) == 1 for s in steps):
            parts = {k: self.stage(name, evolved(self.load(name, [v], now), after), (), after, None)[0] for k, v in parts.items()}
        self.publish(name, basis, parts, after, basis["partition_by"])
        return True

    def clone(self, source: str, name: str) -> DataFrame:
        return self.write(name, self.read(source), self.manifest(source)["partition_by"])

    def rename(self, source: str, name: str) -> None:
        self.files.fs.rename(self.files.path(source), self.files.path(name))

    def drop(self, name: str) -> bool:
        return self.files.delete(name)

    def delete_where(self, name: str, condition: str) -> DataFrame:
        """Rows for which the condition is true go."""
        return self.write(name, self.read(name).where(f"NOT coalesce({condition}, false)"), self.manifest(name)["partition_by"])

    def update_where(self, name: str, values: dict[str, str], condition: str = "true") -> DataFrame:
        """Columns of the rows for which the condition is true take the values (SQL text over the row's columns)."""
        now = self.read(name)
        holds = F.coalesce(F.expr(condition), F.lit(False))
        rows = now.select(*[F.when(holds, F.expr(values[f.name])).otherwise(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) if f.name in values else F.col(f"`{f.name}`") for f in now.schema.fields])
        return self.write(name, rows, self.manifest(name)["partition_by"])

    def create(self, name: str, schema: T.StructType, **more: Any) -> DataFrame:
        """An empty table, as another one is (schema(other)) or of a schema of its own."""
        self.publish(name, self.manifest(name), {}, schema, **more)
        return self.read(name)

    def set_properties(self, name: str, **properties: Any) -> dict[str, Any]:
        """Notes about a table (format, owner, comment, cluster_by, ...); returns all of them."""
        now = self.manifest(name)
        after = now.get("properties", {}) | properties
        self.publish(name, now, now["parts"], T.StructType.fromJson(now["schema"]), now["partition_by"], properties=after)
        return after

    def properties(self, name: str) -> dict[str, Any]:
        return self.manifest(name).get("properties", {})

    @contextmanager
    def temporary(self, df: DataFrame) -> Iterator[DataFrame]:
        """A written table for the length of a block: what is read twice is computed once."""
        name = f"temporary-{uuid.uuid4().hex}"
        try:
            yield self.write(name, df)
        finally:
            self.drop(name)

    def in_use(self, name: str) -> bool:
        """Whether a table is a temporary one of a load that may still go on: made less than TEMPORARY_HOURS ago."""
        made = self.files.fs.getFileStatus(self.files.path(name)).getModificationTime()
        return name.startswith("temporary-") and made > (time.time() - TEMPORARY_HOURS * 3600) * 1000

    def truncate(self, name: str) -> DataFrame:
        now = self.manifest(name)
        self.publish(name, now, {}, T.StructType.fromJson(now["schema"]), now["partition_by"])
        return self.read(name)

    def vacuum(self, name: str, keep_previous: bool = True) -> list[str]:
        """Delete directories (listed) and manifests that no reader can need: all but the present ones and the parts before."""
        now = self.manifest(name)
        used = [*now["parts"].values(), *(now["previous"] if keep_previous else [])]
        kept = {f"{NUMBERED}{now['number']:012d}.json", *(u.partition("/")[0] for u in used)}
        gone = [v for v in self.files.names(name) if v not in kept]
        for v in gone:
            self.files.delete(f"{name}/{v}")
        return [v for v in gone if not v.startswith(NUMBERED)]
