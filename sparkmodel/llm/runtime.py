"""What the operators of this subpackage share: the folder all executors see, written tables, and joins of skewed keys."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most this many rows may be broadcast (its columns are keys and numbers, so a few MB).
BROADCAST_ROWS = 50_000
#: Keys that may count as hot: those which hold more than this part of all rows, so that there are at most so many.
HOT_KEYS = 1_000
#: Bytes of rows in one Arrow batch for a Python worker.
BATCH_BYTES = 8 << 20
#: Lets Spark delete the shuffle files of a query as soon as it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: set[str] = set()
_open: list[list[DataFrame]] = []


def ship(spark: SparkSession) -> None:
    """Give every executor this package once per application, so that workers can import it.

    Spark reads the bound on the bytes of an Arrow batch from the session when a plan runs, which may be after an
    operator has returned. It is therefore lowered to BATCH_BYTES for the session, and left alone if it is lower: a
    worker's memory must not depend on the texts. Nothing else of the session is changed for longer than one write.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(setting, None) or 1 << 31) > BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, str(path.relative_to(package.parent)))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset in local mode (tests) a temporary one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for as long as the block lasts."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors.

    The shuffle files behind it are deleted once it is written; drop_table() deletes the table itself.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    with setting(spark, SHUFFLE_CLEANUP, "true"):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    for made in _open:
        made.append(table)
    return table


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Collects the tables that are written inside the block and deletes them at its end; take out those to keep."""
    made: list[DataFrame] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.pop()
        drop_table(*made)


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(*tables: DataFrame) -> None:
    """Delete the files of tables made by written(), once nothing reads them any more."""
    for table in tables:
        for folder in {os.path.dirname(f) for f in table.inputFiles()}:
            drop_folder(table.sparkSession, folder)


def put_bytes(path: str, data: bytes) -> None:
    """Write one file of the shared folder, from the driver or an executor."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    with store.open_output_stream(inner, compression=None) as f:
        f.write(data)


def get_bytes(path: str) -> bytes:
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_stream(inner, compression=None) as f:
        return f.read()


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", right_rows: int | None = None) -> DataFrame:
    """Join a large left side to a right side with one row per key, whatever the skew of the keys on the left.

    A right side of at most BROADCAST_ROWS counted rows is broadcast. A larger one is joined by a shuffle, in which
    adaptive execution splits the partitions of hot keys on the left: each of its rows meets one right row.
    """
    rows = right.count() if right_rows is None else right_rows
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, keys, how)


def skewed_join(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """left joined to right, which has one row per key and in `n` the number of left's rows that hold it.

    Keys that hold more than one in HOT_KEYS of left's `total` rows are fewer than HOT_KEYS, so these rows of right are
    broadcast and left's rows meet them where they lie. Only the rows of other keys are dealt out by key: no task gets
    more than a small part of left, whatever the skew. `n` does not stay. left is read twice, so it is a written table.
    """
    least = max(1, total // HOT_KEYS)
    hot = right.where(F.col(n) > least).drop(n)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col(n) <= least).drop(n), key)
    return left.join(F.broadcast(hot), key).unionByName(rest)
