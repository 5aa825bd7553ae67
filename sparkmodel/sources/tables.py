"""Scans: tables by name, seeds from CSV, typed rows, and what the catalog holds."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class SeedFormat:
    """How a seed's CSV is read. na_values holds texts that are null, for all columns or by column."""

    delimiter: str = ","
    quote: str = '"'
    escape: str = '"'
    encoding: str = "UTF-8"
    line_separator: str | None = None
    skip_initial_space: bool = False
    na_values: Sequence[str] | Mapping[str, Sequence[str]] = field(default_factory=tuple)
    keep_default_na: bool = True


#: Texts that stand for null unless keep_default_na is off: fixed values of the format.
DEFAULT_NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
TRUE_TEXTS, FALSE_TEXTS = ("1", "true", "t", "yes", "y", "on"), ("0", "false", "f", "no", "n", "off")


def seed(spark: SparkSession, path: str, schema: T.StructType | str, csv: SeedFormat | None = None) -> DataFrame:
    """A CSV file with a header as a typed frame: texts are read first, nulls recognised, then every column coerced."""
    csv = csv or SeedFormat()
    kinds = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in kinds.fields])
    reader = spark.read.schema(raw).options(header=True, sep=csv.delimiter, quote=csv.quote, escape=csv.escape, encoding=csv.encoding, ignoreLeadingWhiteSpace=csv.skip_initial_space, enforceSchema=False)
    if csv.line_separator:
        reader = reader.option("lineSep", csv.line_separator)
    df = reader.csv(path)
    out = []
    for f in kinds.fields:
        given = csv.na_values.get(f.name, ()) if isinstance(csv.na_values, Mapping) else csv.na_values
        nulls = [*given, *(DEFAULT_NA if csv.keep_default_na else ())]
        text = F.when(~F.col(f"`{f.name}`").isin(nulls), F.col(f"`{f.name}`")) if nulls else F.col(f"`{f.name}`")
        out.append(coerced(text, f.dataType).alias(f.name))
    return df.select(*out)


def coerced(text, kind: T.DataType):  # noqa: ANN001, ANN201
    """A text column as another type; a date may be written with a time, a truth value in many ways."""
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.BooleanType):
        low = F.lower(F.trim(text))
        return F.when(low.isin(*TRUE_TEXTS), True).when(low.isin(*FALSE_TEXTS), False)
    if isinstance(kind, T.DateType):
        return F.to_date(text.cast("timestamp_ntz"))
    return text.cast(kind)


def typed_values(spark: SparkSession, rows: Iterable[Sequence[Any]] | pd.DataFrame, schema: T.StructType | str) -> DataFrame:
    """Rows, or a pandas frame, of a given schema; nested values are lists, dicts and tuples. Without rows it is empty."""
    if isinstance(rows, pd.DataFrame):
        rows = rows.astype(object).where(rows.notna(), None).itertuples(index=False, name=None)
    return spark.createDataFrame([tuple(r) for r in rows], schema)


#: pandas types and the column types they are read as.
PANDAS_TYPES = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "Int64": "bigint", "float16": "float", "float32": "float", "float64": "double", "bool": "boolean", "boolean": "boolean", "object": "string", "string": "string", "datetime64[ns]": "timestamp_ntz", "datetime64[ns, UTC]": "timestamp"}


def pandas_schema(frame: pd.DataFrame) -> T.StructType:
    """The schema that a pandas frame is read with; an unknown type is an error."""
    unknown = [str(t) for t in frame.dtypes if str(t) not in PANDAS_TYPES]
    if unknown:
        raise ValueError(f"no column type for {', '.join(unknown)}")
    return T.StructType.fromDDL(", ".join(f"`{c}` {PANDAS_TYPES[str(t)]}" for c, t in frame.dtypes.items()))


def catalog_objects(spark: SparkSession, database: str | None = None, names: Iterable[str] | None = None) -> list[dict[str, str]]:
    """Name, database and kind (table, view, temporary) of what the catalog lists."""
    wanted = None if names is None else set(names)
    return [{"name": t.name, "database": ".".join(t.namespace or []), "kind": t.tableType.lower()} for t in spark.catalog.listTables(database) if wanted is None or t.name in wanted]


def external_schemas(spark: SparkSession, tables: Iterable[str], threads: int = 8) -> dict[str, dict[str, str]]:
    """Columns and types of tables that no model makes, for declaring them; several are looked up at a time."""
    def columns(table: str) -> dict[str, str]:
        return {f.name: f.dataType.simpleString() for f in spark.table(table).schema.fields}

    names = list(tables)
    with ThreadPoolExecutor(threads) as pool:
        return dict(zip(names, pool.map(columns, names), strict=True))


def external_yaml(schemas: Mapping[str, Mapping[str, str]]) -> str:
    """Schemas as a list of declarations in YAML, and back with read_external_yaml."""
    return yaml.safe_dump([{"name": t, "columns": dict(c)} for t, c in schemas.items()], sort_keys=False, allow_unicode=True)


def read_external_yaml(text: str) -> dict[str, T.StructType]:
    return {x["name"]: T.StructType([T.StructField(n, T.StructType.fromDDL(f"c {k}")["c"].dataType) for n, k in x["columns"].items()]) for x in yaml.safe_load(text) or []}
