"""Model tests in YAML: rows of the inputs, and the rows that the model makes of them."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator, Mapping
from datetime import datetime
from pathlib import Path
from typing import Any

import yaml

from sparkmodel.plans.models import Model


def rows_of(given: Any, model: Model | None) -> Any:
    """The rows of a fixture: (rows, schema), or {"query": SQL}.

    A fixture is a list of rows, or a mapping with rows, format (yaml or csv) and path, columns (types by name), or query.
    Types are those of columns, else the model's, else inferred. CSV values are texts, empty ones null.
    """
    given = given if isinstance(given, Mapping) else {"rows": given}
    if "query" in given:
        return {"query": given["query"]}
    rows = given.get("rows", Path(given["path"]).read_text() if "path" in given else [])
    if given.get("format", "csv" if str(given.get("path", "")).endswith(".csv") else "yaml") == "csv":
        rows = [{k: v or None for k, v in r.items()} for r in csv.DictReader(io.StringIO(rows), skipinitialspace=True)]
    elif isinstance(rows, str):
        rows = yaml.safe_load(rows)
    types = given.get("columns")
    names = list(dict.fromkeys(k for r in rows for k in r)) or list(types or ())
    declared = {f.name: f.dataType.simpleString() for f in model.columns.fields} if model and model.columns else {}
    known = {**declared, **(types or {})}
    values = [tuple(r.get(n) for n in names) for r in rows]
    if all(n in known for n in names) and names:
        return [tuple(typed(v, known[n]) for v, n in zip(r, names, strict=True)) for r in values], ", ".join(f"`{n}` {known[n]}" for n in names)
    return values, names


def typed(value: Any, kind: str) -> Any:
    """A text as a value of a type that has a spelling of its own; other values as they are."""
    if not isinstance(value, str) or kind == "string":
        return value
    if kind in ("int", "bigint", "smallint", "tinyint"):
        return int(value)
    if kind in ("double", "float"):
        return float(value)
    if kind == "boolean":
        return value.strip().lower() == "true"
    if kind == "date":
        return datetime.fromisoformat(value).date()
    return datetime.fromisoformat(value) if kind.startswith("timestamp") else value


#: Parts of a SQL text: quoted ones, comments, words, single characters.
SQL_PARTS = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|\w+|.", re.DOTALL)


def sql_parts(text: str) -> Iterator[tuple[str, int, int]]:
    """(part, its start, depth of parentheses) of a SQL text."""
    depth = 0
    for m in SQL_PARTS.finditer(text):
        depth -= m[0] == ")"
        yield m[0], m.start(), depth
        depth += m[0] == "("


def only_cte(text: str, name: str) -> str:
    """A query with common table expressions, with one of these as its result: what follows WITH becomes SELECT * of it."""
    parts = list(sql_parts(text))
    if next((p.lower() for p, _, _ in parts if p.strip()), "") != "with":
        raise ValueError("the query has no common table expressions")
    main = next(at for p, at, depth in parts if depth == 0 and p.lower() == "select")
    return f"{text[:main]}SELECT * FROM {name}"


def frozen_times(text: str, now: datetime) -> str:
    """A SQL text in which the current date and time are those of `now`; what stands in quotes or comments stays."""
    date, stamp = f"DATE '{now:%Y-%m-%d}'", f"TIMESTAMP '{now:%Y-%m-%d %H:%M:%S.%f}'"
    words = {"current_date": date, "curdate": date, "current_timestamp": stamp, "now": stamp, "localtimestamp": f"TIMESTAMP_NTZ '{now:%Y-%m-%d %H:%M:%S.%f}'"}
    parts = [p for p, _, _ in sql_parts(text)]
    out, i = [], 0
    while i < len(parts):
        word = parts[i].lower()
        called = parts[i + 1 : i + 3] == ["(", ")"]
        if word in words and (called or word.startswith("current_") or word == "localtimestamp"):
            out.append(words[word])
            i += 3 if called else 1
            continue
        out.append(parts[i])
        i += 1
    return "".join(out)


def output_of(given: Any) -> Any:
    """The rows of the query among a case's outputs, which may hold some of common table expressions (ctes) as well."""
    if isinstance(given, Mapping) and "ctes" in given:
        return given.get("query_rows", given.get("rows", []))
    return given


def load_cases(text: str, models: Mapping[str, Model]) -> dict[str, dict[str, Any]]:
    """Cases by name, as Context.test takes them: {name: {model, inputs: {table: rows}, output: rows, vars, partial, start, end}}.

    An output may be {rows: rows, ctes: {name: rows}}.
    """
    out = {}
    for name, case in yaml.safe_load(text).items():
        missing = {"model", "output"} - case.keys()
        if missing:
            raise ValueError(f"{name} lacks {', '.join(sorted(missing))}")
        values = dict(case.get("vars", {}))
        out[name] = {
            "model": case["model"],
            "inputs": {t: rows_of(r, models.get(t)) for t, r in case.get("inputs", {}).items()},
            "expected": rows_of(output_of(case["output"]), models[case["model"]]),
            "ctes": {n: rows_of(r, None) for n, r in (case["output"].get("ctes", {}) if isinstance(case["output"], Mapping) else {}).items()},
            "vars": values,
            "partial": case.get("partial", False),
            "range": (str(case.get("start", "2000-01-01")), str(case.get("end", "2000-01-01"))),
            "execution": str(case.get("execution", "2000-01-01")),
        }
    return out


def case_text(name: str, case: Mapping[str, Any]) -> str:
    """A case as Context.create_test makes it, in YAML, so that load_cases reads it again."""
    def rows(given: tuple[list[tuple], Any]) -> dict[str, Any]:
        values, schema = given
        plain = lambda v: v if v is None or isinstance(v, (bool, int, float, str, list, dict)) else str(v)
        return {"rows": [{f.name: plain(v) for f, v in zip(schema.fields, r, strict=True)} for r in values], "columns": {f.name: f.dataType.simpleString() for f in schema.fields}}

    start, end = (str(x) for x in case["range"])
    body = {"model": case["model"], "inputs": {n: rows(r) for n, r in case["inputs"].items()}, "output": rows(case["expected"]), "start": start, "end": end}
    return yaml.safe_dump({name: body}, sort_keys=False, allow_unicode=True)
