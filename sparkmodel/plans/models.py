"""Models: what they compute, how they are written, and the fingerprints that tell their versions apart."""

from __future__ import annotations

import functools
import hashlib
import inspect
import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from enum import Enum
from types import UnionType
from typing import Any, Union, get_args, get_origin, get_type_hints

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmodel.operators.audits import Audit
from sparkmodel.operators.writers import History, When
from sparkmodel.plans.evolution import Policy
from sparkmodel.plans.times import Cron, IntervalUnit, TimeLike


class Kind(Enum):
    FULL = "full"
    VIEW = "view"
    EMBEDDED = "embedded"
    EXTERNAL = "external"
    SEED = "seed"
    TIME_RANGE = "time_range"
    UNIQUE_KEY = "unique_key"
    PARTITION = "partition"
    UNMANAGED = "unmanaged"
    HISTORY = "history"
    CUSTOM = "custom"
    MANAGED = "managed"

    @property
    def incremental(self) -> bool:
        return self in (Kind.TIME_RANGE, Kind.UNIQUE_KEY, Kind.PARTITION, Kind.UNMANAGED, Kind.HISTORY)

    @property
    def stored(self) -> bool:
        return self not in (Kind.VIEW, Kind.EMBEDDED, Kind.EXTERNAL)


@dataclass(frozen=True)
class Model:
    """A named computation. query is SQL text with :variables and {parent} names, or a function of the run's context."""

    name: str
    query: str | Callable[..., DataFrame] | None = None
    kind: Kind = Kind.FULL
    depends_on: Sequence[str] | None = None
    cron: str = "@daily"
    start: TimeLike | None = None
    end: TimeLike | None = None
    unit: IntervalUnit | None = None
    time_column: str | None = None
    time_format: str = "%Y-%m-%d"
    keys: Sequence[str] = ()
    when_matched: Sequence[When] = ()
    merge_filter: str | None = None
    history: History | None = None
    partition_by: Sequence[str] = ()
    overwrite: bool = False
    custom: str | None = None
    arguments: Mapping[str, Any] = field(default_factory=dict)
    columns: T.StructType | None = None
    audits: Sequence[Audit] = ()
    signals: Sequence[Callable[..., Any]] = ()
    grain: Sequence[str] = ()
    batch_size: int | None = None
    batch_concurrency: int | None = None
    buckets: int | None = None
    partition_by_time_column: bool = True
    materialized: bool = False
    disable_restatement: bool = False
    properties: Mapping[str, Any] = field(default_factory=dict)
    comments: Mapping[str, str] = field(default_factory=dict)
    restate_cron: str | None = None
    restate_intervals: int | None = None
    lookback: int = 0
    forward_only: bool = False
    allow_partials: bool = False
    on_destructive: Policy = Policy.ERROR
    on_additive: Policy = Policy.ALLOW
    path: str | None = None
    before: Sequence[str] = ()
    after: Sequence[str] = ()
    owner: str | None = None
    tags: Sequence[str] = ()
    description: str | None = None

    def __post_init__(self) -> None:
        needs = {Kind.TIME_RANGE: "time_column", Kind.UNIQUE_KEY: "keys", Kind.PARTITION: "partition_by", Kind.HISTORY: "history", Kind.CUSTOM: "custom", Kind.SEED: "path", Kind.EXTERNAL: "path", Kind.MANAGED: "keys"}
        wanted = needs.get(self.kind)
        if wanted and not getattr(self, wanted):
            raise ValueError(f"{self.name}: kind {self.kind.value} needs {wanted}")
        if self.kind not in (Kind.SEED, Kind.EXTERNAL) and self.query is None:
            raise ValueError(f"{self.name} has no query")

    @property
    def parents(self) -> list[str]:
        """Declared parents, else the {names} in the SQL, else none."""
        if self.depends_on is not None:
            return list(self.depends_on)
        return sorted(set(re.findall(r"\{([\w.]+)\}", self.query)) if isinstance(self.query, str) else ())

    @property
    def interval_unit(self) -> IntervalUnit:
        return self.unit or Cron(self.cron).unit()

    @property
    def stored(self) -> bool:
        """Whether the model has a table of its own; a materialized view has one."""
        return self.kind.stored or self.kind is Kind.VIEW and self.materialized

    @property
    def reads_itself(self) -> bool:
        return self.name in self.parents

    @property
    def sequential(self) -> bool:
        """Whether a load needs the one before it."""
        return self.reads_itself or self.kind in (Kind.UNIQUE_KEY, Kind.HISTORY)

    def source_text(self) -> str:
        if callable(self.query):
            return inspect.getsource(self.query)
        return " ".join((self.query or "").split())


MODELS: dict[str, Model] = {}


def model(name: str, **settings: Any) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a function (context) -> DataFrame as a model."""

    def register(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        MODELS[name] = Model(name, function, **settings)
        return function

    return register


def filled(text: Any, values: Mapping[str, Any]) -> Any:
    """A text with @{name} replaced; names compare without case, an unknown one is an error."""
    low = {k.lower(): v for k, v in values.items()}

    def value(m: re.Match[str]) -> str:
        if m[1].lower() not in low:
            raise KeyError(f"no value for @{{{m[1]}}}")
        return str(low[m[1].lower()])

    return re.sub(r"@\{(\w+)\}", value, text) if isinstance(text, str) else text


def blueprints(pattern: Model, variants: Sequence[Mapping[str, Any]], settings: Mapping[str, Any] | None = None) -> list[Model]:
    """A model for each variant: @{name} in the name, the SQL, tags and descriptions takes the variant's value.

    A variant's values go before the project's settings.
    """
    out = []
    for own in variants:
        values = {**(settings or {}), **own}
        out.append(replace(pattern, name=filled(pattern.name, values), query=filled(pattern.query, values), description=filled(pattern.description, values), tags=[filled(t, values) for t in pattern.tags], path=filled(pattern.path, values)))
    return out


def resolve_template(template: str, table: str) -> str:
    """A template with @{catalog_name}, @{schema_name} and @{table_name} taken from a table's dotted name; missing ones are empty."""
    parts = table.split(".")
    names = dict(zip(("table_name", "schema_name", "catalog_name"), [*reversed(parts), "", "", ""], strict=False))
    return re.sub(r"@\{(catalog_name|schema_name|table_name)\}", lambda m: names[m[1]], template)


def coerced_argument(value: Any, kind: Any) -> Any:
    """A macro's argument as the type that its signature names: numbers and truth values from text, sequences item by item."""
    if kind is Any or kind is inspect.Parameter.empty:
        return value
    if get_origin(kind) in (Union, UnionType):
        if value is None and type(None) in get_args(kind):
            return None
        for option in get_args(kind):
            try:
                return coerced_argument(value, option)
            except (TypeError, ValueError):
                continue
        raise TypeError(f"{value!r} is none of {kind}")
    if kind is type(None):
        if value is None:
            return None
        raise TypeError(f"{value!r} is not None")
    if get_origin(kind) in (list, tuple, set):
        inner = get_args(kind) or (Any,)
        items = list(value) if isinstance(value, (list, tuple, set)) else [value]
        fixed = get_origin(kind) is tuple and Ellipsis not in inner and len(inner) > 0
        if fixed and len(items) != len(inner):
            raise TypeError(f"{value!r} has not {len(inner)} items")
        return get_origin(kind)(coerced_argument(x, inner[i] if fixed else inner[0]) for i, x in enumerate(items))
    if kind is bool:
        if isinstance(value, bool):
            return value
        low = str(value).strip().lower()
        if low in ("true", "1", "yes"):
            return True
        if low in ("false", "0", "no"):
            return False
        raise TypeError(f"{value!r} is no truth value")
    if kind in (int, float, str):
        if isinstance(value, bool) or isinstance(value, Column):
            raise TypeError(f"{value!r} is no {kind.__name__}")
        return kind(value)
    if kind is Column:
        return value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(value)
    if isinstance(kind, type) and not isinstance(value, kind):
        raise TypeError(f"{value!r} is no {kind.__name__}")
    return value


#: Macro functions by name.
MACROS: dict[str, Callable[..., Any]] = {}


def macro(name: str | None = None) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
    """Register a function as a macro: its arguments are coerced to the types of its signature."""

    def register(function: Callable[..., Any]) -> Callable[..., Any]:
        signature, hints = inspect.signature(function), get_type_hints(function)

        @functools.wraps(function)
        def call(*args: Any, **kwargs: Any) -> Any:
            bound = signature.bind(*args, **kwargs)
            for key, value in bound.arguments.items():
                kind, sort = hints.get(key, Any), signature.parameters[key].kind
                if sort is inspect.Parameter.VAR_POSITIONAL:
                    bound.arguments[key] = tuple(coerced_argument(v, kind) for v in value)
                elif sort is inspect.Parameter.VAR_KEYWORD:
                    bound.arguments[key] = {k: coerced_argument(v, kind) for k, v in value.items()}
                else:
                    bound.arguments[key] = coerced_argument(value, kind)
            return function(*bound.args, **bound.kwargs)

        MACROS[name or function.__name__] = call
        return call

    return register


class Category(Enum):
    """What a change means for the data that exists."""

    BREAKING = "breaking"
    NON_BREAKING = "non_breaking"
    FORWARD_ONLY = "forward_only"
    INDIRECT_BREAKING = "indirect_breaking"
    INDIRECT_NON_BREAKING = "indirect_non_breaking"
    METADATA = "metadata"


def digest(*parts: Any) -> str:
    return hashlib.sha256(json.dumps(parts, default=str, sort_keys=True).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Fingerprint:
    """Hashes of what decides a model's data and of the rest, its own and its parents'."""

    data: str
    metadata: str
    parent_data: str
    parent_metadata: str
    shape: str = ""

    @property
    def version(self) -> str:
        return digest(self.data, self.parent_data)


def fingerprints(models: Mapping[str, Model], order: Sequence[str]) -> dict[str, Fingerprint]:
    out: dict[str, Fingerprint] = {}
    for name in order:
        if name not in models:
            continue
        m = models[name]
        shape = digest(list(m.before), list(m.after), m.kind.value, m.time_column, m.time_format, list(m.keys), [vars(w) for w in m.when_matched], m.merge_filter, str(m.history), list(m.partition_by), m.overwrite, m.custom, dict(m.arguments), m.columns.jsonValue() if m.columns else None, m.path, m.lookback, m.buckets, m.partition_by_time_column, m.materialized)
        data = digest(m.source_text(), shape)
        metadata = digest(m.owner, list(m.tags), m.description, m.cron, str(m.start), str(m.end), [(a.name, str(a.arguments)) for a in m.audits], list(m.grain), m.batch_size, m.batch_concurrency, m.disable_restatement, dict(m.properties), dict(m.comments))
        own = [out[p] for p in sorted(m.parents) if p in out and p != name]
        out[name] = Fingerprint(data, metadata, digest([(p.data, p.parent_data) for p in own]), digest([(p.metadata, p.parent_metadata) for p in own]), shape)
    return out


@dataclass(frozen=True)
class ModelChange:
    name: str
    category: Category
    direct: bool


def categorized(before: Mapping[str, Fingerprint], after: Mapping[str, Fingerprint], graph_children: Mapping[str, set[str]], models: Mapping[str, Model], adds_only: Callable[[str], bool] = lambda name: False) -> list[ModelChange]:
    """The category of every changed model: its own change first, then what follows for those that depend on it."""
    direct: dict[str, Category] = {}
    for name, f in after.items():
        if name not in before:
            direct[name] = Category.BREAKING
        elif f.data != before[name].data:
            direct[name] = Category.FORWARD_ONLY if models[name].forward_only else Category.NON_BREAKING if adds_only(name) else Category.BREAKING
        elif f.metadata != before[name].metadata:
            direct[name] = Category.METADATA
    indirect: dict[str, Category] = {}
    for name, category in direct.items():
        if category is Category.METADATA or name not in before:
            continue
        follow = Category.INDIRECT_BREAKING if category is Category.BREAKING else Category.INDIRECT_NON_BREAKING
        todo = list(graph_children.get(name, ()))
        while todo:
            child = todo.pop()
            if child == name or child in direct and direct[child] is not Category.METADATA:
                continue
            if indirect.get(child) is Category.INDIRECT_BREAKING or indirect.get(child) is follow:
                continue
            indirect[child] = follow
            todo += graph_children.get(child, ())
    out = [ModelChange(n, c, True) for n, c in direct.items() if n not in indirect or c is not Category.METADATA]
    return out + [ModelChange(n, c, False) for n, c in indirect.items()]


def with_changes(m: Model, **settings: Any) -> Model:
    return replace(m, **settings)
