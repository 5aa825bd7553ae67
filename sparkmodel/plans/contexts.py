"""The project: models, their state, and what can be done with them - plan, apply, run, evaluate, audit, compare, lint."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Collection, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime, timedelta
from typing import Any, ClassVar

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmodel.functions.frames import align
from sparkmodel.operators import writers as W
from sparkmodel.operators.audits import Outcome, enforce, failures
from sparkmodel.operators.table_diff import RowDiff, multiset_diff
from sparkmodel.plans import intervals as iv
from sparkmodel.plans.buckets import history_load, merge_load
from sparkmodel.plans.cases import frozen_times, only_cte
from sparkmodel.plans.graphs import Graph, Selector, run_graph
from sparkmodel.plans.lineage import column_lineage
from sparkmodel.plans.models import Category, Fingerprint, Kind, Model, ModelChange, categorized, fingerprints
from sparkmodel.plans.naming import Convention, physical_name
from sparkmodel.plans.plan_changes import only_adds_columns
from sparkmodel.plans.storage import Files, TableStore
from sparkmodel.plans.times import Cron, TimeLike, exclusive_end, from_millis, literal, millis, to_datetime, variables
from sparkmodel.sources.tables import pandas_schema, seed, typed_values
from sparkmodel.streaming.loads import merge_stream


class Ledger:
    """What has been loaded and what each environment shows: numbered JSON documents, of which the last one counts.

    A change is made to the last document and added under the next number; where another process was there first, it is
    made again to that process's document, so none is lost.
    """

    #: Steps from one form of the state to the next, by the number of the form they start from.
    MIGRATIONS: ClassVar[dict[int, Callable[[dict[str, Any]], dict[str, Any]]]] = {}

    def __init__(self, files: Files):
        self.files = files

    def get(self, name: str, default: Any) -> Any:
        found = self.files.latest(name)[1]
        return default if found is None else found

    def put(self, name: str, value: Any) -> None:
        self.files.update(name, lambda _: value)

    def intervals(self, table: str) -> list[iv.Interval]:
        return [tuple(x) for x in self.get("intervals", {}).get(table, [])]

    def change_intervals(self, table: str, change: Callable[[list[iv.Interval]], list[iv.Interval]]) -> None:
        self.files.update("intervals", lambda every: {**(every or {}), table: change([tuple(x) for x in (every or {}).get(table, [])])})

    def dump(self) -> dict[str, Any]:
        """All state, to be kept elsewhere or loaded into another project."""
        return {n: self.get(n, {}) for n in ("intervals", "environments", "restatements")} | {"form": self.form}

    def load(self, state: Mapping[str, Any]) -> None:
        for name, value in migrated(dict(state), self.MIGRATIONS).items():
            if name != "form":
                self.put(name, value)

    def rollback(self) -> list[str]:
        """Bring back each document as it was before its last change; returns the names of those that had one."""
        done = []
        for name in ("intervals", "environments", "restatements"):
            before = self.files.numbered(name, self.files.latest(name)[0] - 1)
            if before is not None:
                self.put(name, before)
                done.append(name)
        return done

    @property
    def form(self) -> int:
        return max(self.MIGRATIONS, default=0) + 1

    def environment(self, name: str) -> dict[str, Any] | None:
        return self.get("environments", {}).get(name)

    def change_environments(self, change: Callable[[dict[str, Any]], Any]) -> None:
        def changed(every: dict[str, Any] | None) -> dict[str, Any]:
            every = dict(every or {})
            change(every)
            return every

        self.files.update("environments", changed)


def migrated(state: dict[str, Any], steps: Mapping[int, Callable[[dict[str, Any]], dict[str, Any]]]) -> dict[str, Any]:
    """State of an older form after every step from its form on."""
    for number in sorted(n for n in steps if n >= state.get("form", 1)):
        state = steps[number](state) | {"form": number + 1}
    return state


@dataclass
class RunContext:
    """What a model's function gets: the session, its parents' frames by name, the range and the time variables."""

    spark: SparkSession
    table: Callable[[str], DataFrame]
    variables: Mapping[str, Any]
    start: datetime | None = None
    end: datetime | None = None
    execution: datetime | None = None

    def var(self, name: str, default: Any = None) -> Any:
        return self.variables.get(name, default)


@dataclass
class Plan:
    environment: str
    changes: list[ModelChange]
    removed: list[str]
    tables: dict[str, str]
    missing: dict[str, list[iv.Interval]]
    restated: dict[str, iv.Interval] = field(default_factory=dict)
    execution: datetime = field(default_factory=lambda: datetime.now(UTC))
    deployable: dict[str, bool] = field(default_factory=dict)

    @property
    def empty(self) -> bool:
        return not (self.changes or self.removed or any(self.missing.values()) or self.restated)

    def explain(self) -> list[str]:
        """The stages that apply() goes through, in words."""
        out = [f"{c.name}: {c.category.value}" for c in self.changes] + [f"{n}: removed" for n in self.removed]
        out += [f"restate {n} from {from_millis(a):%Y-%m-%d} to {from_millis(b):%Y-%m-%d}" for n, (a, b) in self.restated.items()]
        out += [f"load {n}: {len(i)} intervals" for n, i in self.missing.items() if i]
        return [*out, f"show {len(self.tables)} models in {self.environment}"]

    def stages(self) -> list[tuple[str, list[str]]]:
        """(stage, models) in the order in which apply() goes through them; stages without models are left out."""
        found = [("restate", sorted(self.restated)), ("load", [n for n, i in self.missing.items() if i]), ("promote", sorted(self.tables)), ("demote", self.removed)]
        return [("before_all", []), *[(n, m) for n, m in found if m], ("after_all", [])]


class Context:
    """A project over one session and one root folder."""

    def __init__(self, spark: SparkSession, root: str, models: Iterable[Model] = (), settings: Mapping[str, Any] | None = None, threads: int = 4, before_all: Iterable[str] = (), after_all: Iterable[str] = (), convention: Convention = Convention.SCHEMA_AND_TABLE):
        self.spark, self.threads, self.convention = spark, threads, convention
        self.before_all, self.after_all = list(before_all), list(after_all)
        self.models: dict[str, Model] = {m.name: m for m in models}
        self.settings = {k.lower(): v for k, v in (settings or {}).items()}
        self.store, self.ledger = TableStore(spark, f"{root.rstrip('/')}/tables"), Ledger(Files(spark, f"{root.rstrip('/')}/state"))

    def add(self, *models: Model) -> None:
        self.models |= {m.name: m for m in models}

    @property
    def graph(self) -> Graph[str]:
        graph: Graph[str] = Graph()
        for m in self.models.values():
            graph.add(m.name, [p for p in m.parents if p != m.name and p in self.models])
        return graph

    def fingerprints(self) -> dict[str, Fingerprint]:
        return fingerprints(self.models, self.graph.order())

    def selector(self) -> Selector:
        return Selector(self.graph, {n: m.tags for n, m in self.models.items()}, {n: m.kind.value for n, m in self.models.items()})

    # planning

    def diff(self, environment: str = "prod") -> tuple[list[ModelChange], list[str]]:
        """Changed models with their categories, and removed ones, against an environment."""
        shown = (self.ledger.environment(environment) or {}).get("fingerprints", {})
        before, after = {n: Fingerprint(**f) for n, f in shown.items()}, self.fingerprints()

        def adds_only(name: str) -> bool:
            return before[name].shape == after[name].shape and self.adds_columns(name, environment)

        return categorized(before, after, self.graph.children, self.models, adds_only), sorted(set(before) - set(self.models))

    def adds_columns(self, name: str, environment: str) -> bool:
        """Whether a model's SQL differs from what the environment shows by further output columns alone."""
        shown = self.ledger.environment(environment) or {}
        old, m = shown.get("queries", {}).get(name), self.models[name]
        if old is None or not isinstance(m.query, str):
            return False
        now = datetime.now(UTC)
        try:
            before, after = (self.query(q, shown["tables"], (now, now), now) for q in (replace(m, query=old, columns=None), replace(m, columns=None)))
            return only_adds_columns(before, after)
        except (PySparkException, KeyError):
            # what cannot be analyzed, as with a parent that is not loaded yet, cannot be told apart
            return False

    def deployable(self, changes: Iterable[ModelChange]) -> dict[str, bool]:
        """Whether what a development environment loads of a model may be shown in production later.

        It may not if the model's change is forward-only, for its table then holds rows of the old form, nor if one of
        its parents is not deployable. Models that did not change are.
        """
        direct = {c.name: c.category for c in changes}
        out: dict[str, bool] = {}
        for name in self.graph.order():
            own = direct.get(name) not in (Category.FORWARD_ONLY, Category.INDIRECT_NON_BREAKING) or name not in direct
            out[name] = own and all(out.get(p, True) for p in self.models[name].parents if p != name)
        return out

    def table_names(self, environment: str, changes: list[ModelChange], forward: str = "prod") -> dict[str, str]:
        """The table of each stored model: a new one for a breaking change, else the one that is shown.

        What is not deployable gets a table for previews of its own in an environment other than `forward`.
        """
        shown = (self.ledger.environment(environment) or {}).get("tables", {})
        anew = {c.name for c in changes if c.category in (Category.BREAKING, Category.INDIRECT_BREAKING, Category.NON_BREAKING)}
        prints, may = self.fingerprints(), self.deployable(changes)
        out = {}
        for n, m in self.models.items():
            if m.stored:
                preview = environment if environment != forward and not may[n] else None
                fresh = physical_name(n, prints[n].version, self.convention, preview)
                out[n] = fresh if preview or n not in shown or n in anew else shown[n]
        return out

    def start_of(self, name: str, now: datetime, seen: tuple[str, ...] = ()) -> int:
        m = self.models[name]
        parents = [self.start_of(p, now, (*seen, name)) for p in m.parents if p in self.models and p not in (*seen, name)]
        return iv.first_start(m.start, parents if m.start is None else (), Cron(m.cron), now)

    def missing_of(self, name: str, table: str, now: datetime, start: TimeLike | None = None, end: TimeLike | None = None, ledger: list[iv.Interval] | None = None) -> list[iv.Interval]:
        m = self.models[name]
        low = self.start_of(name, now) if start is None else millis(to_datetime(start, now))
        high = millis(Cron(m.cron).floor(now)) if end is None else min(millis(exclusive_end(end, now)), millis(now))
        loaded = self.ledger.intervals(table) if ledger is None else ledger
        if not m.kind.incremental:
            grid = iv.steps(low, high, m.interval_unit)
            return grid if any(not any(a <= s and e <= b for a, b in loaded) for s, e in grid) else []
        until = None if m.end is None else millis(exclusive_end(m.end, now))
        return iv.missing(loaded, low, high, m.interval_unit, m.lookback, until, m.allow_partials)

    def plan(self, environment: str = "prod", start: TimeLike | None = None, end: TimeLike | None = None, restate: Iterable[str] = (), select: Iterable[str] = (), now: TimeLike | None = None) -> Plan:
        """What it takes for an environment to show the models as they are now."""
        at = to_datetime(now) if now is not None else datetime.now(UTC)
        changes, removed = self.diff(environment)
        tables = self.table_names(environment, changes)
        wanted = self.selector().select(*select) if select else set(self.models)
        again: dict[str, iv.Interval] = {}
        names = self.selector().select(*restate) if restate else set()
        for n in self.graph.order():
            if (n in names or names & self.graph.upstream(n)) and not self.models[n].disable_restatement:
                m = self.models[n]
                low = millis(to_datetime(start, at)) if start is not None else self.start_of(n, at)
                high = millis(exclusive_end(end, at)) if end is not None else millis(at)
                again[n] = iv.restated((low, high), m.interval_unit, m.sequential, at)
        missing = {}
        for n in self.graph.order():
            if n in tables and n in wanted:
                left = self.ledger.intervals(tables[n])
                for gone in [again[n]] if n in again else []:
                    left = iv.removed(left, gone)
                missing[n] = self.missing_of(n, tables[n], at, start, end, left)
        return Plan(environment, changes, removed, tables, missing, again, at, self.deployable(changes))

    def apply(self, plan: Plan, days: float | None = None) -> dict[str, list[Outcome]]:
        """Load what is missing, parents first, and let the environment show the result, for so many days if given."""
        for statement in self.before_all:
            self.spark.sql(statement)
        for name, gone in plan.restated.items():
            if name in plan.tables:
                self.ledger.change_intervals(plan.tables[name], lambda i, g=gone: iv.removed(i, g))
        outcomes = self.load(plan.tables, plan.missing, plan.execution)
        prints = {n: vars(f) for n, f in self.fingerprints().items()}
        until = None if days is None else millis(plan.execution) + round(days * 86_400_000)
        queries = {n: m.query for n, m in self.models.items() if isinstance(m.query, str)}
        self.ledger.change_environments(lambda e: e.update({plan.environment: {"tables": plan.tables, "fingerprints": prints, "queries": queries, "finalized": millis(plan.execution), "until": until}}))
        for statement in self.after_all:
            self.spark.sql(statement)
        return outcomes

    def run(self, environment: str = "prod", now: TimeLike | None = None) -> dict[str, list[Outcome]]:
        """Load what became due since the last time; nothing is done twice."""
        shown = self.ledger.environment(environment)
        if shown is None:
            raise KeyError(f"no environment {environment}")
        at = to_datetime(now) if now is not None else datetime.now(UTC)
        self.restate_on_schedule(shown["tables"], at)
        missing = {n: self.missing_of(n, t, at) for n, t in shown["tables"].items() if n in self.models}
        return self.load(shown["tables"], missing, at)

    def restate_on_schedule(self, tables: Mapping[str, str], now: datetime) -> list[str]:
        """Take out of the ledger what models with a restatement schedule, and all below them, must load again."""
        state, done = self.ledger.get("restatements", {}), []
        for name, m in self.models.items():
            if m.restate_cron is None or name not in tables:
                continue
            last = from_millis(state[name]) if name in state else None
            gone = iv.due_restatement(last, Cron(m.restate_cron), now, self.ledger.intervals(tables[name]), m.restate_intervals, m.interval_unit)
            if gone is None:
                continue
            for n in {name, *self.graph.downstream(name)} & set(tables):
                below = self.models[n]
                self.ledger.change_intervals(tables[n], lambda i, g=iv.restated(gone, below.interval_unit, below.sequential, now): iv.removed(i, g))
            state[name] = millis(now)
            done.append(name)
        if done:
            self.ledger.put("restatements", state)
        return done

    def check_intervals(self, environment: str = "prod", now: TimeLike | None = None) -> dict[str, list[iv.Interval]]:
        """What run() would load."""
        shown = self.ledger.environment(environment) or {"tables": {}}
        at = to_datetime(now) if now is not None else datetime.now(UTC)
        return {n: self.missing_of(n, t, at) for n, t in shown["tables"].items() if n in self.models}

    # loading

    def load(self, tables: Mapping[str, str], missing: Mapping[str, list[iv.Interval]], now: datetime) -> dict[str, list[Outcome]]:
        outcomes: dict[str, list[Outcome]] = {}

        def one(name: str) -> None:
            m = self.models[name]
            for signal in m.signals:
                missing_now = iv.ready(todo[name], signal)
                todo[name] = missing_now
            size = m.batch_size if m.kind.incremental else None
            spans = iv.batches(todo[name], size) if m.kind.incremental else [(todo[name][0][0], todo[name][-1][1])] if todo[name] else []
            found = outcomes.setdefault(name, []) if spans else []
            if spans and m.batch_concurrency and not m.sequential and m.kind is Kind.TIME_RANGE:
                # the first batch makes the table, the others replace parts of their own
                found.extend(self.load_span(m, tables, spans[0], now))
                with ThreadPoolExecutor(m.batch_concurrency) as pool:
                    for more in pool.map(lambda s: self.load_span(m, tables, s, now), spans[1:]):
                        found.extend(more)
                return
            for span in spans:
                found.extend(self.load_span(m, tables, span, now))

        todo = {n: list(i) for n, i in missing.items()}
        graph = self.graph.only([n for n in self.graph.order() if todo.get(n)])
        failed, skipped = run_graph(graph, one, self.threads)
        if failed:
            name, error = next(iter(failed.items()))
            raise RuntimeError(f"{name} failed ({error}); skipped: {sorted(skipped)}") from error
        return outcomes

    def frame(self, name: str, tables: Mapping[str, str], span: tuple[datetime, datetime] | None, now: datetime) -> DataFrame:
        """A model's rows as its children see them: its table, or its query where it has none."""
        m = self.models.get(name)
        if m is None:
            return self.spark.table(name)
        if m.kind is Kind.EXTERNAL:
            kind, _, place = m.path.partition(":")
            return self.spark.table(place) if kind == "catalog" else self.spark.read.format(m.arguments.get("format", "parquet")).load(m.path)
        if m.stored:
            if not self.store.exists(tables[name]) and m.columns is not None:
                return self.spark.createDataFrame([], m.columns)
            return self.store.read(tables[name])
        return self.query(m, tables, span, now)

    def rows_of(self, m: Model, made: Any) -> DataFrame:
        """What a model's function gives as a frame: a frame, a pandas frame, or batches of these, which are put together."""
        if isinstance(made, DataFrame):
            return made
        if isinstance(made, pd.DataFrame):
            schema = m.columns if m.columns is not None else pandas_schema(made)
            return typed_values(self.spark, made[schema.names] if m.columns is not None else made, schema)
        batches = [self.rows_of(m, b) for b in made if b is not None and not (isinstance(b, pd.DataFrame) and b.empty)]
        if not batches:
            if m.columns is None:
                raise ValueError(f"{m.name} gives no rows and declares no columns")
            return self.spark.createDataFrame([], m.columns)
        return functools.reduce(DataFrame.unionByName, batches)

    def query(self, m: Model, tables: Mapping[str, str], span: tuple[datetime, datetime] | None, now: datetime, frozen: datetime | None = None) -> DataFrame:
        """The lazy result of a model's query over a range; with `frozen` its SQL's current date and time are that one's."""
        if m.kind is Kind.SEED:
            return seed(self.spark, m.path, m.columns)
        ranged = span if m.kind.incremental else None
        values = {**self.settings, **variables(ranged[0] if ranged else None, ranged[1] if ranged else None, now)}
        if callable(m.query):
            found = self.rows_of(m, m.query(RunContext(self.spark, lambda n: self.frame(n, tables, span, now), values, *(ranged or (None, None)), now)))
        else:
            parents = {p: self.frame(p, tables, span, now) for p in m.parents}
            text = m.query if frozen is None else frozen_times(m.query, frozen)
            for p in parents:
                text = text.replace(f"{{{p}}}", f"{{{p.replace('.', '__')}}}")
            used = {k: v for k, v in values.items() if f":{k}" in text}
            found = self.spark.sql(text, args=used or None, **{p.replace(".", "__"): df for p, df in parents.items()})
        return align(found, m.columns) if m.columns is not None else found

    def load_span(self, m: Model, tables: Mapping[str, str], span: iv.Interval, now: datetime) -> list[Outcome]:
        """Compute one range, write it, check it, and book it."""
        name = tables[m.name]
        low, high = map(from_millis, span)
        for statement in m.before:
            self.spark.sql(statement)
        rows = self.query(m, tables, (low, high), now)
        present = self.store.read(name) if self.store.exists(name) else None
        if present is not None and m.kind.incremental and m.kind is not Kind.HISTORY and not rows.isStreaming:
            self.store.evolve(name, rows.schema, m.on_destructive, m.on_additive)
            present = self.store.read(name)
        found: list[Outcome] = []

        def check(staged: DataFrame) -> None:
            if m.audits:
                found.extend(enforce(self.in_range(m, staged, low, high), m.audits))

        whole = present is not None and "" in self.store.parts(name)
        if m.kind is Kind.TIME_RANGE and m.partition_by_time_column and not whole:
            self.write_range(m, name, rows, low, high, check)
        elif (m.kind is Kind.PARTITION or m.overwrite) and not whole:
            self.store.replace_parts(name, rows, F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in m.partition_by]), check=check)
        elif m.kind is Kind.UNIQUE_KEY:
            merge_load(self.store, name, rows, m.keys, m.when_matched, m.merge_filter, check=check, buckets=m.buckets)
        elif m.kind is Kind.HISTORY:
            # a model leaves versions of missing keys open unless it says otherwise
            history = m.history if m.history.invalidate_hard_deletes is not None else replace(m.history, invalidate_hard_deletes=False)
            history_load(self.store, name, rows, history, now.replace(tzinfo=None), check, m.buckets)
        elif m.kind is Kind.MANAGED:
            merge_stream(rows, self.store, name, m.keys, f"{self.store.files.root}/{name}-progress", [c.removesuffix(" desc") for c in m.arguments.get("order", ())]).awaitTermination()
            if self.store.exists(name):
                check(self.store.read(name))
        elif m.kind is Kind.UNMANAGED and present is not None:
            self.store.append(name, rows, check)
        else:
            self.store.write(name, self.next_state(m, present, rows, low, high, now), m.partition_by, check)
        if self.store.exists(name) and (m.properties or m.comments):
            noted = {**m.properties, **({"comments": dict(m.comments)} if m.comments else {})}
            if self.store.properties(name) != noted:
                self.store.set_properties(name, **noted)
        self.ledger.change_intervals(name, lambda i: iv.merged([*i, span]))
        for statement in m.after:
            self.spark.sql(statement)
        return found

    def write_range(self, m: Model, name: str, rows: DataFrame, low: datetime, high: datetime, check: Callable[[DataFrame], None]) -> None:
        """Replace the parts of a time range: a part holds the rows of one interval unit, or of one value of a text or number."""
        lo, hi = self.time_bounds(m, rows, low, high)
        kind = rows.schema[m.time_column].dataType.simpleString()
        inside = rows.where(F.col(m.time_column).between(lo, hi))
        if kind in ("date", "timestamp", "timestamp_ntz"):
            stamp = m.interval_unit.stamp
            first, last = low.strftime(stamp), (high - timedelta(microseconds=1)).strftime(stamp)
            self.store.replace_parts(name, inside, F.date_format(m.time_column, m.interval_unit.label), lambda p: first <= p <= last, check)
            return
        first, last = literal(low, kind, m.time_format), literal(high - timedelta(microseconds=1), kind, m.time_format)
        convert = str if kind == "string" else int
        self.store.replace_parts(name, inside, F.col(m.time_column).cast("string"), lambda p: first <= convert(p) <= last, check)

    def in_range(self, m: Model, df: DataFrame, low: datetime, high: datetime) -> DataFrame:
        """The rows that a load of the range has made."""
        if m.kind is not Kind.TIME_RANGE:
            return df
        lo, hi = self.time_bounds(m, df, low, high)
        return df.where(F.col(m.time_column).between(lo, hi))

    def time_bounds(self, m: Model, df: DataFrame, low: datetime, high: datetime) -> tuple[Any, Any]:
        kind = df.schema[m.time_column].dataType.simpleString()
        return tuple(F.lit(literal(t, kind, m.time_format)).cast(df.schema[m.time_column].dataType) for t in (low, high - timedelta(microseconds=1)))

    def next_state(self, m: Model, present: DataFrame | None, rows: DataFrame, low: datetime, high: datetime, now: datetime) -> DataFrame:
        if m.kind is Kind.CUSTOM:
            return W.MATERIALIZATIONS[m.custom](present, rows, **m.arguments)
        if m.kind is Kind.TIME_RANGE:
            lo, hi = self.time_bounds(m, rows, low, high)
            return W.overwritten_range(present if present is not None else rows.limit(0), rows, m.time_column, lo, hi)
        if present is None or not m.kind.incremental:
            return W.replaced(present, rows) if present is not None and present.schema == rows.schema else rows
        if m.kind is Kind.PARTITION or m.overwrite:
            return W.overwritten_partitions(present, rows, m.partition_by)
        return W.appended(present, rows)

    # reading and checking

    def table(self, name: str, environment: str = "prod") -> DataFrame:
        """What an environment shows of a model."""
        shown = self.ledger.environment(environment)
        if shown is None:
            raise KeyError(f"no environment {environment}")
        return self.frame(name, shown["tables"], None, datetime.now(UTC))

    def create_views(self, environment: str = "prod") -> list[str]:
        """A temporary view for each model of an environment, named <environment>__<model> (prod: the model's name)."""
        out = []
        for name in self.models:
            view = name.replace(".", "__") if environment == "prod" else f"{environment}__{name.replace('.', '__')}"
            self.table(name, environment).createOrReplaceTempView(view)
            out.append(view)
        return out

    def evaluate(self, name: str, start: TimeLike | None = None, end: TimeLike | None = None, execution: TimeLike | None = None, limit: int | None = None, environment: str = "prod") -> DataFrame:
        """A model's rows for a range, computed now and not written."""
        now = to_datetime(execution) if execution is not None else datetime.now(UTC)
        m = self.models[name]
        tables = (self.ledger.environment(environment) or {"tables": {}})["tables"]
        span = (to_datetime(start, now), exclusive_end(end, now)) if start is not None and end is not None else None
        rows = self.query(m, tables, span, now)
        return rows.limit(limit) if limit is not None else rows

    def fetch(self, sql: str, environment: str = "prod", limit: int | None = None) -> DataFrame:
        """The result of a SQL query over what an environment shows, models being named as in create_views()."""
        self.create_views(environment)
        rows = self.spark.sql(sql)
        return rows.limit(limit) if limit is not None else rows

    def render(self, name: str) -> str:
        """The model's optimized logical plan."""
        return self.evaluate(name)._jdf.queryExecution().optimizedPlan().toString()

    def audit(self, environment: str = "prod", start: TimeLike | None = None, end: TimeLike | None = None) -> dict[str, list[Outcome]]:
        out = {}
        for name, m in self.models.items():
            if m.audits:
                rows = self.table(name, environment)
                if start is not None and end is not None:
                    rows = self.in_range(m, rows, to_datetime(start), exclusive_end(end))
                out[name] = failures(rows, m.audits)
        return out

    def table_diff(self, source: str, target: str, select: Iterable[str] = ("*",), on: Iterable[str] | None = None, decimals: int = 3, where: str | None = None) -> dict[str, RowDiff]:
        """Row diffs of models between two environments; the grain is the join key, models without one are left out."""
        out = {}
        for name in sorted(self.selector().select(*select)):
            keys = list(on or self.models[name].grain)
            if keys:
                out[name] = RowDiff(self.table(name, source), self.table(name, target), keys, decimals, where)
        return out

    def test(self, case: Mapping[str, Any], cte: str | None = None) -> DataFrame:
        """Run a model on given rows: {model, inputs: {name: rows}, expected: rows, ctes: {name: rows}, vars, partial, range}.

        Rows are (rows, schema), a frame, or {"query": SQL}. The result holds missing and unexpected rows; it is empty if
        the test passes. With partial only the expected columns are compared. With `cte` it is the rows of that common
        table expression of the model's SQL that are compared. Current date and time are those of `execution`.
        """
        m = self.models[case["model"]]
        inputs = {n: self.given(rows) for n, rows in case["inputs"].items()}
        now = to_datetime(case.get("execution", "2000-01-01"))
        low, high = case.get("range", ("2000-01-01", "2000-01-01"))
        span = (to_datetime(low), exclusive_end(high))
        trial = Context.__new__(Context)
        trial.__dict__.update(self.__dict__)
        trial.settings = {**self.settings, **case.get("vars", {})}
        trial.frame = lambda name, *_: inputs[name]  # type: ignore[method-assign]
        if cte is not None:
            m = replace(m, query=only_cte(m.query, cte), columns=None)
        actual = trial.query(m, {}, span, now, now)
        expected = self.given(case["expected"] if cte is None else case["ctes"][cte])
        if not case.get("partial"):
            extra = set(actual.columns) - set(expected.columns)
            if extra:
                raise AssertionError(f"unexpected columns {sorted(extra)}")
        return multiset_diff(align(expected, actual.select(expected.columns).schema), actual.select(expected.columns))

    def given(self, rows: Any) -> DataFrame:
        """The rows of a test: a frame, {"query": SQL}, or rows and schema."""
        if isinstance(rows, DataFrame):
            return rows
        return self.spark.sql(rows["query"]) if isinstance(rows, Mapping) else self.spark.createDataFrame(*rows)

    def run_tests(self, cases: Mapping[str, Mapping[str, Any]]) -> dict[str, DataFrame]:
        """The differences of every case, and of every common table expression that one has rows for ('case/cte')."""
        out = {}
        for name, case in cases.items():
            out[name] = self.test(case)
            for cte in case.get("ctes", {}):
                out[f"{name}/{cte}"] = self.test(case, cte)
        return out

    def create_test(self, name: str, limit: int = 10, start: TimeLike = "2000-01-01", end: TimeLike = "2000-01-01", environment: str = "prod") -> dict[str, Any]:
        """A test of a model from present rows: some of each parent's, and what the model makes of them."""
        tables = (self.ledger.environment(environment) or {"tables": {}})["tables"]
        now = datetime.now(UTC)
        parents = {p: self.frame(p, tables, None, now).limit(limit) for p in self.models[name].parents}
        inputs = {p: ([tuple(r) for r in df.collect()], df.schema) for p, df in parents.items()}
        trial = Context.__new__(Context)
        trial.__dict__.update(self.__dict__)
        trial.frame = lambda n, *_: self.spark.createDataFrame(*inputs[n])  # type: ignore[method-assign]
        out = trial.query(self.models[name], {}, (to_datetime(start), exclusive_end(end)), now)
        return {"model": name, "inputs": inputs, "expected": ([tuple(r) for r in out.collect()], out.schema), "range": (start, end)}

    def lineage(self, name: str, environment: str = "prod") -> dict[str, dict[str, set[str]]]:
        """By output column of a model the parents' columns it comes from."""
        tables = (self.ledger.environment(environment) or {"tables": {}})["tables"]
        now = datetime.now(UTC)
        parents = {p: self.frame(p, tables, None, now) for p in self.models[name].parents}
        trial = Context.__new__(Context)
        trial.__dict__.update(self.__dict__)
        trial.frame = lambda n, *_: parents[n]  # type: ignore[method-assign]
        return column_lineage(trial.query(self.models[name], tables, (now, now), now), parents)

    def gaps(self, plan: Plan) -> dict[str, list[iv.Interval]]:
        """Ranges that an environment shows now and would not after a plan with its loads."""
        shown = (self.ledger.environment(plan.environment) or {"tables": {}})["tables"]
        out = {}
        for name, table in plan.tables.items():
            if name in shown and shown[name] != table:
                left = iv.gaps(self.ledger.intervals(shown[name]), [*self.ledger.intervals(table), *plan.missing.get(name, [])])
                if left:
                    out[name] = left
        return out

    def analysis(self, m: Model) -> str | None:
        """The class of the error that analyzing a model's SQL ends with, without what details it; None if it is fine."""
        tables = (self.ledger.environment("prod") or {"tables": {}})["tables"]
        now = datetime.now(UTC)
        if not isinstance(m.query, str):
            return None
        try:
            self.query(m, tables, (now, now), now)
        except PySparkException as e:
            return (e.getCondition() or "").partition(".")[0]
        except KeyError:
            return None
        return None

    def ambiguous_projections(self, m: Model) -> bool:
        """Whether output columns of a model's SQL share a name, or have one that Spark made up from an expression."""
        tables = (self.ledger.environment("prod") or {"tables": {}})["tables"]
        now = datetime.now(UTC)
        if not isinstance(m.query, str):
            return False
        try:
            names = self.query(replace(m, columns=None), tables, (now, now), now).columns
        except (PySparkException, KeyError):
            return False
        return len(set(map(str.lower, names))) < len(names) or any(not re.fullmatch(r"\w+", n) for n in names)

    def lint(self, more: Mapping[str, Callable[[Model], bool]] | None = None, tested: Collection[str] | None = None) -> dict[str, list[str]]:
        """Rules that models break, by model. `more` holds further rules: true for a model that breaks one.

        `tested` are the models that have a test; without it that rule is left out.
        """
        def stars(m: Model) -> bool:
            return isinstance(m.query, str) and "select *" in " ".join(m.query.lower().split())

        rules: dict[str, Callable[[Model], bool]] = {
            "no_select_star": stars,
            "no_missing_audits": lambda m: m.stored and m.kind is not Kind.SEED and not m.audits,
            "no_missing_owner": lambda m: not m.owner,
            "no_missing_grain": lambda m: m.stored and not m.grain,
            "no_missing_unit_test": lambda m: m.kind is not Kind.EXTERNAL and tested is not None and m.name not in tested,
            "invalid_select_star_expansion": lambda m: stars(m) and any(p in self.models and self.models[p].kind is Kind.EXTERNAL and self.models[p].columns is None for p in m.parents),
            "ambiguous_or_invalid_column": lambda m: self.analysis(m) in ("UNRESOLVED_COLUMN", "AMBIGUOUS_REFERENCE", "UNRESOLVED_FIELD"),
            "no_ambiguous_projections": self.ambiguous_projections,
            "no_missing_external_models": lambda m: any(p not in self.models for p in m.parents),
            **(more or {}),
        }
        return {n: found for n, m in self.models.items() if (found := [r for r, broken in rules.items() if broken(m)])}

    # housekeeping

    def create_external_models(self, tables: Iterable[str]) -> list[Model]:
        """Models of catalog tables that no model makes, with their columns as they are."""
        return [Model(t, kind=Kind.EXTERNAL, path=f"catalog:{t}", columns=self.spark.table(t).schema) for t in tables if t not in self.models]

    def expire(self, now: TimeLike | None = None) -> list[str]:
        """Take away the environments whose time is over."""
        at = millis(to_datetime(now) if now is not None else datetime.now(UTC))
        over = [n for n, e in self.ledger.get("environments", {}).items() if e.get("until") is not None and e["until"] <= at]
        for n in over:
            self.invalidate_environment(n)
        return sorted(over)

    def invalidate_environment(self, name: str) -> None:
        self.ledger.change_environments(lambda e: e.pop(name, None))

    def environments(self) -> list[str]:
        return sorted(self.ledger.get("environments", {}))

    def janitor(self) -> list[str]:
        """Delete expired environments, tables that none shows, and old versions of those that one does."""
        self.expire()
        shown = {t for e in self.ledger.get("environments", {}).values() for t in e["tables"].values()}
        gone = [t for t in self.store.files.names() if t not in shown and t.removesuffix("-progress") not in shown and not self.store.in_use(t)]
        for t in gone:
            self.store.drop(t)
            self.ledger.change_intervals(t, lambda _: [])
        for t in shown:
            self.store.vacuum(t)
        return gone
