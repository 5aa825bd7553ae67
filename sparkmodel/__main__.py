"""Command line: python -m sparkmodel PROJECT.py COMMAND ... - a project file defines `models` (or uses @model) and may set `root`."""

from __future__ import annotations

import argparse
import json
import runpy
from pathlib import Path

from sparkmodel.plans.cases import case_text, load_cases
from sparkmodel.plans.contexts import Context
from sparkmodel.plans.models import MODELS
from sparkmodel.session import build_session


SAMPLE = '''"""A project: models, and where their tables lie (root)."""

from sparkmodel.plans.models import Kind, Model

models = [
    Model("raw", "SELECT * FROM VALUES (DATE'2024-05-01', 1), (DATE'2024-05-02', 2) AS t(day, v)", kind=Kind.EMBEDDED),
    Model("daily", "SELECT day, sum(v) AS total FROM {raw} WHERE day BETWEEN :start_date AND :end_date GROUP BY day", kind=Kind.TIME_RANGE, time_column="day", start="2024-05-01", grain=["day"]),
]
'''


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sparkmodel", description=__doc__)
    parser.add_argument("project")
    parser.add_argument("--root")
    parser.add_argument("--environment", default="prod")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("plan", "apply"):
        p = commands.add_parser(name)
        p.add_argument("--start")
        p.add_argument("--end")
        p.add_argument("--now")
        p.add_argument("--restate", action="append", default=[])
        p.add_argument("--select", action="append", default=[])
    for name in ("run", "check-intervals"):
        commands.add_parser(name).add_argument("--now")
    p = commands.add_parser("evaluate")
    p.add_argument("model")
    p.add_argument("--start")
    p.add_argument("--end")
    p.add_argument("--limit", type=int, default=20)
    commands.add_parser("render").add_argument("model")
    p = commands.add_parser("table-diff")
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--select", action="append")
    commands.add_parser("fetch").add_argument("sql")
    commands.add_parser("invalidate").add_argument("name")
    commands.add_parser("table-name").add_argument("model")
    p = commands.add_parser("test")
    p.add_argument("files", nargs="+", help="YAML files of cases")
    p = commands.add_parser("create-test")
    p.add_argument("model")
    p.add_argument("--limit", type=int, default=10)
    commands.add_parser("create-external-models").add_argument("tables", nargs="+")
    for name in ("state-export", "state-import"):
        commands.add_parser(name).add_argument("file")
    for name in ("audit", "lint", "dag", "environments", "janitor", "info", "diff", "init", "migrate", "rollback", "clean", "destroy"):
        commands.add_parser(name)
    args = parser.parse_args(argv)

    if args.command == "init":
        if Path(args.project).exists():
            parser.error(f"{args.project} exists")
        Path(args.project).write_text(SAMPLE)
        return 0
    found = runpy.run_path(args.project)
    models = found.get("models") or list(MODELS.values())
    root = args.root or found.get("root") or f"file://{Path(args.project).resolve().parent}/.state"
    ctx = Context(build_session(), root, models, found.get("settings"))
    if args.command in ("plan", "apply"):
        plan = ctx.plan(args.environment, args.start, args.end, args.restate, args.select, args.now)
        print("\n".join(plan.explain()))
        if args.command == "apply":
            ctx.apply(plan)
    elif args.command == "run":
        print("\n".join(f"{n}: {len(o)} audits" for n, o in ctx.run(args.environment, args.now).items()))
    elif args.command == "check-intervals":
        print("\n".join(f"{n}: {len(i)}" for n, i in ctx.check_intervals(args.environment, args.now).items()))
    elif args.command == "evaluate":
        ctx.evaluate(args.model, args.start, args.end, limit=args.limit, environment=args.environment).show(args.limit, truncate=False)
    elif args.command == "render":
        print(ctx.render(args.model))
    elif args.command == "table-diff":
        for name, diff in ctx.table_diff(args.source, args.target, args.select or ["*"]).items():
            print(name)
            diff.summary().show(vertical=True)
    elif args.command == "fetch":
        ctx.fetch(args.sql, args.environment).show(truncate=False)
    elif args.command == "invalidate":
        ctx.invalidate_environment(args.name)
    elif args.command == "audit":
        outcomes = ctx.audit(args.environment)
        print("\n".join(f"{n}: {o.audit.name} {o.count}" for n, os in outcomes.items() for o in os))
        return int(any(not o.passed and o.audit.blocks for os in outcomes.values() for o in os))
    elif args.command == "lint":
        print("\n".join(f"{n}: {', '.join(r)}" for n, r in ctx.lint().items()))
    elif args.command == "dag":
        print("\n".join(f"{n} <- {', '.join(sorted(ctx.graph.parents[n]))}" for n in ctx.graph.order()))
    elif args.command == "environments":
        print("\n".join(ctx.environments()))
    elif args.command == "janitor":
        print("\n".join(ctx.janitor()))
    elif args.command == "diff":
        changes, removed = ctx.diff(args.environment)
        print("\n".join([*(f"{c.name}: {c.category.value}" for c in changes), *(f"{n}: removed" for n in removed)]))
    elif args.command == "table-name":
        print(((ctx.ledger.environment(args.environment) or {}).get("tables", {})).get(args.model, "none"))
    elif args.command == "test":
        cases = {n: c for f in args.files for n, c in load_cases(Path(f).read_text(), ctx.models).items()}
        differing = {n: rows for n, rows in ctx.run_tests(cases).items() if not rows.isEmpty()}
        for name, rows in differing.items():
            print(name)
            rows.show(truncate=False)
        print(f"{len(cases)} cases, {len(differing)} differ")
        return int(bool(differing))
    elif args.command == "create-test":
        print(case_text(f"test_{args.model}", ctx.create_test(args.model, args.limit, environment=args.environment)))
    elif args.command == "create-external-models":
        print("\n".join(f"{m.name}: {m.columns.simpleString()}" for m in ctx.create_external_models(args.tables)))
    elif args.command == "state-export":
        Path(args.file).write_text(json.dumps(ctx.ledger.dump(), indent=1, sort_keys=True))
    elif args.command == "state-import":
        ctx.ledger.load(json.loads(Path(args.file).read_text()))
    elif args.command == "migrate":
        ctx.ledger.load(ctx.ledger.dump())
    elif args.command == "rollback":
        print("\n".join(ctx.ledger.rollback()))
    elif args.command == "clean":
        for name in {t for e in ctx.ledger.get("environments", {}).values() for t in e["tables"].values()}:
            print("\n".join(f"{name}/{d}" for d in ctx.store.vacuum(name, keep_previous=False)))
    elif args.command == "destroy":
        for name in ctx.environments():
            ctx.invalidate_environment(name)
        print("\n".join(ctx.janitor()))
    else:
        print(f"{len(ctx.models)} models, {len(ctx.environments())} environments, root {root}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
