"""Names of tables and views: where a version of a model lies, and under which name an environment shows it."""

from __future__ import annotations

import hashlib
import re
from enum import Enum


class Convention(Enum):
    """What of a model's dotted name stands in its table's name before the version."""

    SCHEMA_AND_TABLE = "schema_and_table"
    TABLE_ONLY = "table_only"
    HASH = "hash"


class Target(Enum):
    """Which part of a view's name tells the environment."""

    SCHEMA = "schema"
    TABLE = "table"
    CATALOG = "catalog"


def physical_name(model: str, version: str, convention: Convention = Convention.SCHEMA_AND_TABLE, suffix: str | None = None) -> str:
    """The name of the table of one version: letters, digits and underscores only. A hash is that of the full name."""
    parts = model.split(".")[-1 if convention is Convention.TABLE_ONLY else -2 :]
    name = "__".join([*(re.sub(r"\W", "_", p) for p in parts), version])
    full = f"{name}__{suffix}" if suffix else name
    return f"md5__{hashlib.md5(full.encode()).hexdigest()}" if convention is Convention.HASH else full


def view_name(model: str, environment: str, target: Target = Target.SCHEMA, production: str = "prod", schema: str = "default") -> str:
    """The dotted name under which an environment shows a model; production shows it under its own."""
    *above, table = model.split(".")
    catalog, own = (above[0] if len(above) > 1 else None), (above[-1] if above else schema)
    if environment != production:
        if target is Target.SCHEMA:
            own = f"{own}__{environment}"
        elif target is Target.TABLE:
            table = f"{table}__{environment}"
        elif catalog is None:
            raise ValueError(f"{model} names no catalog")
        else:
            catalog = f"{catalog}__{environment}"
    return ".".join(p for p in (catalog, own, table) if p is not None)
