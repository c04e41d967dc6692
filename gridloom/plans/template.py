"""Pipelines as JSON: a list of operations that can be replayed on another table in one lazy plan.

An operation without fields is its name; one with fields is {"Name": {"field": value}}.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import UTC, datetime

from ..operators import aggregates, columns, ordering, rows, values  # noqa: F401  they register their operations
from ..operators.registry import OPERATIONS, apply, fields
from .table import Table

Step = tuple[str, dict]


def encode(step: Step) -> str | dict:
    """Parameters that only Python needs a trailing underscore for lose it."""
    name, args = step
    return {name: {k.rstrip("_"): v for k, v in args.items()}} if args else name


def decode(item: str | dict) -> Step:
    name, args = (item, {}) if isinstance(item, str) else next(iter(item.items()))
    if name not in OPERATIONS:
        raise ValueError(f"no operation {name!r}")
    known = fields(name)
    return name, {f"{k}_" if f"{k}_" in known else k: v for k, v in args.items()}


@dataclass(frozen=True)
class Template:
    dataset_name: str
    operations: tuple[Step, ...]
    created_at: str = field(default_factory=lambda: datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S"))

    def to_json(self) -> str:
        return json.dumps({"dataset_name": self.dataset_name, "created_at": self.created_at, "operations": [encode(s) for s in self.operations]}, ensure_ascii=False, indent=2)

    @classmethod
    def from_json(cls, text: str) -> Template:
        x = json.loads(text)
        return cls(x["dataset_name"], tuple(decode(s) for s in x["operations"]), x["created_at"])

    def replay(self, table: Table) -> Table:
        for i, (name, args) in enumerate(self.operations):
            try:
                table = apply(table, name, **args)
            except ValueError as e:
                raise ValueError(f"step {i + 1}, {name}: {e}") from e
        return table
