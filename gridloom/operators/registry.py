"""The catalogue of operations: each a function from an ordered table to an ordered table, under its JSON name."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from ..plans.table import Table

OPERATIONS: dict[str, Callable[..., Table]] = {}


def operation(name: str):
    """Registers a function under the name that templates use; its keyword parameters are the operation's fields."""

    def put(f: Callable[..., Table]) -> Callable[..., Table]:
        OPERATIONS[name] = f
        return f

    return put


def fields(name: str) -> list[str]:
    return list(inspect.signature(OPERATIONS[name]).parameters)[1:]


def apply(table: Table, name: str, /, **args) -> Table:
    if name not in OPERATIONS:
        raise ValueError(f"no operation {name!r}")
    known = fields(name)
    if unknown := set(args) - set(known):
        raise ValueError(f"{name} has no field {', '.join(sorted(unknown))}")
    return OPERATIONS[name](table, **args)


def filled(value: str, what: str) -> str:
    """A trimmed argument, which must not be blank."""
    if not value or not value.strip():
        raise ValueError(f"{what} must not be blank")
    return value.strip()
