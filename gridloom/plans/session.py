"""A session: named datasets with their steps, undo and redo, joins and alignment between them.

Undo keeps earlier lazy tables, not copies of data."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from ..operators import joins, profile
from ..operators.registry import apply
from .table import Table
from .template import Step, Template


@dataclass(frozen=True)
class Dataset:
    name: str
    source: Table
    table: Table
    steps: tuple[Step, ...] = ()
    past: tuple[tuple[Table, tuple[Step, ...]], ...] = ()
    future: tuple[tuple[Table, tuple[Step, ...]], ...] = ()
    rules: profile.Rules = profile.Rules()

    def apply(self, operation: str, **args) -> Dataset:
        table = apply(self.table, operation, **args)
        return replace(self, table=table, steps=(*self.steps, (operation, args)), past=(*self.past, (self.table, self.steps)), future=())

    def undo(self) -> Dataset:
        if not self.past:
            return self
        table, steps = self.past[-1]
        return replace(self, table=table, steps=steps, past=self.past[:-1], future=(*self.future, (self.table, self.steps)))

    def redo(self) -> Dataset:
        if not self.future:
            return self
        table, steps = self.future[-1]
        return replace(self, table=table, steps=steps, future=self.future[:-1], past=(*self.past, (self.table, self.steps)))

    def reset(self) -> Dataset:
        return replace(self, table=self.source, steps=(), past=(*self.past, (self.table, self.steps)), future=())

    def template(self) -> Template:
        return Template(self.name, self.steps)

    def replay(self, template: Template) -> Dataset:
        """The template's operations on the source table."""
        fresh = self.reset()
        return replace(fresh, table=template.replay(self.source), steps=template.operations)

    def with_rules(self, rules: profile.Rules) -> Dataset:
        return replace(self, rules=rules.checked(self.table.columns))

    def profile(self) -> DataFrame:
        return profile.profile_columns(self.table, self.rules)

    def issues(self) -> DataFrame:
        return profile.quality_issues(self.table, self.rules)


@dataclass
class Session:
    datasets: dict[str, Dataset] = field(default_factory=dict)

    def add(self, name: str, table: Table) -> Dataset:
        unique, n = name, 2
        while unique in self.datasets:
            unique, n = f"{name}_{n}", n + 1
        self.datasets[unique] = Dataset(unique, table, table)
        return self.datasets[unique]

    def update(self, dataset: Dataset) -> Dataset:
        self.datasets[dataset.name] = dataset
        return dataset

    def join(self, left: str, right: str, left_keys: list[str], right_keys: list[str], kind: str = "left", conflict: str = "suffix") -> tuple[Dataset, DataFrame]:
        """A new dataset <left>_merge_<right>, and the report of the join."""
        if left == right:
            raise ValueError("a dataset is not joined with itself")
        a, b = self.datasets[left].table, self.datasets[right].table
        out = joins.join_tables(a, b, left_keys, right_keys, kind, conflict)
        return self.add(f"{left}_merge_{right}", out), joins.join_report(a, b, left_keys, right_keys, kind)

    def fuse(self, primary: str, secondaries: list[str], **request):
        """A new dataset <primary>_fusion and the report; secondaries follow the datasets' order, the primary left out."""
        from ..operators.fusion import Request, fuse

        chosen = [n for n in self.datasets if n in secondaries and n != primary]
        result = fuse(Request(**request), (primary, self.datasets[primary].table), [(n, self.datasets[n].table) for n in chosen])
        return self.add(f"{primary}_fusion", result.table), result.report
