"""Replayable preparation: an ordered list of fitted operations."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from datetime import date, datetime

from pyspark.sql import DataFrame

from plumbline.functions.columns import ROW_ID
from plumbline.functions.lineage import cut_lineage
from plumbline.plans.preparation import Operation, apply, audit, fit


@dataclass(frozen=True)
class Step:
    """A fitted operation and what it did to the table it was fitted on."""

    operation: Operation
    affected_rows: int = 0
    changed_cells: int = 0
    removed_rows: int = 0


@dataclass(frozen=True)
class Recipe:
    """Immutable; every edit returns a new recipe. Applying one is a single lazy plan."""

    steps: tuple[Step, ...] = ()
    target: str | None = None
    row_id: str = ROW_ID

    def __post_init__(self):
        if self.target is not None and any(s.operation.column == self.target for s in self.steps):
            raise ValueError("A transformed column cannot be the target.")

    @classmethod
    def fit(cls, df: DataFrame, operations: list[Operation], target: str | None = None,
            row_id: str = ROW_ID, skip_unchanged: bool = False) -> Recipe:
        """Fit operations one after another. Each fit reads the table as prepared so far;
        after a removal of duplicates, the only step that shuffles the table, that state
        is written once instead of being computed again for every later fit."""
        recipe, current = cls(target=target, row_id=row_id), df
        for position, operation in enumerate(operations, 1):
            try:
                step = recipe._fitted(current, operation)
            except NoChange:
                if not skip_unchanged:
                    raise
                continue
            recipe = replace(recipe, steps=recipe.steps + (step,))
            current = apply(current, step.operation, row_id, target)
            if operation.action == "duplicates" and position < len(operations):
                current = cut_lineage(current)
        return recipe

    def add(self, df: DataFrame, operation: Operation) -> Recipe:
        """Fit one more operation on the original table as prepared so far."""
        return replace(self, steps=self.steps + (self._fitted(self.apply(df), operation),))

    def _fitted(self, current: DataFrame, operation: Operation) -> Step:
        """An operation that changes nothing or would remove every row is refused."""
        fitted = fit(current, operation, self.target, self.row_id)
        counts = audit(current, fitted, self.row_id).first()
        if not counts["affected_rows"]:
            raise NoChange("This operation changes nothing.")
        if counts["removed_rows"] == counts["rows"]:
            raise ValueError("This operation would remove every row.")
        return Step(fitted, counts["affected_rows"], counts["changed_cells"], counts["removed_rows"])

    def apply(self, df: DataFrame) -> DataFrame:
        """The prepared table. Parameters are reused as fitted, on any data; a stream is
        accepted when no step needs the whole table."""
        for step in self.steps:
            df = apply(df, step.operation, self.row_id, self.target)
        return df

    def undo(self) -> Recipe:
        return replace(self, steps=self.steps[:-1])

    def reset(self) -> Recipe:
        return replace(self, steps=())

    def with_target(self, target: str | None) -> Recipe:
        """Another target clears the steps: a prepared feature must not become one."""
        return self if target == self.target else Recipe((), target, self.row_id)

    def records(self) -> list[dict]:
        return [
            {**asdict(s.operation), "affected_rows": s.affected_rows,
             "changed_cells": s.changed_cells, "removed_rows": s.removed_rows}
            for s in self.steps]

    def to_json(self) -> str:
        return json.dumps({"target": self.target, "row_id": self.row_id, "steps": self.records()},
                          ensure_ascii=False, allow_nan=False, default=plain_value)

    @classmethod
    def from_json(cls, body: str) -> Recipe:
        saved = json.loads(body)
        steps = tuple(
            Step(Operation(s["action"], s["column"], s["parameters"]),
                 s["affected_rows"], s["changed_cells"], s["removed_rows"])
            for s in saved["steps"])
        return cls(steps, saved["target"], saved["row_id"])


class NoChange(ValueError):
    """The operation affects no row of the table."""


def plain_value(value):
    """JSON form of a fitted value: dates as ISO text, the rest as text."""
    return value.isoformat() if isinstance(value, (date, datetime)) else str(value)
