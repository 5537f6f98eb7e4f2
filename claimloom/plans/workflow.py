"""Stages as a graph of DataFrame functions: each reads the results of those before it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

Stage = Callable[[dict[str, DataFrame]], DataFrame]


@dataclass
class Workflow:
    stages: dict[str, tuple[tuple[str, ...], Stage]] = field(default_factory=dict)

    def add(self, name: str, stage: Stage, *after: str) -> "Workflow":
        if missing := [a for a in after if a not in self.stages]:
            raise ValueError(f"{name} comes after {missing}, which are not there")
        self.stages[name] = (after, stage)
        return self

    def run(self, **given: DataFrame) -> dict[str, DataFrame]:
        """All stages' plans; nothing runs until one is read."""
        out = dict(given)
        for name, (_, stage) in self.stages.items():
            out[name] = stage(out)
        return out


def resolution() -> Workflow:
    """A document's resolution: entities first, then times, from what was recorded. Given mentions, expressions and recorded."""
    from ..operators.resolution import resolve_entities, resolve_times

    return (
        Workflow()
        .add("entities", lambda r: resolve_entities(r["mentions"], r["recorded"]))
        .add("times", lambda r: resolve_times(r["expressions"], r["recorded"]), "entities")
    )
