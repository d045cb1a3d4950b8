"""Declared builds: what is read, done, checked and written. Plain driver-side records."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Check:
    """One data-quality check. Which fields matter depends on ``type``; see ``quality.checks``."""

    name: str = "unnamed_check"
    type: str = ""
    severity: str | None = None  # error or warn; None takes the default of the type
    columns: tuple[str, ...] = ()
    threshold: float = 0.0
    min_rows: int = 0
    max_rows: int | None = None  # None means no upper bound
    timestamp_column: str | None = None
    max_age_hours: float = 24.0
    predicate: str | None = None
    values: tuple[Any, ...] = ()
    parent: str | None = None
    parent_column: str | None = None

    @classmethod
    def of(cls, entry: Check | Mapping[str, Any]) -> Check:
        if isinstance(entry, Check):
            return entry
        known = {f.name for f in dataclasses.fields(cls)}
        unknown = set(entry) - known
        if unknown:
            raise ValueError(f"unknown check settings: {', '.join(sorted(unknown))}")
        lists = {k: tuple(v) for k, v in entry.items() if k in ("columns", "values")}
        return cls(**{**entry, **lists})


@dataclass(frozen=True)
class Spec:
    """A table build: sources, steps, checks and target."""

    name: str = "unnamed_build"
    description: str = ""
    source_tables: tuple[str, ...] = ()
    transformations: tuple[Mapping[str, Any], ...] = ()
    target_table: str = ""
    schedule: str | None = None
    quality_checks: tuple[Check, ...] = ()
    notifications: tuple[str, ...] = ()

    @classmethod
    def of(cls, entry: Mapping[str, Any]) -> Spec:
        return cls(
            name=entry.get("name", cls.name), description=entry.get("description", ""),
            source_tables=tuple(entry.get("source_tables", ())),
            transformations=tuple(entry.get("transformations", ())),
            target_table=entry.get("target_table", ""), schedule=entry.get("schedule"),
            quality_checks=tuple(Check.of(c) for c in entry.get("quality_checks") or ()),
            notifications=tuple(entry.get("notifications") or ()))
