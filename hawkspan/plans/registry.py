"""Detections by id with declared, type-checked parameters."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from types import SimpleNamespace

from pyspark.sql import DataFrame

from hawkspan.operators.windows import HourlyWindows, OneWindow

# Leading columns of every finding.
COMMON_COLUMNS = ("detection_id", "severity", "src", "dst", "dst_port", "first_seen", "last_seen", "score", "summary")


@dataclass(frozen=True)
class Detection:
    id: str
    title: str
    techniques: tuple[str, ...]
    params: Mapping[str, tuple[type, object]]
    tables: tuple[str, ...]
    plan: Callable[..., DataFrame] = field(repr=False)

    def resolve(self, overrides: Mapping[str, object]) -> SimpleNamespace:
        unknown = sorted(set(overrides) - set(self.params))
        if unknown:
            raise KeyError(f"{self.id} has no parameter {', '.join(unknown)}")
        return SimpleNamespace(**{name: _typed(self.id, name, kind, overrides.get(name, default)) for name, (kind, default) in self.params.items()})

    def __call__(self, tables: Mapping[str, DataFrame], start, end, as_of, **overrides) -> DataFrame:
        """Findings of the window ``[start, end)``; exceptions are judged at ``as_of``."""
        return self._found(tables, OneWindow(start, end), as_of, overrides)

    def hourly(self, tables: Mapping[str, DataFrame], first, last, as_of, hours: int = 24, **overrides) -> DataFrame:
        """Findings of every window of ``hours`` that ends on a full hour from ``first`` to ``last``, with its end in front, in one job."""
        return self._found(tables, HourlyWindows(first, last, hours), as_of, overrides)

    def _found(self, tables: Mapping[str, DataFrame], scope, as_of, overrides: Mapping[str, object]) -> DataFrame:
        missing = [t for t in self.tables if t not in tables]
        if missing:
            raise KeyError(f"{self.id} needs table {', '.join(missing)}")
        return self.plan(tables, scope, as_of, self.resolve(overrides))


def _typed(detection_id: str, name: str, kind: type, value: object) -> object:
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if kind is tuple and isinstance(value, list):
        return tuple(value)
    if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
        raise TypeError(f"{detection_id}: {name} must be {kind.__name__}, got {value!r}")
    return value


REGISTRY: dict[str, Detection] = {}


def detection(detection_id: str, title: str, techniques: tuple[str, ...], tables: tuple[str, ...], **defaults):
    """Register a plan; parameter types follow from the defaults, ``None`` is not a default."""
    for name, value in defaults.items():
        if value is None:
            raise ValueError(f"{detection_id}: parameter {name} needs a default")

    def register(plan: Callable[..., DataFrame]) -> Detection:
        if detection_id in REGISTRY:
            raise ValueError(f"{detection_id} is registered twice")
        found = Detection(detection_id, title, techniques, {n: (type(v), v) for n, v in defaults.items()}, tables, plan)
        REGISTRY[detection_id] = found
        return found

    return register


def listing() -> list[dict[str, object]]:
    """What can be run and with which parameters."""
    return [
        {"id": d.id, "title": d.title, "techniques": list(d.techniques), "params": {n: v for n, (_, v) in d.params.items()}}
        for _, d in sorted(REGISTRY.items())
    ]
