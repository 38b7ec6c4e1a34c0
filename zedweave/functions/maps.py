"""Small containers: of a reduce's results in Python, or of results that have been brought to the driver."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any


class SingletonMap:
    """One key of weight 1."""

    def __init__(self, key: Any):
        self.key = key

    def items(self) -> Iterator[tuple[Any, Any]]:
        return iter([(self.key, 1)])


class OptionMap:
    """No entry or one."""

    def __init__(self, key: Any = None, value: Any = None):
        self.entry = None if value is None else (key, value)

    def get(self) -> tuple[Any, Any] | None:
        return self.entry

    def items(self) -> Iterator[tuple[Any, Any]]:
        return iter([self.entry] if self.entry else [])


class VecMap:
    """Sorted unique keys."""

    def __init__(self, entries: Iterable[tuple[Any, Any]]):
        self.entries = sorted(entries, key=lambda e: e[0])
        if any(a[0] == b[0] for a, b in zip(self.entries, self.entries[1:])):
            raise ValueError("Duplicate keys")

    def items(self) -> Iterator[tuple[Any, Any]]:
        return iter(self.entries)


def assert_ones(weights: dict[Any, int] | Iterable[tuple[Any, int]]) -> Iterator[Any]:
    """The rows of (row, weight) pairs; fails at a weight that isn't 1."""
    for row, w in weights.items() if isinstance(weights, dict) else weights:
        if w != 1:
            raise ValueError("Not a one")
        yield row
