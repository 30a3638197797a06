"""Operators by name, as a program declares its task formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class Registry:
    """Names get numbers from 1 on; 0 is the null format, which does nothing."""

    def __init__(self) -> None:
        self._names: list[str] = ["null"]
        self._functions: dict[int, dict[str, Callable[..., DataFrame]]] = {0: {}}

    def put(self, name: str) -> int:
        if name in self._names:
            return self._names.index(name)
        self._names.append(name)
        self._functions[len(self._names) - 1] = {}
        return len(self._names) - 1

    def set(self, number: int, function: Callable[..., DataFrame], target: str = "host") -> None:
        self._functions[number][target] = function

    def get(self, number: int) -> tuple[str, dict[str, Callable[..., DataFrame]]]:
        return self._names[number], dict(self._functions[number])

    def run(self, number: int, *args: object, target: str = "host", **more: object) -> DataFrame:
        """Call the function for the target, else that for the host."""
        own = self._functions[number]
        if target not in own and "host" not in own:
            raise KeyError(f"{self._names[number]} has no function for {target} or host")
        return (own.get(target) or own["host"])(*args, **more)
