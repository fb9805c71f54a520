"""Names for inner columns that no input column has."""

from __future__ import annotations

from collections.abc import Iterable


def unused(columns: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as make it new; names are compared as Spark does, without case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
