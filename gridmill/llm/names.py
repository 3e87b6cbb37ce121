"""Names for helper columns."""

from __future__ import annotations

from collections.abc import Iterable


def free_name(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so, whatever the case."""
    used = {column.lower() for column in taken}
    while name.lower() in used:
        name = "_" + name
    return name
