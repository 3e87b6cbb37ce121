"""Names of the statistic columns in a wide yearly summary."""

from __future__ import annotations

from collections.abc import Iterable

# The statistics of a summary, in column order.
STATS = ("min", "max", "avg")
NAMINGS = ("prefix", "suffix")


def stat_column(stat: str, variable: str, naming: str = "prefix") -> str:
    if naming not in NAMINGS:
        raise ValueError(f"naming must be one of {NAMINGS}, not {naming!r}")
    return f"{stat}_{variable}" if naming == "prefix" else f"{variable}_{stat}"


def stat_columns(variables: Iterable[str], naming: str = "prefix") -> list[str]:
    """The three columns of the first variable, then those of the second, and so on."""
    return [stat_column(stat, variable, naming) for variable in variables for stat in STATS]


def year_column(naming: str = "prefix") -> str:
    return "year" if naming == "prefix" else "Year"
