"""Column names that don't clash."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def unused(df: DataFrame | Iterable[str], *names: str) -> list[str]:
    """The given names, each with as many underscores as it needs to differ from the columns of ``df`` (or from these
    names) and from each other, in any case."""
    taken = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
