"""Column names that no input column has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(docs: DataFrame, *wanted: str) -> list[str]:
    """Each wanted name with underscores before it, as many as make it differ from all columns of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out
