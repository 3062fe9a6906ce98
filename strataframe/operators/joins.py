"""Left, semi and anti equi-joins of the study, and appends."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from strataframe.plans.spread import left_join


def left(
    df: DataFrame, other: DataFrame, keys: Sequence[str], spread_on: str, hot_from: DataFrame | None = None
) -> DataFrame:
    """Left join on a composite key; a repeated right key repeats the row. ``hot_from`` names a cheaper table to
    sketch frequent keys from where ``df`` is an expensive plan."""
    return left_join(df, other, keys, spread_on, hot_from)


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that would repeat rows in a left join, for the validation report."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def left_dim(
    df: DataFrame, dim: DataFrame, key: str, suffix: str, spread_on: str, hot_from: DataFrame | None = None
) -> DataFrame:
    """Left join to a dimension; dimension columns that collide get a suffix."""
    clash = {c: f"{c}{suffix}" for c in dim.columns if c != key and c in df.columns}
    return left_join(df, dim.withColumnsRenamed(clash), [key], spread_on, hot_from)


def first_per_key(dim: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first in ``order``. An aggregate, so copies of a key combine map-side."""
    rest = [c for c in dim.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return dim.filter(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, "_row.*")


def left_first(
    df: DataFrame, dim: DataFrame, key: str, order: Sequence[Column | str], suffix: str, spread_on: str
) -> DataFrame:
    return left_dim(df, first_per_key(dim, key, order), key, suffix, spread_on)


def flag_in_keys(
    df: DataFrame,
    keys: DataFrame,
    key: str,
    flag: str,
    spread_on: str,
    hot_from: DataFrame | None = None,
) -> DataFrame:
    """1 where the key occurs in ``keys``, else 0; a NULL key gives 0. Keys are never collected."""
    marks = keys.select(key).filter(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(1))
    joined = left_join(df, marks, [key], spread_on, hot_from)
    return joined.withColumn(flag, F.coalesce(flag, F.lit(0)))


def semi(df: DataFrame, keys: DataFrame, key: str, spread_on: str) -> DataFrame:
    return left_join(df, keys.select(key).distinct(), [key], spread_on, how="left_semi")


def anti(df: DataFrame, picked: DataFrame, row_id: str) -> DataFrame:
    """Rows not picked yet, by row id."""
    return df.join(picked.select(row_id), row_id, "left_anti")


def left_flags(
    df: DataFrame,
    flags: DataFrame,
    key: str,
    spread_on: str,
    hot_from: DataFrame | None = None,
) -> DataFrame:
    """Left join aggregated boolean flags; a key without flags gets False."""
    names = [c for c in flags.columns if c != key]
    joined = left_join(df, flags, [key], spread_on, hot_from)
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in names})


def append(frames: Sequence[DataFrame], drop: Sequence[str] = ()) -> DataFrame:
    """Union by name without the helper columns; columns only some sides have become NULL."""
    kept = [f.drop(*drop) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept)


def split_label(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(label) == 1), df.filter(F.col(label) == 0)


def prefer(a: Column | str, b: Column | str) -> Column:
    """The first source, or the second where the first is NULL."""
    return F.coalesce(a, b)


def override(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Replace columns by others even where those are NULL, then drop the sources."""
    return df.withColumns({c: F.col(s) for c, s in columns.items()}).drop(*columns.values())
