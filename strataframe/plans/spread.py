"""Equi-joins whose large side may hold NULL keys or a few very frequent keys.

A hash join sends every NULL key, and every copy of one key, to a single task. Both are spread here:
rows with a NULL key get a salt because they match nothing anyway, and rows with a frequent key get a
salt while the matching rows of the other side are repeated once per salt. Which keys are frequent comes
from a bounded sketch; a key the sketch misses is joined unsalted, so the result never depends on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

SALT_ROWS = 1_000_000  # rows of one key that a task may well get
MAX_SALTS = 10_000  # bounds how often a row of the other side is repeated
SKETCH_SIZE = 400
SKETCH_TRACKED = 4_000


def frequent_keys(df: DataFrame, keys: Sequence[str], salt_rows: int = SALT_ROWS) -> Column:
    """Number of salts per frequent key (by key hash), as a scalar-subquery map of at most SKETCH_SIZE."""
    hashed = df.select(F.when(_all_present(keys), F.xxhash64(*keys)).alias("_h"))
    sketch = hashed.filter(F.col("_h").isNotNull()).agg(
        F.expr(f"approx_top_k(_h, {SKETCH_SIZE}, {SKETCH_TRACKED})").alias("top")
    )
    found = F.coalesce("top", F.array().cast("array<struct<item:bigint,count:bigint>>"))
    hot = F.filter(found, lambda t: t["count"] >= F.lit(2 * salt_rows))
    salts = F.transform(
        hot,
        lambda t: F.struct(t["item"], F.least(F.ceil(t["count"] / F.lit(salt_rows)), F.lit(MAX_SALTS)).cast("int")),
    )
    return sketch.select(F.map_from_entries(salts).alias("hot")).scalar()


def left_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread_on: str,
    hot_from: DataFrame | None = None,
    salt_rows: int = SALT_ROWS,
    how: str = "left",
) -> DataFrame:
    """Left (or left semi / anti) equi-join that survives NULL-heavy and skewed keys.

    ``spread_on`` names a left column with many distinct values; ``hot_from`` names the table to sketch
    the keys from when ``left`` is itself an expensive plan. A key that contains ``spread_on`` is already
    spread and is joined as it is.
    """
    if spread_on in keys:
        return left.join(right, list(keys), how)
    hot = frequent_keys(hot_from if hot_from is not None else left, keys, salt_rows)
    types = {f.name: f.dataType for f in left.schema.fields}
    right = right.withColumns({k: F.col(k).cast(types[k]) for k in keys})

    salts = F.coalesce(F.try_element_at(hot, F.xxhash64(*keys)), F.lit(1))
    place = F.xxhash64(spread_on)
    salted = left.withColumn(
        # NULL keys match nothing: negative salts spread them over all tasks
        "_salt",
        F.when(_all_present(keys), F.pmod(place, salts)).otherwise(F.lit(-1) - F.pmod(place, F.lit(1 << 20))),
    )
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts.cast("long") - 1)))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def attach_groups(rows: DataFrame, per_group: DataFrame, keys: Sequence[str], spread_on: str, salts: int = 64) -> DataFrame:
    """``rows`` with the columns of ``per_group``, which has one row per group.

    A group with very many rows is spread over ``salts`` tasks by ``spread_on``, the group's row being repeated once
    per salt. NULL keys are groups of their own; rows without a group in ``per_group`` are dropped.
    """
    key = F.struct(*keys)
    salted = rows.withColumns({"_by": key, "_salt": F.pmod(F.xxhash64(spread_on), F.lit(salts)).cast("int")})
    copies = per_group.withColumns({"_by": key, "_salt": F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))}).drop(*keys)
    return salted.join(copies, ["_by", "_salt"]).drop("_by", "_salt")


def join_groups(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join of two tables that describe groups; a NULL key is a group like any other and meets its like."""
    left, right = a.withColumn("_by", F.struct(*keys)), b.withColumn("_by", F.struct(*keys)).drop(*keys)
    return left.join(right, "_by", how).drop("_by")


def _all_present(keys: Sequence[str]) -> Column:
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()
    return present
