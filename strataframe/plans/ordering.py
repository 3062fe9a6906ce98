"""Exact ranks, running sums and quantiles without sorting a whole group in one task.

Each operator cuts the order into slices, counts per slice (combined map-side), turns the few slice
counts into offsets and finishes inside the slices. A window over a full group never runs on raw rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strataframe.plans.storage import materialise

HASH_DIGITS = 4  # 65,536 slices of an md5 order
SLICE_ROWS = 50_000  # rows of a stored value table that one slice should hold
MAX_CUTS = 8_191  # slice edges of a numeric order, which grow with the table up to here


def hash_order(seed: int, id_col: str) -> Column:
    """The pseudo-random order of a row: a function of seed and id only."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def slot(value: Column, edges: Column, count: int) -> Column:
    """How many of the ascending ``edges`` (at most ``count``) are <= value, by binary search."""
    steps = []
    step = 1
    while step <= count:
        steps.insert(0, step)
        step *= 2
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= F.size(edges)) & (F.get(edges, at + step - 1) <= value), at + step
        ).otherwise(at),
    )
    # never NULL, and declared so: joins on the slot then push no NULL test of it down to the scan
    return F.coalesce(found, F.lit(0))


def group_key(by: Sequence[str]) -> Column:
    """The grouping columns as one struct, which compares equal where NULLs stand in the same places."""
    return F.struct(*by) if by else F.struct(F.lit(1))


def hashed_rank(df: DataFrame, by: Sequence[str], id_col: str, seed: int, rank: str) -> DataFrame:
    """1-based rank of each row within ``by`` in hash order; a NULL group is a group of its own."""
    keyed = df.withColumns({"_hash": hash_order(seed, id_col), "_by": group_key(by)}).withColumn(
        "_slice", F.substring("_hash", 1, HASH_DIGITS)
    )
    sizes = keyed.groupBy("_by", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("_by").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    # at most 16^HASH_DIGITS rows per group, whatever the size of the table
    starts = sizes.select("_by", "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = W.partitionBy("_by", "_slice").orderBy("_hash", id_col)
    return (
        keyed.join(starts, ["_by", "_slice"])
        .withColumn(rank, (F.col("_start") + F.row_number().over(inside)).cast("long"))
        .drop("_hash", "_by", "_slice", "_start")
    )


def hashed_head(
    df: DataFrame, by: str, quotas: Mapping[str, int], id_col: str, seed: int
) -> DataFrame:
    """The first ``quotas[group]`` rows of each group in hash order; groups without a quota give none.

    The row at which a quota is reached is found in its own slice, so the final pass is a plain filter.
    """
    quota = F.lit(0).cast("long")
    for group, n in quotas.items():
        quota = F.when(F.col(by) == F.lit(group), F.lit(int(n)).cast("long")).otherwise(quota)
    keyed = df.withColumn("_hash", hash_order(seed, id_col)).filter(quota > 0)
    slim = keyed.select(by, id_col, "_hash", F.substring("_hash", 1, HASH_DIGITS).alias("_slice"))
    sizes = slim.groupBy(by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(by).orderBy("_slice"))
    reached = (
        sizes.withColumn("_upto", upto)
        .withColumn("_need", quota - (F.col("_upto") - F.col("_n")))
        .filter((F.col("_need") > 0) & (F.col("_upto") >= quota))
        .select(by, "_slice", "_need")
    )
    # one row per group with a quota: bounded by the quota plan itself
    inside = W.partitionBy(by, "_slice").orderBy("_hash", id_col)
    cuts = (
        slim.join(F.broadcast(reached), [by, "_slice"])
        .withColumn("_at", F.row_number().over(inside))
        .filter(F.col("_at") == F.col("_need"))
        .select(by, F.col("_hash").alias("_cut_hash"), F.col(id_col).alias("_cut_id"))
    )
    inside_cut = (F.col("_hash") < F.col("_cut_hash")) | (
        (F.col("_hash") == F.col("_cut_hash")) & (F.col(id_col) <= F.col("_cut_id"))
    )
    return (
        keyed.join(F.broadcast(cuts), by, "left")
        .filter(F.col("_cut_hash").isNull() | inside_cut)
        .drop("_hash", "_cut_hash", "_cut_id")
    )


def range_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], rank: str) -> DataFrame:
    """1-based rank of each row within ``by`` along ``order``, which may hold text. Stored.

    One range sort of the whole table by (by, order), whose slice edges Spark takes from a sample; counts per slice and
    group become offsets. No group is ordered in one task, and ``order`` must tell rows apart, or equal ones are
    ranked in any order. NULL groups are groups of their own.
    """
    keys = [F.col("_by"), *order]
    sliced = df.withColumn("_by", group_key(by)).repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = sliced.withColumn("_row", F.monotonically_increasing_id()).withColumn("_slice", F.spark_partition_id())
    stored = materialise(numbered, "ranked")
    sizes = stored.groupBy("_by", "_slice").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    earlier = W.partitionBy("_by").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    # a row per group and slice: as many as there are groups and slices together
    starts = sizes.select("_by", "_slice", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    at = F.col("_start") + F.col("_row") - F.col("_first") + 1
    return stored.join(starts, ["_by", "_slice"]).withColumn(rank, at).drop("_by", "_slice", "_row", "_first", "_start")


def slice_edges(stored: DataFrame, order: str, slice_rows: int = SLICE_ROWS) -> list[float]:
    """Ascending slice edges: quantiles of the order values over all groups, one for every ``slice_rows`` rows.

    ``stored`` is counted and read once more; what reaches the driver are at most MAX_CUTS numbers.
    """
    cuts = min(MAX_CUTS, stored.count() // slice_rows)
    if cuts == 0:
        return []
    positions = [i / (cuts + 1) for i in range(1, cuts + 1)]
    found = stored.agg(F.percentile_approx(F.col(order).cast("double"), positions, 20 * (cuts + 1))).first()[0]
    return sorted({e for e in found or [] if math.isfinite(e)})


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    sums: Mapping[str, str],
    descending: bool = False,
    totals: Mapping[str, str] | None = None,
    edges: Sequence[float] | None = None,
) -> DataFrame:
    """Inclusive running sums along ``order`` within ``by``; ``sums`` maps source to output column, and ``totals``
    sources to columns with the whole group's sum, taken from the slices as well.

    ``df`` holds one row per (by, order) and is read several times: pass a stored table. A slice of a group holds
    about SLICE_ROWS rows at most however the values are concentrated. No step is keyed by the group alone but the
    one over slice totals. NULL groups are groups of their own.
    """
    totals = totals or {}
    sliced = _sliced(df, by, order, slice_edges(df, order) if edges is None else edges)
    per_slice = sliced.groupBy("_by", "_slice").agg(*[F.sum(s).alias(f"_t_{s}") for s in {*sums, *totals}])
    key = F.col("_slice").desc() if descending else F.col("_slice").asc()
    earlier = W.partitionBy("_by").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    all_slices = W.partitionBy("_by").orderBy(key).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    starts = per_slice.select(
        "_by",
        "_slice",
        *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_s_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(all_slices).alias(out) for s, out in totals.items()],
    )
    within = F.col(order).desc() if descending else F.col(order).asc()
    inside = W.partitionBy("_by", "_slice").orderBy(within).rowsBetween(W.unboundedPreceding, 0)
    return (
        sliced.join(starts, ["_by", "_slice"])
        .withColumns({out: F.col(f"_s_{s}") + F.sum(s).over(inside) for s, out in sums.items()})
        .drop("_by", "_slice", *[f"_s_{s}" for s in sums])
    )


def next_values(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    columns: Mapping[str, str],
    descending: bool = False,
    edges: Sequence[float] | None = None,
) -> DataFrame:
    """The following row's values along ``order`` within ``by`` (NULL on the last row)."""
    sliced = _sliced(df, by, order, slice_edges(df, order) if edges is None else edges)
    within = F.col(order).desc() if descending else F.col(order).asc()
    best = F.max_by if descending else F.min_by
    heads = sliced.groupBy("_by", "_slice").agg(best(F.struct(*columns), order).alias("_head"))
    key = F.col("_slice").desc() if descending else F.col("_slice").asc()
    after = heads.select("_by", "_slice", F.lead("_head").over(W.partitionBy("_by").orderBy(key)).alias("_after"))
    inside = W.partitionBy("_by", "_slice").orderBy(within)
    return (
        sliced.join(after, ["_by", "_slice"])
        .withColumn("_next", F.coalesce(F.lead(F.struct(*columns)).over(inside), F.col("_after")))
        .withColumns({out: F.col("_next")[c] for c, out in columns.items()})
        .drop("_by", "_slice", "_after", "_next")
    )


def value_counts(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Rows collapsed to ``(by, value, n)``; copies of a value combine map-side. NULLs are left out."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("n"))


def exact_quantiles(
    counts: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Linearly interpolated quantiles per group of a stored :func:`value_counts` table."""
    located = running_totals(counts, by, value, {"n": "_upto"}, totals={"n": "_size"})
    picks = []
    for name, p in probs.items():
        spot = F.lit(float(p)) * (F.col("_size") - 1)
        for side, at in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            holds = (at < F.col("_upto")) & (at >= F.col("_upto") - F.col("n"))
            picks.append(F.max(F.when(holds, F.col(value))).alias(f"_{name}_{side}"))
    ends = located.groupBy(*by).agg(F.max("_size").alias("_size"), *picks)
    out = []
    for name, p in probs.items():
        spot = F.lit(float(p)) * (F.col("_size") - 1)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((low + (high - low) * (spot - F.floor(spot))).alias(name))
    return ends.select(*by, *out)


def _sliced(df: DataFrame, by: Sequence[str], order: str, edges: Sequence[float]) -> DataFrame:
    """``_by`` and ``_slice``, the place of ``order`` among the edges; NULL counts as lowest and NaN as highest."""
    keyed = df.withColumn("_by", group_key(by))
    if not edges:
        return keyed.withColumn("_slice", F.lit(0))
    bucketed = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="_order", outputCol="_slice", handleInvalid="keep")
    placed = bucketed.transform(keyed.withColumn("_order", F.col(order).cast("double"))).drop("_order")
    return placed.withColumn("_slice", F.when(F.col(order).isNull(), F.lit(0)).otherwise(F.col("_slice").cast("int")))
