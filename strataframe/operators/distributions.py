"""Histograms, kernel densities and box statistics per group; rows without a group are a group of their own."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strataframe.operators.describe import QUARTILES, grouped_counts
from strataframe.plans.ordering import exact_quantiles
from strataframe.plans.spread import attach_groups, join_groups


def histogram(df: DataFrame, c: str, group: str, bins: int = 30) -> DataFrame:
    """Density per bin: bins are shared over the pooled range, each group integrates to 1."""
    rows = df.filter(F.col(c).isNotNull()).select(F.col(group).cast("string").alias("group"), F.col(c).alias("v"))
    lo, hi = F.min("v"), F.max("v")
    same = lo == hi
    span = rows.agg(
        F.struct(
            F.when(same, lo - 0.5).otherwise(lo).alias("lo"), F.when(same, hi + 0.5).otherwise(hi).alias("hi")
        ).alias("s")
    ).scalar()
    placed = rows.withColumn("s", span).withColumn(
        "bin",
        F.least(
            F.floor((F.col("v") - F.col("s.lo")) / (F.col("s.hi") - F.col("s.lo")) * bins), F.lit(bins - 1)
        ).cast("int"),
    )
    counts = placed.groupBy("group", "bin").agg(F.count(F.lit(1)).alias("n"), F.first("s").alias("s"))
    sizes = counts.groupBy("group").agg(F.sum("n").alias("size"), F.first("s").alias("s"))
    every = sizes.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("s.hi") - F.col("s.lo")) / bins
    return join_groups(every, counts.drop("s"), ["group", "bin"], "left").select(
        "group",
        "bin",
        (F.col("s.lo") + F.col("bin") * width).alias("left"),
        (F.col("s.lo") + (F.col("bin") + 1) * width).alias("right"),
        F.coalesce("n", F.lit(0)).alias("n"),
        (F.coalesce("n", F.lit(0)) / (F.col("size") * width)).alias("density"),
    )


def kde(
    df: DataFrame, columns: Sequence[str], group: str, grid: int = 200, common_grid: bool = True
) -> DataFrame:
    """Gaussian kernel density on an even grid (Scott's bandwidth), per group and variable.

    The grid spans the pooled range, or each group's own range. Rows collapse to value counts; every
    task adds its counts into one grid vector per group and only those vectors are shuffled.
    """
    return _kde(grouped_counts(df, columns, group, total=False), grid, common_grid)


def _kde(counts: DataFrame, grid: int, common_grid: bool) -> DataFrame:
    # (group, variable) rows only
    spread = counts.groupBy("group", "variable").agg(
        F.sum("n").alias("size"),
        F.min("value").alias("own_lo"),
        F.max("value").alias("own_hi"),
        F.try_divide(F.sum(F.col("n") * F.col("value")), F.sum("n")).alias("mean"),
    )
    shifted = attach_groups(counts, spread, ["group", "variable"], "value")
    squares = shifted.groupBy("group", "variable", "size", "own_lo", "own_hi").agg(
        F.sum(F.col("n") * F.pow(F.col("value") - F.col("mean"), F.lit(2.0))).alias("ss")
    )
    pooled = squares.groupBy("variable").agg(F.min("own_lo").alias("lo"), F.max("own_hi").alias("hi"))
    sd = F.sqrt(F.try_divide(F.col("ss"), F.col("size") - 1))
    plan = squares.join(pooled, "variable").select(
        "group",
        "variable",
        "size",
        (sd * F.pow(F.col("size").cast("double"), F.lit(-0.2))).alias("bandwidth"),
        (F.col("lo") if common_grid else F.col("own_lo")).alias("lo"),
        (F.col("hi") if common_grid else F.col("own_hi")).alias("hi"),
    )
    fed = attach_groups(counts, plan, ["group", "variable"], "value").filter(F.col("bandwidth") > 0)
    partial = fed.mapInPandas(
        _kernel_sums(grid), "group string, variable string, point int, x double, size long, bandwidth double, mass double"
    )
    total = partial.groupBy("group", "variable", "point").agg(
        F.max("x").alias("x"), F.max("size").alias("size"), F.max("bandwidth").alias("bw"), F.sum("mass").alias("mass")
    )
    scale = F.col("size") * F.col("bw") * F.sqrt(F.lit(2.0 * np.pi))
    return total.select("group", "variable", "point", "x", (F.col("mass") / scale).alias("density"))


def _kernel_sums(grid: int, block: int = 4_096):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            for (group, variable), part in batch.groupby(["group", "variable"], sort=False, dropna=False):
                key = (None if pd.isna(group) else group, variable)
                if key not in sums:
                    head = part.iloc[0]
                    step = (head["hi"] - head["lo"]) / (grid - 1)
                    xs = head["lo"] + np.arange(grid) * step
                    sums[key] = [xs, head["size"], head["bandwidth"], np.zeros(grid)]
                xs, _, bandwidth, mass = sums[key]
                values, weights = part["value"].to_numpy(float), part["n"].to_numpy(float)
                for i in range(0, len(values), block):
                    z = (xs[None, :] - values[i : i + block, None]) / bandwidth
                    mass += weights[i : i + block] @ np.exp(-0.5 * z * z)
        for (g, v), (xs, size, bandwidth, mass) in sums.items():
            yield pd.DataFrame(
                {
                    "group": g,
                    "variable": v,
                    "point": np.arange(grid, dtype="int32"),
                    "x": xs,
                    "size": int(size),
                    "bandwidth": bandwidth,
                    "mass": mass,
                }
            )

    return run


def box_stats(df: DataFrame, columns: Sequence[str], group: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the last value within ``reach`` IQRs, and the outlier count."""
    counts = grouped_counts(df, columns, group, total=False)
    quartiles = exact_quantiles(counts, ["group", "variable"], "value", QUARTILES)
    iqr = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - reach * iqr, F.col("q3") + reach * iqr
    value = F.col("value")
    return (
        attach_groups(counts, quartiles, ["group", "variable"], "value")
        .groupBy("group", "variable", *QUARTILES)
        .agg(
            F.min(F.when(value >= low, value)).alias("reach_lo"),
            F.max(F.when(value <= high, value)).alias("reach_hi"),
            F.coalesce(F.sum(F.when((value < low) | (value > high), F.col("n"))), F.lit(0)).alias("outliers"),
        )
        .select(
            "group",
            "variable",
            *QUARTILES,
            F.least("reach_lo", "q1").alias("whisker_lo"),
            F.greatest("reach_hi", "q3").alias("whisker_hi"),
            "outliers",
        )
    )


def violin_stats(df: DataFrame, columns: Sequence[str], group: str, grid: int = 100) -> DataFrame:
    """Density cut to each group's own range, with the quartile lines on every grid row."""
    counts = grouped_counts(df, columns, group, total=False)
    quartiles = exact_quantiles(counts, ["group", "variable"], "value", QUARTILES)
    return join_groups(_kde(counts, grid, common_grid=False), quartiles, ["group", "variable"])
