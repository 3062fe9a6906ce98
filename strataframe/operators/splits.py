"""Class weights and cross-validation folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strataframe.plans.ordering import hashed_rank


def _sizes(df: DataFrame, label: str, need_cases: bool = False) -> Column:
    case = F.col(label) == 1
    pos = F.count_if(case)
    if need_cases:
        undefined = F.raise_error(F.lit("no cases: the positive weight is undefined")).cast("long")
        pos = F.when(pos > 0, pos).otherwise(undefined)
    return df.agg(F.struct(pos.alias("pos"), F.count_if(~case).alias("neg")).alias("s")).scalar()


def balanced_weights(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """``n / (2 * size of the row's class)``; the weights add up to n."""
    size = F.when(F.col(label) == 1, F.col("_s.pos")).otherwise(F.col("_s.neg"))
    total = F.col("_s.pos") + F.col("_s.neg")
    return df.withColumn("_s", _sizes(df, label)).withColumn(weight, total / (2.0 * size)).drop("_s")


def pos_weight(df: DataFrame, label: str, weight: str = "weight", full: DataFrame | None = None) -> DataFrame:
    """Controls per case of the full set on cases, 1 on controls. A set without cases is an error."""
    ratio = F.col("_s.neg") / F.col("_s.pos")
    sized = df.withColumn("_s", _sizes(full if full is not None else df, label, need_cases=True))
    return sized.withColumn(weight, F.when(F.col(label) == 1, ratio).otherwise(F.lit(1.0))).drop("_s")


def stratified_folds(df: DataFrame, label: str, k: int, seed: int, id_col: str, fold: str = "fold") -> DataFrame:
    """Fold 0..k-1 per row: class sizes per fold differ by at most one, and depend on (seed, id) only."""
    ranked = hashed_rank(df, [label], id_col, seed, "_rank")
    return ranked.withColumn(fold, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")
