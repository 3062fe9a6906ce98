"""Strata, quotas and reproducible sampling of controls."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from strataframe.operators.joins import anti
from strataframe.plans.ordering import hash_order, hashed_head


def flags_any(df: DataFrame, key: str, preds: Mapping[str, Column]) -> DataFrame:
    """Per key: does any row satisfy each predicate? Rows without a key are left out."""
    flags = [F.bool_or(p).alias(n) for n, p in preds.items()]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*flags)


def flags_where_any(df: DataFrame, key: str, preds: Mapping[str, Column]) -> DataFrame:
    """Like :func:`flags_any` for callers that read an absent key as False: rows that satisfy no
    predicate are dropped before the shuffle."""
    some = F.lit(False)
    for p in preds.values():
        some = some | p
    return flags_any(df.filter(some), key, preds)


def or_flags(*flags: Column) -> Column:
    """Visit-level or history-level evidence; NULL counts as False."""
    found = F.lit(False)
    for flag in flags:
        found = found | F.coalesce(flag, F.lit(False))
    return found


def assign_stratum(lookalike: Column, moderate: Column) -> Column:
    """A: looks like a case by diagnosis; B: not A, but at risk by history or complaint; C: the rest."""
    return F.when(lookalike, "A").when(moderate, "B").otherwise("C")


def plan_quotas(
    pools: Mapping[str, int], n_cases: int, ratio: int = 10, share_a: float = 0.40, share_b: float = 0.35
) -> dict[str, int]:
    """Controls wanted per stratum. Shares round half to even; C takes what A and B leave."""
    target = n_cases * ratio
    quota_a = min(round(target * share_a), pools.get("A", 0))
    quota_b = min(round(target * share_b), pools.get("B", 0))
    quota_c = min(target - quota_a - quota_b, pools.get("C", 0))
    return {"A": quota_a, "B": quota_b, "C": quota_c}


def sample_n(df: DataFrame, by: str, quotas: Mapping[str, int], seed: int, id_col: str) -> DataFrame:
    """A fixed-size sample without replacement per group, a function of (seed, id) only."""
    return hashed_head(df, by, quotas, id_col, seed)


def fill_shortfall(df: DataFrame, picked: DataFrame, target: int, have: int, seed: int, id_col: str) -> DataFrame:
    """Rows drawn from everything not picked yet, up to ``target``; empty when nothing is short."""
    rest = anti(df, picked, id_col).withColumn("_all", F.lit("rest"))
    return hashed_head(rest, "_all", {"rest": max(target - have, 0)}, id_col, seed).drop("_all")


def shuffle(df: DataFrame, seed: int, id_col: str, key: str = "shuffle_key") -> DataFrame:
    """A reproducible random position per row; order by it where an order is wanted."""
    return df.withColumn(key, hash_order(seed, id_col))
