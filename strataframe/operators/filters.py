"""Row filters and the named validation rule list."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from strataframe.operators.joins import repeated_keys
from strataframe.plans.storage import materialise

# Inclusive plausibility ranges; a missing value passes.
VITAL_RANGES = {
    "temperature": (95, 105),
    "heartrate": (40, 200),
    "resprate": (8, 40),
    "o2sat": (70, 100),
    "sbp": (70, 250),
    "dbp": (40, 150),
}
ACUITY_RANGE = {"acuity": (1, 5)}
AGE_RANGE = (0, 120)


def in_range(c: str, lo: float, hi: float) -> Column:
    return F.col(c).between(lo, hi)


def in_range_or_null(c: str, lo: float, hi: float) -> Column:
    return F.col(c).isNull() | in_range(c, lo, hi)


def keep_in(df: DataFrame, c: str, values: Sequence[object]) -> DataFrame:
    return df.filter(F.col(c).isin(list(values)))


def keep_range(df: DataFrame, c: str, lo: float, hi: float) -> DataFrame:
    return df.filter(in_range(c, lo, hi))


def keep_range_or_null(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    for c, (lo, hi) in ranges.items():
        df = df.filter(in_range_or_null(c, lo, hi))
    return df


def keep_ordered(df: DataFrame, before: str, after: str) -> DataFrame:
    return df.filter(F.col(before) < F.col(after))


def study_rules(label: str = "ie_label") -> dict[str, Column]:
    """The cohort's validation rules by name; a rule that yields NULL fails the row."""
    rules = {
        "label": F.col(label).isin(0, 1),
        "gender": F.col("gender").isin("M", "F"),
        "age": in_range("anchor_age", *AGE_RANGE),
    }
    for c, (lo, hi) in {**VITAL_RANGES, **ACUITY_RANGE}.items():
        rules[c] = in_range_or_null(c, lo, hi)
    rules["stay_order"] = F.col("intime") < F.col("outtime")
    return rules


def validate(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that satisfy every rule, in one filter."""
    keep = F.lit(True)
    for rule in rules.values():
        keep = keep & F.coalesce(rule, F.lit(False))
    return df.filter(keep)


REPEATED_KEYS = "repeated_keys"


def _rule_counts(rules: Mapping[str, Column]) -> list[Column]:
    held = {n: F.coalesce(r, F.lit(False)) for n, r in rules.items()}
    sums, before = [], F.lit(True)
    for name, ok in held.items():
        sums.append(F.count_if(~ok).alias(f"{name}|failed"))
        sums.append(F.count_if(before & ~ok).alias(f"{name}|dropped"))
        before = before & ok
    return sums


def store_validated(df: DataFrame, rules: Mapping[str, Column], key: str, name: str = "validated") -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy every rule, stored, and the report of :func:`rule_report` from the pass that wrote them.

    The counts are metrics observed on the way to storage, so ``df`` is run once, however expensive it is. The report
    ends with ``repeated_keys``: rows beyond the first of their ``key``, which no rule drops, among the stored ones.
    """
    seen = Observation()
    counts = _rule_counts(rules)
    stored = materialise(validate(df.observe(seen, *counts), rules), name)
    found = {n: [int(seen.get[f"{n}|{kind}"]) for kind in ("failed", "dropped")] for n in rules}
    repeated = repeated_keys(stored, [key]).agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))).first()[0]
    rows = [(n, *v) for n, v in found.items()] + [(REPEATED_KEYS, int(repeated), 0)]
    return stored, df.sparkSession.createDataFrame(rows, "rule string, failed long, dropped long")


def rule_report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Per rule: rows that fail it, and rows it is the first to drop. One pass."""
    held = list(rules)
    wide = df.agg(*_rule_counts(rules))
    rows = wide.unpivot([], [f"{n}|{k}" for n in held for k in ("failed", "dropped")], "cell", "n")
    parts = F.split("cell", r"\|")
    return (
        rows.groupBy(parts[0].alias("rule"))
        .agg(
            F.max(F.when(parts[1] == "failed", F.col("n"))).alias("failed"),
            F.max(F.when(parts[1] == "dropped", F.col("n"))).alias("dropped"),
        )
    )
