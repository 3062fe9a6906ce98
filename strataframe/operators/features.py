"""Imputation, encoding, alignment and scaling of feature columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

from strataframe.functions.casts import fill_features, reverse_ordinal
from strataframe.functions.text import COMPLAINT_CATEGORIES, multi_hot
from strataframe.plans.ordering import exact_quantiles, range_rank, value_counts
from strataframe.plans.spread import left_join
from strataframe.plans.storage import materialise

# Feature column groups in matrix order.
CONTINUOUS = ["anchor_age", "temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp"]
ORDINAL = "esi_ordinal"
OPTIONS = {
    "Option1_Categorical": ("categories",),
    "Option2_PCA_Embeddings": ("pca",),
    "Option3_Hybrid": ("categories", "pca"),
    "Option4_No_CC": (),
}


def median_impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL becomes the exact interpolated median of the column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "variable", "value"
    )
    counts = materialise(value_counts(long, ["variable"], "value"), "values")
    medians = exact_quantiles(counts, ["variable"], "value", {"median": 0.5})
    row = medians.agg(
        F.struct(*[F.max(F.when(F.col("variable") == c, F.col("median"))).alias(c) for c in columns]).alias("m")
    ).scalar()
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col("_m")[c]) for c in columns}
    return df.withColumn("_m", row).withColumns(filled).drop("_m")


def mode_impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL becomes the most frequent value, the smallest on ties."""
    for c in columns:
        counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        top = counts.agg(F.min_by(c, F.struct(-F.col("n"), F.col(c)))).scalar()
        df = df.withColumn(f"_mode_{c}", top)
    filled = {c: F.coalesce(F.col(c), F.col(f"_mode_{c}")) for c in columns}
    return df.withColumns(filled).drop(*[f"_mode_{c}" for c in columns])


# --- the same by cross-validation fold: what a fold's held-out rows must not tell ---------------------

WITHOUT = "without"  # the fold that a row's statistics leave out


def _training_counts(counts: DataFrame, by: Sequence[str], fold: str, folds: int) -> DataFrame:
    """Counts ``n`` per (by, fold) turned into ``n`` per (by, ``without``): the total less one fold, where anything is left."""
    per = counts.groupBy(*by).agg(F.sum("n").alias("_all"), F.map_from_entries(F.collect_list(F.struct(fold, "n"))).alias("_of"))
    each = per.withColumn(WITHOUT, F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    left = F.col("_all") - F.coalesce(F.try_element_at("_of", F.col(WITHOUT)), F.lit(0))
    return each.withColumn("n", left).filter(F.col("n") > 0).select(WITHOUT, *by, "n")


def fold_medians(df: DataFrame, columns: Sequence[str], fold: str, folds: int) -> DataFrame:
    """``(without, variable, median)``: exact medians of all rows outside each fold, from one pass over the rows.

    Values are counted per fold once; a fold's training counts are the total's less its own.
    """
    long = df.select(F.col(fold).cast("int").alias("fold"), *[F.col(c).cast("double").alias(c) for c in columns])
    long = long.unpivot(["fold"], list(columns), "variable", "value")
    counts = _training_counts(value_counts(long, ["variable", "fold"], "value"), ["variable", "value"], "fold", folds)
    return exact_quantiles(materialise(counts, "fold_values"), [WITHOUT, "variable"], "value", {"median": 0.5})


def fold_modes(df: DataFrame, columns: Sequence[str], fold: str, folds: int) -> DataFrame:
    """``(without, variable, mode)``: the most frequent value outside each fold, the smallest on ties."""
    long = df.select(F.col(fold).cast("int").alias("fold"), *[F.col(c).cast("string").alias(c) for c in columns])
    long = long.unpivot(["fold"], list(columns), "variable", "value")
    counts = _training_counts(value_counts(long, ["variable", "fold"], "value"), ["variable", "value"], "fold", folds)
    return counts.groupBy(WITHOUT, "variable").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))


def by_fold(df: DataFrame, folds: int) -> DataFrame:
    """Every row once for each fold that may be left out, as ``without``."""
    return df.withColumn(WITHOUT, F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))


def fill_by_fold(rows: DataFrame, statistics: DataFrame, value: str, columns: Sequence[str]) -> DataFrame:
    """NULLs of :func:`by_fold` rows filled with their fold's training statistic (without, variable, ``value``)."""
    cell = F.struct(F.concat_ws("|", F.col(WITHOUT).cast("string"), "variable"), value)
    known = statistics.agg(F.map_from_entries(F.collect_list(cell)).alias("m")).scalar()  # folds x columns cells
    at = lambda c: F.try_element_at("_m", F.concat_ws("|", F.col(WITHOUT).cast("string"), F.lit(c)))
    kinds = dict(statistics.dtypes)
    return rows.withColumn("_m", known).withColumns({c: F.coalesce(F.col(c).cast(kinds[value]), at(c)) for c in columns}).drop("_m")


def sorted_levels(df: DataFrame, c: str) -> list[str]:
    """The distinct levels in order, from one aggregate. They become columns of a plan, so they are meant to be few;
    a domain too large for that goes through :func:`level_table` and :func:`sparse_features`."""
    return df.agg(F.array_sort(F.collect_set(c)).alias("levels")).first()["levels"]


def one_hot_names(c: str, levels: Sequence[str]) -> list[str]:
    return [f"{c}_{level}" for level in levels[1:]]


def one_hot_drop_first(df: DataFrame, c: str, levels: Sequence[str]) -> DataFrame:
    """0/1 columns ``c_level`` for every level but the first."""
    hits = {f"{c}_{v}": F.coalesce(F.col(c) == F.lit(v), F.lit(False)).cast("double") for v in levels[1:]}
    return df.withColumns(hits) if hits else df


# --- wide domains: levels stay in a table, rows become sparse vectors ---------------------------------


def level_table(df: DataFrame, c: str) -> DataFrame:
    """``(level, pos)`` of the distinct levels in order, stored. ``pos`` counts from the second level; the first, the
    base, has -1. Levels are ranked in slices, so neither one task nor the driver holds them all."""
    distinct = df.filter(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("level")).distinct()
    ranked = range_rank(distinct, [], [F.col("level")], "place")
    return materialise(ranked.select("level", (F.col("place") - 2).cast("int").alias("pos")), "levels")


def _starts(dense: Sequence[str], wide: Mapping[str, DataFrame]) -> tuple[dict[str, int], int]:
    """The first place of each wide column, and the width of the whole vector."""
    starts, width = {}, len(dense)
    for c, levels in wide.items():
        starts[c] = width
        width += max(levels.count() - 1, 0)
    return starts, width


def sparse_features(
    df: DataFrame, dense: Sequence[str], wide: Mapping[str, DataFrame], row_id: str, keep: Sequence[str], out: str = "features"
) -> DataFrame:
    """``keep`` and one sparse vector: the ``dense`` columns, then 0/1 places for all but the first level of each wide one.

    ``wide`` maps columns to their :func:`level_table`, which may be another cohort's: levels it does not hold, its
    first one and NULL are all zeros. Rows meet their places by a join that spreads frequent levels, so no level is
    written into a plan. Missing dense cells are 0, as in :func:`assemble`.
    """
    starts, width = _starts(dense, wide)
    rows = fill_features(df, dense)
    cells = [F.struct(F.lit(i).alias("pos"), F.col(f"`{c}`").alias("value")) for i, c in enumerate(dense)]
    for i, (c, levels) in enumerate(wide.items()):
        places = levels.filter("pos >= 0").select(F.col("level").alias(f"_level_{i}"), F.col("pos").alias(f"_pos_{i}"))
        rows = left_join(rows.withColumn(f"_level_{i}", F.col(c).cast("string")), places, [f"_level_{i}"], row_id)
        hit = F.col(f"_pos_{i}").isNotNull().cast("double")
        cells.append(F.struct((F.coalesce(f"_pos_{i}", F.lit(0)) + F.lit(starts[c])).alias("pos"), hit.alias("value")))
    held = rows.withColumn("_cells", F.filter(F.array(*cells), lambda x: x["value"] != 0.0))

    @F.arrow_udf(VectorUDT())
    def vector(pos: pa.Array, value: pa.Array) -> pa.Array:
        n = len(pos)
        kind, size = pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, width, np.int32))
        return pa.StructArray.from_arrays([kind, size, pos, value], ["type", "size", "indices", "values"])

    # the width alone, not a name for each place
    about = {"ml_attr": {"num_attrs": width}}
    return held.select(*keep, vector("_cells.pos", "_cells.value").alias(out, metadata=about))


def sparse_cells(c: str) -> Column:
    """The non-zero places of a sparse vector column as an array of (pos, value), without widening it."""

    @F.arrow_udf("array<struct<pos:int,value:double>>")
    def cells(vectors: pa.Array) -> pa.Array:
        pos, value = vectors.field("indices"), vectors.field("values")
        offsets = np.append(0, np.cumsum(pos.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pos.flatten(), value.flatten()], ["pos", "value"])
        return pa.ListArray.from_arrays(pa.array(offsets), pairs)

    return cells(c)


def feature_names(spark, dense: Sequence[str], wide: Mapping[str, DataFrame]) -> DataFrame:
    """``(pos, name)`` of every place of :func:`sparse_features`."""
    starts, _ = _starts(dense, wide)
    names = spark.createDataFrame(list(enumerate(dense)), "pos int, name string")
    for c, levels in wide.items():
        own = levels.filter("pos >= 0").select((F.col("pos") + starts[c]).alias("pos"), F.concat(F.lit(f"{c}_"), "level").alias("name"))
        names = names.unionByName(own)
    return names


def common_features(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> tuple[DataFrame, list[str]]:
    """Continuous columns, reversed acuity and one-hot levels, with their names in matrix order."""
    df = df.withColumn(ORDINAL, reverse_ordinal("acuity").cast("double"))
    names = [*CONTINUOUS, ORDINAL]
    for c, domain in levels.items():
        df = one_hot_drop_first(df, c, domain)
        names += one_hot_names(c, domain)
    return df, names


def option_columns(
    common: Sequence[str], categories: Sequence[str] = tuple(COMPLAINT_CATEGORIES), pca: int = 0
) -> dict[str, list[str]]:
    """The four feature sets as ordered column lists; sets that need absent scores are left out."""
    parts = {"categories": list(categories), "pca": [f"cc_pca_{i}" for i in range(pca)]}
    return {
        name: [*common, *[c for p in wanted for c in parts[p]]]
        for name, wanted in OPTIONS.items()
        if all(parts[p] for p in wanted)
    }


def complaint_features(df: DataFrame, c: str = "chiefcomplaint", rules: Mapping[str, str] = COMPLAINT_CATEGORIES) -> DataFrame:
    return multi_hot(df, c, rules)


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """One vector column in the given order; missing cells count as 0."""
    filled = fill_features(df, columns)
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(filled)


def align_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The canonical columns in order: absent ones are 0, extra ones are dropped."""
    return df.select(
        *keep, *[F.col(f"`{n}`") if n in df.columns else F.lit(0.0).alias(n) for n in names]
    )


def align_report(columns: Sequence[str], names: Sequence[str]) -> dict[str, list[str]]:
    """Which canonical columns were filled and which columns were dropped."""
    return {
        "filled": [n for n in names if n not in columns],
        "dropped": [c for c in columns if c not in names],
    }


def check_schema(a: Sequence[str], b: Sequence[str]) -> None:
    """Feature names must be equal in order; anything else is drift."""
    if list(a) != list(b):
        at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        raise ValueError(f"feature schemas differ from position {at}: {list(a)[at:at + 3]} / {list(b)[at:at + 3]}")


def standardize(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables centred and scaled by the train mean and population SD; a constant column becomes 0."""
    stats = train.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(columns)],
        ).alias("s")
    ).scalar()

    def scaled(i: int, c: str) -> Column:
        sd = F.col("_s")[f"s_{i}"]
        return (F.col(c) - F.col("_s")[f"m_{i}"]) / F.when(sd == 0.0, F.lit(1.0)).otherwise(sd)

    def apply(df: DataFrame) -> DataFrame:
        exprs = {c: scaled(i, f"`{c}`") for i, c in enumerate(columns)}
        return df.withColumn("_s", stats).withColumns(exprs).drop("_s")

    return apply(train), apply(test)


def standardize_vectors(
    train: DataFrame, test: DataFrame, keep: Sequence[str] = ("stay_id", "label"), c: str = "features"
) -> tuple[DataFrame, DataFrame]:
    """Like :func:`standardize` for an assembled vector column, however many features it holds.

    A feature that is constant in training, which no model can use, is 0 in both tables.
    """
    scaler = StandardScaler(inputCol=c, outputCol="_unit", withMean=True, withStd=True).fit(train)
    rows = train.count()
    # the scaler divides by the sample SD; the study's SD is the population's
    factor = (rows / max(rows - 1, 1)) ** 0.5
    stretch = ElementwiseProduct(
        scalingVec=Vectors.dense([factor] * len(scaler.mean)), inputCol="_unit", outputCol="_scaled"
    )

    def apply(df: DataFrame) -> DataFrame:
        return stretch.transform(scaler.transform(df)).select(*keep, F.col("_scaled").alias(c))

    return apply(train), apply(test)
