"""Typed scans, missing-token rules, schema mapping and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

# Texts a CSV reader of the study treats as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# The cohort contract shared by both hospitals.
COHORT_TYPES = {
    "subject_id": "bigint", "stay_id": "bigint", "hadm_id": "bigint",
    "intime": "timestamp_ntz", "outtime": "timestamp_ntz", "ie_label": "int",
    "gender": "string", "anchor_age": "double", "race": "string",
    "temperature": "double", "heartrate": "double", "resprate": "double", "o2sat": "double",
    "sbp": "double", "dbp": "double", "acuity": "double", "chiefcomplaint": "string",
}
COHORT_COLUMNS = list(COHORT_TYPES)

#: One set of rules for both directions, so that a text comes back as it was written; quotes are doubled.
CSV_RULES = {
    "header": True, "quote": '"', "escape": '"', "lineSep": "\n",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",  # the default stops at milliseconds
}


def scan(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    columns: Sequence[str] | None = None,
    fmt: str = "parquet",
    nan_is_missing: bool = True,
) -> DataFrame:
    """Projected scan; CSV needs a schema (types are declared, never inferred) and has a header.

    CSV texts may hold line breaks, quotes and blanks (``CSV_RULES``); a row that does not fit the schema is an error.

    Turn ``nan_is_missing`` off for tables known to hold no NaN: then filters on floating columns reach
    the file reader as well.
    """
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV scan needs a declared schema")
        df = spark.read.schema(schema).options(**CSV_RULES, multiLine=True, mode="FAILFAST").csv(path)
    else:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        df = reader.format(fmt).load(path)
    df = nan_to_null(df) if nan_is_missing else df
    return df.select(*columns) if columns else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a missing value in the study, so floating columns carry NULL instead."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def null_tokens(df: DataFrame, columns: Sequence[str], tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    return df.withColumns({c: F.when(~F.col(c).isin(list(tokens)), F.col(c)) for c in columns})


def map_schema(df: DataFrame, renames: Mapping[str, str], derived: Mapping[str, Column]) -> DataFrame:
    """Rename a foreign table into the cohort column space, then add derived columns."""
    return df.withColumnsRenamed(dict(renames)).withColumns(dict(derived))


def project_cohort(df: DataFrame) -> DataFrame:
    """The cohort columns in contract order and type; a value that does not fit becomes NULL."""
    return df.select(*[F.col(c).try_cast(t).alias(c) for c, t in COHORT_TYPES.items()])


def write_cohort(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = project_cohort(df).write.mode("errorifexists")
    writer.options(**CSV_RULES, quoteAll=True).csv(path) if fmt == "csv" else writer.parquet(path)


def read_cohort(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    schema = ", ".join(f"{c} {t}" for c, t in COHORT_TYPES.items())
    df = scan(spark, path, schema, fmt=fmt)
    texts = [c for c, t in COHORT_TYPES.items() if t == "string"]
    return null_tokens(df, texts) if fmt == "csv" else df


def write_features(df: DataFrame, names: Sequence[str], path: str, features: str = "features") -> None:
    """Row ids, label and one float array per row, plus a ``(pos, name)`` side table."""
    rows = df.select("stay_id", "label", vector_to_array(features, "float32").alias(features))
    rows.write.mode("errorifexists").parquet(f"{path}/rows")
    spark = df.sparkSession
    side = spark.createDataFrame(list(enumerate(names)), "pos int, name string")
    side.coalesce(1).write.mode("errorifexists").parquet(f"{path}/names")


def read_features(spark: SparkSession, path: str, features: str = "features") -> tuple[DataFrame, list[str]]:
    rows = spark.read.parquet(f"{path}/rows").withColumn(features, array_to_vector(features))
    names = [r["name"] for r in spark.read.parquet(f"{path}/names").orderBy("pos").collect()]
    return rows, names


def write_predictions(df: DataFrame, path: str) -> None:
    """``(stay_id, y_true, y_prob)`` of a scored table."""
    df.select("stay_id", F.col("label").alias("y_true"), F.col("prob").alias("y_prob")).write.mode(
        "errorifexists"
    ).parquet(path)


def metric_table(df: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """One aggregate pass, laid out as ``(metric, value)`` with text values."""
    names = list(metrics)
    wide = df.agg(*[metrics[n].cast("string").alias(n) for n in names])
    return wide.unpivot([], names, "metric", "value")


def available_options(df: DataFrame, options: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """The feature sets whose every input column is present; the others are skipped."""
    present = set(df.columns)
    return {name: list(cols) for name, cols in options.items() if set(cols) <= present}
