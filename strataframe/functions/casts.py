"""Coercions that turn bad input into NULL instead of failing under ANSI mode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strataframe.functions.codes import _col

NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_num(c: Column | str, type_name: str = "double", is_text: bool = True) -> Column:
    """Number or NULL. Text must look like a plain number, so 'nan', 'inf' or '1d' are NULL."""
    source = _col(c)
    if is_text:
        source = F.when(source.rlike(NUMERIC_TEXT), F.trim(source))
    number = source.try_cast("double")
    number = F.when(F.isnan(number), None).otherwise(number)
    return number if type_name == "double" else number.try_cast(type_name)


def to_ts(c: Column | str, fmt: str | None = None) -> Column:
    parsed = F.try_to_timestamp(_col(c), F.lit(fmt)) if fmt else F.try_to_timestamp(_col(c))
    return parsed.cast("timestamp_ntz")


def leading_int(c: Column | str) -> Column:
    """The integer a text starts with ('3-Urgent' is 3), else NULL."""
    return F.regexp_extract(F.coalesce(_col(c), F.lit("")), r"^\s*(\d+)", 1).try_cast("int")


def c_to_f(c: Column | str) -> Column:
    return to_num(c) * F.lit(9.0) / F.lit(5.0) + F.lit(32.0)


def reverse_ordinal(c: Column | str, top: int = 5, default: int = 3) -> Column:
    """``top - value``, truncated to an integer and held in 0..top-1; NULL counts as ``default``."""
    turned = (F.lit(top) - F.coalesce(_col(c).cast("double"), F.lit(float(default)))).cast("int")
    return F.least(F.greatest(turned, F.lit(0)), F.lit(top - 1))


def fill_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL and NaN become 0; infinities become the largest finite double."""
    largest = 1.7976931348623157e308

    def filled(name: str) -> Column:
        value = F.col(name).cast("double")
        finite = F.least(F.greatest(value, F.lit(-largest)), F.lit(largest))
        return F.when(value.isNull() | F.isnan(value), F.lit(0.0)).otherwise(finite)

    return df.withColumns({c: filled(c) for c in columns})
