"""Predicates over diagnosis-like code columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F


# Fixed value: the characters a text trim removes (all Unicode white space).
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column | str) -> Column:
    """Text without white space at both ends; SQL ``trim`` alone removes only blanks."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def normalize_code(c: Column | str, strip_dots: bool = False) -> Column:
    """Trimmed upper-case code, '' for NULL; dots are kept unless asked for."""
    code = F.upper(strip(F.coalesce(_col(c), F.lit(""))))
    return F.replace(code, F.lit("."), F.lit("")) if strip_dots else code


def code_in(c: Column | str, codes: Iterable[str], upper: bool = False) -> Column:
    """Exact membership after trimming; NULL is False. ``upper`` makes it case-insensitive."""
    code = strip(F.coalesce(_col(c), F.lit("")))
    wanted = sorted({k.upper() for k in codes} if upper else set(codes))
    return (F.upper(code) if upper else code).isin(wanted)


def code_in_any(columns: Sequence[Column | str], codes: Iterable[str]) -> Column:
    """Membership of any of several code columns, on normalised codes."""
    codes = list(codes)
    return reduce(lambda a, b: a | b, [code_in(c, codes, upper=True) for c in columns])


def code_prefix_any(c: Column | str, prefixes: Iterable[str], strip_dots: bool = False) -> Column:
    """Does the normalised code start with any prefix? Empty and NULL codes do not."""
    code = normalize_code(c, strip_dots)
    return reduce(lambda a, b: a | b, [code.startswith(p) for p in prefixes], F.lit(False))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
