"""Ordered label rules: the first rule that matches names the label."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from strataframe.functions.codes import _col, strip


@dataclass(frozen=True)
class Rule:
    """``label`` applies when the text equals, starts with or contains one of the values."""

    label: str
    equals: tuple[str, ...] = ()
    starts: tuple[str, ...] = ()
    contains: tuple[str, ...] = ()

    def matches(self, text: Column) -> Column:
        tests = [text.startswith(v) for v in self.starts] + [text.contains(v) for v in self.contains]
        if self.equals:
            tests.append(text.isin(list(self.equals)))
        found = tests[0]
        for test in tests[1:]:
            found = found | test
        return found


@dataclass(frozen=True)
class LabelRules:
    rules: tuple[Rule, ...]
    other: str
    missing: str | None  # label of NULL; None lets NULL fall through to ``other``
    trim: bool = True


# Race vocabularies of the two sources and of the reports.
_NOT_TOLD = ("UNKNOWN", "UNABLE TO OBTAIN", "PATIENT DECLINED TO ANSWER")
_GROUPS = (
    Rule("White", starts=("WHITE",)),
    Rule("Black / African American", contains=("BLACK", "AFRICAN")),
    Rule("Asian", starts=("ASIAN",)),
    Rule("Hispanic / Latino", contains=("HISPANIC", "LATINO")),
)
RACE_INTERNAL = LabelRules(
    (Rule("Missing", equals=("",)), Rule("Unknown", equals=_NOT_TOLD), *_GROUPS), "Other", "Missing"
)
RACE_EXTERNAL = LabelRules(
    (Rule("Missing", equals=("",)), Rule("Unknown", equals=(*_NOT_TOLD, "DECLINES TO STATE")), *_GROUPS),
    "Other",
    "Missing",
)
RACE_REPORT = LabelRules(
    (
        Rule("White", starts=("WHITE",)),
        Rule("Black", contains=("BLACK", "AFRICAN")),
        Rule("Hispanic", contains=("HISPANIC", "LATINO")),
        Rule("Asian", contains=("ASIAN",)),
        Rule("Missing", equals=("MISSING", "")),
        Rule("Unknown", contains=("UNKNOWN", "UNABLE")),
    ),
    "Other",
    None,
    trim=False,
)


def normalize_label(c: Column | str, spec: LabelRules) -> Column:
    text = F.upper(strip(c) if spec.trim else _col(c))
    chain = F.when(text.isNull(), F.lit(spec.missing if spec.missing is not None else spec.other))
    for rule in spec.rules:
        chain = chain.when(rule.matches(text), F.lit(rule.label))
    return chain.otherwise(F.lit(spec.other))


def map_values(c: Column | str, mapping: Mapping[object, str], keys: Sequence[object] | None = None) -> Column:
    """Literal value map; values outside the map give NULL."""
    chain = None
    for key in keys or mapping:
        test = _col(c) == F.lit(key)
        chain = F.when(test, F.lit(mapping[key])) if chain is None else chain.when(test, F.lit(mapping[key]))
    return chain
