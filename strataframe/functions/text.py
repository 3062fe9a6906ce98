"""Keyword rules and text defaults."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from strataframe.functions.codes import _col, strip

# Complaint categories and their patterns (word boundaries, lower case).
COMPLAINT_CATEGORIES = {
    "fever": r"\b(fever|febrile|temperature|elevated temp)\b",
    "cough": r"\b(cough|coughing|productive)\b",
    "chest_pain": r"\b(chest pain|chest discomfort|cp|angina)\b",
    "abd_pain": r"\b(abdominal pain|abd pain|belly|stomach pain)\b",
    "dyspnea": r"\b(shortness of breath|dyspnea|sob|breathless|wheezing)\b",
    "weakness": r"\b(weakness|weak|fatigue|tired)\b",
    "altered_mental": r"\b(altered mental status|confusion|confused|altered|dementia|delirium)\b",
    "back_pain": r"\b(back pain|lower back|lumbar)\b",
    "nausea_vomiting": r"\b(nausea|vomiting|n/v|vomit|nauseous)\b",
    "headache": r"\b(headache|head pain|migraine)\b",
    "syncope": r"\b(syncope|fainting|passed out|loss of consciousness)\b",
    "infection_signs": r"\b(infection|infected|sepsis|chills|rigors)\b",
}

# Fixed value: keywords that mark a moderate-risk complaint.
RISK_KEYWORDS = r"fever|chills|rigors|back pain|weakness|shortness of breath"


def clean_text(c: Column | str) -> Column:
    return strip(F.coalesce(_col(c), F.lit("")))


def has_keyword(c: Column | str, regex: str) -> Column:
    """Substring search on lower-cased text; NULL counts as ''."""
    return F.lower(F.coalesce(_col(c), F.lit(""))).rlike(regex)


def category_flag(c: Column | str, pattern: str) -> Column:
    """One category rule; Unicode word boundaries on every JDK."""
    return F.lower(F.coalesce(_col(c), F.lit(""))).rlike("(?U)" + pattern)


def keyword_categories(c: Column | str, rules: Mapping[str, str]) -> Column:
    """The categories whose pattern occurs, in rule order; empty for NULL or ''."""
    hits = [F.when(category_flag(c, p), F.lit(name)) for name, p in rules.items()]
    return F.filter(F.array(*hits), lambda name: name.isNotNull())


def multi_hot(df: DataFrame, c: str, rules: Mapping[str, str]) -> DataFrame:
    """One 0/1 double column per category, in rule order."""
    return df.withColumns({n: category_flag(c, p).cast("double") for n, p in rules.items()})
