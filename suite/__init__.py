"""Queries over the driver tables, each with the SQL that must give the same rows."""

from suite import (  # noqa: F401
    descriptions,
    evaluations,
    features_and_models,
    joins_and_cohorts,
    tables_and_rules,
)
from suite.registry import ORACLES as ALL_ORACLES, QUERIES as ALL_QUERIES  # noqa: F401
