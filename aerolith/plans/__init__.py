"""Whole queries over the driver's tables, and SQL that gives the same rows."""

from aerolith.plans import evaluation, pieces, queries  # noqa: F401  fill the registry
from aerolith.plans.registry import ORACLES, QUERIES  # noqa: F401
