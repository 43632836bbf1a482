"""All queries by name."""

from standmap.plans import rasters, scores, tables  # noqa: F401
from standmap.plans.registry import ORACLE, QUERIES  # noqa: F401
