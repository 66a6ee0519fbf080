"""All queries by name, and their SQL."""

from . import candidates, health, joining, painting, rasters, scoring, splitting, triage  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
