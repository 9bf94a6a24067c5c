"""All queries on planning data."""

from . import models, more, planning, shop, texts, warehouse  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
