"""The registered queries."""

from . import catalogue, clinical, models  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalogue", "clinical"]
