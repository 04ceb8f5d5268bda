"""Registered queries over the driver tables."""

from parcelcheck.catalog import polygons, survey, tables  # noqa: F401
from parcelcheck.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
