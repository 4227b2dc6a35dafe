"""Registered queries by subject; importing this package fills both dictionaries."""

from areal.catalog import classes, matching, plans_and_coverage, releases, scalars, shapes, sources_and_headers, texts  # noqa: F401
from areal.catalog.registered import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
