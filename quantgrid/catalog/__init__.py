"""Registered queries over the driver tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from quantgrid.catalog import agreement, classes, differential, ids, intake, preparation, quality
from quantgrid.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "agreement", "classes", "differential", "ids", "intake", "preparation", "quality"]
