"""Registered queries over the driver's tables, and their SQL.

The driver's tables are analogues: events stand for observations, lineitem for
boxes and crops, labels for audits, customer for rosters (see ``sources``).
"""

from . import crops, evidence, geometry, images, records, tracking
from .catalogue import ORACLE_SQL, QUERIES, flagship

__all__ = ["ORACLE_SQL", "QUERIES", "crops", "evidence", "flagship", "geometry", "images", "records", "tracking"]
