"""Registered queries; importing this package registers them all."""

from lumenlake.plans import browse, bundles, corpora, images, intake, joins, sequences, streams, upkeep  # noqa: F401
from lumenlake.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
