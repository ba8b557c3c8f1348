"""Every registered query of the traffic operators, with the SQL that must give the same rows."""

from __future__ import annotations

from trafficlens.plans import extras, payloads, traffic, upkeep  # noqa: F401  they register their queries
from trafficlens.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
