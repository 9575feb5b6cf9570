"""All registered queries."""

from fleetlog.plans import analysis, history, listing, streams  # noqa: F401
from fleetlog.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
