"""The queries: operators bound to the driver's tables."""

from lexmill.plans import evals, graph, search, texts  # noqa: F401
from lexmill.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
