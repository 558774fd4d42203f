"""Every operator bound to the driver tables; importing registers the queries."""

from evimap.plans import curations, evaluations, extractions, histories, mappings, scalars, streams, structure  # noqa: F401
from evimap.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
