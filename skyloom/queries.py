"""All registered queries of the engine's own operators, each beside its SQL for DuckDB."""

from __future__ import annotations

from .query_sets import images, imaging, ingest, registry, streams, survey

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
__all__ = ["ORACLES", "QUERIES", "images", "imaging", "ingest", "streams", "survey"]
