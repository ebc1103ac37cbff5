"""All queries of the document engine, by name, with their SQL."""

from __future__ import annotations

from lodestone import registry
from lodestone.functions import language, text  # noqa: F401
from lodestone.operators import aggregates, asof, chunking, closure, filters, functions, joins, retrieval, sections, semantic, sets, tables, tools, topk, windows  # noqa: F401
from lodestone.sources import pages, readers, sinks  # noqa: F401
from lodestone.streaming import claims, events, limits, queues  # noqa: F401

FLAGSHIP = "hybrid_search"
QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
