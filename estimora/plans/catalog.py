"""All queries of the engine; importing a module of plans registers its queries."""

from __future__ import annotations

from estimora.plans import dialogue, documents, estimation, events, files, knowledge, rules, search
from estimora.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "dialogue", "documents", "estimation", "events", "files", "knowledge", "rules", "search"]
