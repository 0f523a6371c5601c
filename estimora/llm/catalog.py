"""Queries on training corpora and their SQL twins."""

from __future__ import annotations

from estimora.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
