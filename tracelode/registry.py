"""Every query of the library outside llm by name, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
