"""All registered queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from . import consensus, formulas, knowledge, knowledge_import, upkeep
from .catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "consensus", "formulas", "knowledge", "knowledge_import", "upkeep"]
