"""Loads every query of this subpackage."""

from __future__ import annotations

import corpus_pipeline
from tallyfield.llm import (  # noqa: F401
    chat,
    extraction,
    licenses,
    lines,
    manifest,
    mixing,
    neighbours,
    pieces,
    search,
    simhash,
    sketches,
    toxicity,
    variants,
)
from tallyfield.llm.common import COMPARISONS, QUERIES, query

__all__ = ["COMPARISONS", "QUERIES"]

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
