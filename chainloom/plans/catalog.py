"""Imports every query module so that the table is full; job queries reuse the others, so they come last."""

from chainloom.plans import (  # noqa: F401
    archive_queries,
    condense_queries,
    note_queries,
    prune_queries,
    symbol_queries,
    transcript_queries,
    turn_queries,
)
from chainloom.plans import job_queries  # noqa: F401, I001
from chainloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
