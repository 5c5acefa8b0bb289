"""Queries of every operator over the star-schema tables, each with its SQL counterpart."""

from furrow.workload import cleaning, farming, labelling, profiling, series, transport
from furrow.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cleaning", "farming", "labelling", "profiling", "series", "transport"]
