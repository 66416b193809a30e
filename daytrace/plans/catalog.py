"""All registered queries: importing a module of queries registers them."""

from . import advice, enrichment, extras, graphs, guidance, inference, intake, learned, names, productivity, records, reports, sequences, state, streams, texts, wellbeing  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
