"""Registered queries with their SQL; importing a module registers its queries."""

from tidewords.plans import exports, figures, quality, sound, stream_of_words, streams, texts, transcript, work  # noqa: F401
from tidewords.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
