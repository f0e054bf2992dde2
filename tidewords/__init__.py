"""Timed-transcript analytics for Spark: words, turns, segments, spans, signals, jobs and dictionaries."""
