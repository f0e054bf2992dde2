"""DataFrame operators over words, turns, segments, spans, signals, jobs and dictionaries."""
