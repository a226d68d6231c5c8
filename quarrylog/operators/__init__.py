"""Operators on stored log segments: search, histograms, statistics, compaction."""
