"""Streams: upserts into the graph's tables, and windows over trace spans."""
