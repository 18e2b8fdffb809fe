"""Relational operators: detection, enrichment, event store queries, statistics."""
