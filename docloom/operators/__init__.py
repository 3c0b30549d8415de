"""Relational operators: filters, joins, rankings, aggregates, deduplication."""
