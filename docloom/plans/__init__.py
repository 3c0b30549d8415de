"""Whole data flows: ingestion, rescoring, search, digests."""
