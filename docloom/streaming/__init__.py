"""Structured Streaming: windows over the ledger, deduplication, last observation, ingestion by micro-batch."""

from .seen import first_seen_within, keeping_state
from .streams import echo_stream, first_seen, ingest_stream, last_observation, new_item_events, sessions, sliding, tumbling, unique_events

__all__ = ["echo_stream", "first_seen", "first_seen_within", "ingest_stream", "keeping_state", "last_observation", "new_item_events", "sessions", "sliding", "tumbling", "unique_events"]
