"""Readers: feeds, API responses, captured JSON and HTML, all from files."""
