"""Incremental runs over a stream of arriving drawings."""
