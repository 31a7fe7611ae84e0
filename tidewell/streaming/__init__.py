"""Incremental counterparts of the append-only result log."""
