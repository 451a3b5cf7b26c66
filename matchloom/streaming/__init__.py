"""Incremental scoring of new documents."""
