"""Readers of items and rule tables, writers of the outbox."""
