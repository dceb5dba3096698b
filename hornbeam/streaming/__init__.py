"""Outbox processing with Structured Streaming."""
