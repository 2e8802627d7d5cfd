"""Structured Streaming views of link counts and queues."""
