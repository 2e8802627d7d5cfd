"""Readers and writers of network, demand and settings files, and a network derived from sample tables."""
