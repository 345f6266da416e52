"""Ballotbook: sources."""
