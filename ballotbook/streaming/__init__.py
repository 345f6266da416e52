"""Ballotbook: streaming."""
