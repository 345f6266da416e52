"""Ballotbook: plans."""
