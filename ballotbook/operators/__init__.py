"""Ballotbook: operators."""
