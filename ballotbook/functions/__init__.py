"""Ballotbook: functions."""
