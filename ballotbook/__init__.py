"""Ballotbook: Spark-native analytics over public election records."""
