"""Phrase and relation graph analytics on Spark."""
