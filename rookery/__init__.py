"""Structural graph analytics on Spark."""
