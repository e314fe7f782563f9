"""Transcript corpus analytics on Spark."""
