"""Continuous ingest of observations."""
