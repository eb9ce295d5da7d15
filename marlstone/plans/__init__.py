"""Whole plans: the local search from files to bytes, and the catalog of queries."""
