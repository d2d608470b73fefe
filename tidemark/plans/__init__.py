"""Queries of the reference's operators on the provided tables."""
