"""Queries of the engine."""
