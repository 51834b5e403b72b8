"""Streaming versions of analyses that the batch operators make over finished tables."""
