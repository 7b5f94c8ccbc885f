"""Operators on node and edge tables."""
