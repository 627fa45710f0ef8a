"""Streams of feature rows."""
