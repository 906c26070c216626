"""Readers of route, track and profile documents, and the fixed dimensions."""
