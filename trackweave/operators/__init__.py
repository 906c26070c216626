"""Operators over routes, segments, points and keyed collections."""
