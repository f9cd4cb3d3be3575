"""Operators over zone, box and text tables."""
