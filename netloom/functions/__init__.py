"""Scalar expressions: time, text, geometry, cells, and volume-delay formulas."""
