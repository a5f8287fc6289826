"""Operators chained into whole plans."""
