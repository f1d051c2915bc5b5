"""Whole queries: heights, nightly scoring, routes, days."""
