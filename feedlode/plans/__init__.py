"""Analytic queries over the insights table."""
