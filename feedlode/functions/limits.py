"""Limits and windows as the query entries accept them."""

from __future__ import annotations

from feedlode.functions.fixed_values import DEFAULT_LIMIT, DEFAULT_WINDOW_HOURS, MAX_LIMIT


def to_int(value: object) -> int:
    """Whole number of a request parameter; anything else counts as 0."""
    try:
        return int(str(value))
    except ValueError:
        return 0


def clamp_limit(value: object) -> int:
    limit = to_int(value)
    return DEFAULT_LIMIT if limit < 1 else min(limit, MAX_LIMIT)


def clamp_hours(value: object) -> int:
    hours = to_int(value)
    return DEFAULT_WINDOW_HOURS if hours < 1 else hours
